"""Operator 3: token ids as fixed-width bit-packed files.

Every id takes the bits that the largest id needs. Ids lie in blocks of a fixed
number; a table of block offsets gives random access, and a block unpacks with
numpy in one go. A file holds the ids of consecutive documents in ascending id
order (a null id first, ties by the text's hash); a document is never cut. Files are rows of
a table that Spark writes to the shared folder, so a lost executor's part is
simply written again.

A null text is empty. A document may be longer than a file's usual size; its file
is then as long as it. Repeated rows are separate documents, one after the other; rows
that share an id are dealt to several tasks all the same. An empty table gives no
rows. Ids must be whole numbers (or null), as files hold 64-bit ids: others raise
TypeError. Only id and text are read: further columns don't take part.

Encoding goes through the tokenizers library. Byte-level BPE never merges across
a space or newline that stands between two visible characters, so texts are cut
there and a worker encodes each distinct part once for as long as it remembers
it. New parts go to the library side by side; the bytes that each id stands for
tell where a part's ids end.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType

from . import common

MAGIC = b"FXPK"
HEADER = struct.Struct("<4sHHIIQ")  # magic, version, bits, ids in a block, documents, ids
BLOCK = 4096
FILE_IDS = 1 << 20
CACHE_PARTS = 600_000
SLICE_BYTES = 8 << 20
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A space or newline beside another blank: such texts are cut by CUT itself.
BLANKS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}][ \n]|[ \n][\s\p{Z}\x0b\x1c-\x1f\x{85}]|[ \n]$|^[ \n]"


def bits_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as `bits` bits each, least significant first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def file_image(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One file: header, whether a document has an id, document ids, ids before each document, block offsets, blocks."""
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    return b"".join([
        HEADER.pack(MAGIC, 1, bits, block, len(doc_ids), len(ids)),
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        common.starts_of(lengths).astype("<u8").tobytes(),
        common.starts_of(np.array([len(b) for b in blocks], dtype=np.int64)).astype("<u8").tobytes(),
        *blocks,
    ])


class PackedFile:
    """Reads a file image: documents, and any range of ids by the blocks that hold it."""

    def __init__(self, image: bytes):
        magic, version, self.bits, self.block, self.documents, self.ids = HEADER.unpack_from(image)
        if magic != MAGIC or version != 1:
            raise ValueError("not a packed id file")
        self.image, at = image, HEADER.size
        has = np.frombuffer(image, np.uint8, self.documents, at)
        at += self.documents
        numbers = np.frombuffer(image, "<i8", self.documents, at)
        at += 8 * self.documents
        self.doc_ids = [int(n) if h else None for h, n in zip(has, numbers)]
        self.starts = np.frombuffer(image, "<u8", self.documents + 1, at).astype(np.int64)
        at += 8 * (self.documents + 1)
        n = -(-self.ids // self.block)
        self.offsets = np.frombuffer(image, "<u8", n + 1, at).astype(np.int64)
        self.data = at + 8 * (n + 1)

    def range(self, start: int, end: int) -> np.ndarray:
        first, last = start // self.block, -(-end // self.block)
        parts = [unpack(self.image[self.data + self.offsets[b] : self.data + self.offsets[b + 1]], self.bits, min(self.block, self.ids - b * self.block)) for b in range(first, last)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block] if parts else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))

    def all(self) -> np.ndarray:
        if self.bits in (8, 16, 32) or self.block * self.bits % 8 == 0:  # blocks then follow one another without padding
            return unpack(self.image[self.data :], self.bits, self.ids)
        return self.range(0, self.ids)


def parts_of(texts: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """flat() of the parts of texts, cut before a single space or newline between visible characters."""
    mark = common.unused_mark(texts)
    if mark is None:
        return common.flat(pa.array([CUT.split(t) for t in texts.to_pylist()], type=pa.list_(pa.string())))
    marked = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", mark + "\n")
    odd = pc.match_substring_regex(texts, BLANKS)
    if pc.any(odd).as_py():
        marked = pc.replace_with_mask(marked, odd, pa.array([CUT.sub(mark, t) for t in texts.filter(odd).to_pylist()], type=pa.string()))
    return common.flat(pc.split_pattern(marked, mark))


class Encoder:
    """The library's ids of parts of text, with a bounded memory of parts seen by this worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.largest = self.tokenizer.get_vocab_size() - 1
        added = self.tokenizer.get_added_tokens_decoder()
        #: Bytes of text that an id stands for: a byte-level token has a character for each.
        self.widths = np.zeros(self.largest + 1, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(token.encode()) if i in added else len(token)
        self.known = common.Known(self.encode, CACHE_PARTS)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per part). Parts that may stand side by side go to the library as one text."""
        joins = np.array([len(p) > 1 and p[0] in " \n" and not p[1].isspace() and not p[-1].isspace() for p in parts], dtype=bool)
        texts, at = [], 0
        firsts = []  # of the parts in each text
        while at < len(parts):
            end = at + 1
            while end < len(parts) and end - at < 256 and joins[end - 1] and joins[end]:
                end += 1
            firsts.append(at)
            texts.append("".join(parts[at:end]))
            at = end
        coded = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids = np.concatenate([*coded, np.zeros(0, np.uint32)]).astype(np.uint32)
        ends = np.cumsum([len(p.encode()) for p in parts])
        widths = np.cumsum(self.widths[ids])
        upto = np.searchsorted(widths, ends, "right")
        whole = np.concatenate([[0], widths])[upto]
        if len(parts) and not (np.array_equal(whole, ends) and len(widths) == upto[-1]):  # no byte-level vocabulary
            coded = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
            return np.concatenate(coded), np.array([len(c) for c in coded], dtype=np.int64)
        return ids, np.diff(upto, prepend=0).astype(np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text); a null text has none."""
        return self.known.ids(*parts_of(pc.fill_null(texts, "")))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Packed files in ascending document order: shard, file_no, before (ids of the shard before this file), n_docs, n_ids, image."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be a column of whole numbers")
    chosen = docs.select(F.col(f"`{doc_id}`").cast(LongType()).alias("doc_id"), F.col(f"`{text}`").cast(StringType()).alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    # rows of one id and hash may stand in any order: _at only deals many of them to several tasks
    ordered = chosen.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(shards, "doc_id", "_h", "_at").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        own, end = encoder(tokenizer), [] if end_id is None else [end_id]
        bits = bits_for(max([own.largest, *end]))
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        held: list = []
        size = 0

        def cut():
            nonlocal number, before, held, size
            docs_, lengths, ids = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([len(docs_)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([file_image(docs_, lengths, ids, bits)], pa.binary())], names=["shard", "file_no", "before", "n_docs", "n_ids", "image"])
            number, before, held, size = number + 1, before + len(ids), [], 0
            return out

        for batch in batches:
            for part in common.slices(batch, "text", most=SLICE_BYTES):
                ids, lengths = own.texts(part.column("text"))
                if end:
                    ids = np.insert(ids, np.cumsum(lengths), end[0])
                    lengths = lengths + 1
                held.append((part.column("doc_id").to_pylist(), lengths, ids.astype(np.uint32)))
                size += len(ids)
                if size >= file_ids:
                    yield cut()
        if held:
            yield cut()

    return ordered.mapInArrow(write, "shard int, file_no long, before long, n_docs long, n_ids long, image binary")


def read(files: DataFrame) -> DataFrame:
    """Every document in packed files: doc_id, start (ids of all documents before it), n_tokens, ids_le (its ids as little-endian 32-bit)."""
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard, of which there is a set number
    firsts = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def unpacked(batches):
        for batch in batches:
            for start, image in zip(batch.column("start").to_pylist(), batch.column("image")):  # one file image at a time
                file = PackedFile(image.as_py())
                ids = file.all().astype("<u4")
                raw = pa.py_buffer(ids.tobytes())
                for i in range(0, file.documents, 4096):
                    s = file.starts[i : min(i + 4096, file.documents) + 1]
                    n = len(s) - 1
                    own = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * (s - s[0])).astype(np.int32).tobytes()), raw.slice(int(4 * s[0]), int(4 * (s[-1] - s[0])))])
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[i : i + n], pa.int64()), pa.array(start + s[:-1]), pa.array(np.diff(s)), own], names=["doc_id", "start", "n_tokens", "ids_le"])

    placed = files.join(F.broadcast(firsts), "shard").select((F.col("shard_start") + F.col("before")).alias("start"), "image")
    return placed.mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids_le binary")


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, **how) -> None:
    encode(docs, tokenizer, end_id, **how).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return read(spark.read.parquet(path))

"""Operator 7: SentencePiece encoding and decoding by streaming Viterbi.

Text is fed in any chunks. Only boundaries from which a piece may still continue
stay alive, at most the longest piece's length back; as soon as all surviving
backpointer paths meet in one boundary, the ids before it are committed and
forgotten, so memory doesn't follow the text. At a word mark all paths meet, so a
segment's ids depend on the segment alone and a worker keeps those it has seen.

A mark stands for a space; one is put before each text and taken off again when
decoding. Characters without a piece become byte pieces. Decoding gives the text
back, with a literal mark read as a space. A null or empty text has no ids;
repeated rows each get a row, an empty table none. Further columns pass through; one
that is named like a result comes back as doc_<name>.
"""

from __future__ import annotations

import functools
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import common, unigram
from .token_counts import segments

CACHE_SEGMENTS = 250_000
SLICE_BYTES = 2 << 20


class StreamingViterbi:
    """One segment's best pieces. feed() and finish() return the ids that have become certain.

    prefixes is an Aho-Corasick automaton of the pieces; it reads the new characters and
    as many before them as a piece may have. Its matches come by ascending end and, at an
    end, by ascending start; of equal scores the first stays, and an uncovered character
    comes last. Where paths don't meet (as in one character repeated), only the window's
    boundaries grow, and a meeting is looked for again when it has doubled.
    """

    def __init__(self, vocabulary: unigram.Vocabulary, prefixes):
        self.vocabulary, self.prefixes = vocabulary, prefixes
        self.base, self.end = 0, 0  # committed up to; read up to
        self.tail = ""  # the last characters read, as many as a piece may have
        self.unknown: dict[int, str] = {}  # uncovered characters by the boundary after them
        self.scores, self.pieces, self.starts = [0.0], [-1], [-1]  # best way to each boundary from base on
        self.look_at = 2 * vocabulary.longest

    def feed(self, chunk: str) -> list[int]:
        out: list[int] = []
        longest = self.vocabulary.longest
        for at in range(0, len(chunk), longest):
            self.advance(chunk[at : at + longest])
            if self.end - self.base >= self.look_at:
                out += self.commit(self.meeting())
                self.look_at = 2 * max(longest, self.end - self.base)
        return out

    def advance(self, step: str) -> None:
        scores, pieces, starts = self.scores, self.pieces, self.starts
        before = closed = self.end - self.base
        self.end += len(step)
        scores += [-inf] * len(step)
        pieces += [-1] * len(step)
        starts += range(before, before + len(step))
        text = self.tail + step
        shift = before - len(self.tail) + 1  # from a character's place in text to the boundary after it
        covered = self.vocabulary.characters.issuperset(step)
        for at, (length, piece, own) in self.prefixes.iter(text):
            end = at + shift
            if end <= before or end < length:
                continue
            if not covered and end > closed + 1:
                self.close(closed + 1, end, text, shift)
                closed = end - 1
            score = scores[end - length] + own
            if score > scores[end]:
                scores[end], pieces[end], starts[end] = score, piece, end - length
        if not covered:
            self.close(closed + 1, self.end - self.base + 1, text, shift)
        self.tail = text[-self.vocabulary.longest :]

    def close(self, first: int, end: int, text: str, shift: int) -> None:
        """At each of these boundaries the character before may be one that no piece covers."""
        for b in range(first, end):
            character = text[b - shift]
            if character not in self.vocabulary.characters:
                score = self.scores[b - 1] + self.vocabulary.unknown
                if score > self.scores[b]:
                    self.scores[b], self.pieces[b], self.starts[b] = score, -1, b - 1
                    self.unknown[self.base + b] = character

    def finish(self) -> list[int]:
        return self.commit(self.end)

    def meeting(self) -> int:
        """The last boundary on the paths of all boundaries from which a piece may still go on."""
        last = self.end - self.base
        live = set(range(max(0, last + 1 - self.vocabulary.longest), last + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.starts[last])
        return self.base + live.pop()

    def commit(self, boundary: int) -> list[int]:
        out, at = [], boundary - self.base
        while at > 0:
            piece, start = self.pieces[at], self.starts[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.vocabulary.byte_ids[b] for b in reversed(self.unknown[self.base + at].encode("utf-8", "surrogatepass"))]
            at = start
        out.reverse()
        gone = boundary - self.base
        if gone:
            self.scores, self.pieces, self.starts = self.scores[gone:], self.pieces[gone:], [s - gone for s in self.starts[gone:]]
            self.unknown = {b: c for b, c in self.unknown.items() if b > boundary}
            self.base = boundary
        return out


class Codec:
    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = v = unigram.load(path)
        self.prefixes = ahocorasick.Automaton()
        for piece, i in v.ids.items():
            self.prefixes.add_word(piece, (len(piece), i, v.scores[i]))
        self.prefixes.make_automaton()
        self.known = common.Known(self.encode_all, CACHE_SEGMENTS)
        values = {i: bytes([b]) for b, i in v.byte_ids.items()} | {i: v.pieces[i].replace(unigram.MARK, " ").encode() for i in v.normal}
        raw = [values.get(i, b"") for i in range(len(v.pieces))]
        self.bytes, self.offsets = np.frombuffer(b"".join(raw), np.uint8), common.starts_of(np.array([len(r) for r in raw], dtype=np.int64))

    def encode(self, segment: str, chunk: int = 1 << 16) -> list[int]:
        stream = StreamingViterbi(self.vocabulary, self.prefixes)
        return [i for s in range(0, len(segment), chunk) for i in stream.feed(segment[s : s + chunk])] + stream.finish()

    def encode_all(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per segment) of segments without their marks."""
        each = [self.encode(unigram.MARK + s) for s in found]
        return np.array([i for ids in each for i in ids], dtype=np.uint32), np.array([len(ids) for ids in each], dtype=np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of lists of ids; bytes that are no UTF-8 become the replacement character."""
        raw, sizes = common.gather(ids, counts, self.bytes, self.offsets)
        drop = common.starts_of(sizes)[:-1][sizes > 0]  # the mark before each text
        drop = drop[raw[drop] == 32]
        doc = np.repeat(np.arange(len(sizes)), sizes)[drop] if len(drop) else np.zeros(0, np.int64)
        sizes = sizes - np.bincount(doc, minlength=len(sizes))
        raw = np.delete(raw, drop)
        found = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(common.starts_of(sizes).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        try:
            texts = found.cast(pa.string())
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], type=pa.string())


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with `ids`."""
    path = model or unigram.default_path()
    docs, text = common.beside(docs, text, ("ids",))
    schema, keep = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            own = codec(path)
            for part in common.slices(batch, text, most=SLICE_BYTES):
                ids, n = own.known.ids(*segments(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), common.list_array(ids.astype(np.int32), n, pa.int32())], names=[*keep, "ids"])

    return docs.mapInArrow(run, StructType([*schema]).add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """encoded with `decoded`; null ids give an empty text."""
    path = model or unigram.default_path()
    encoded, ids = common.beside(encoded, ids, ("decoded",))
    schema, keep = encoded.schema, encoded.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = codec(path).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts], names=[*keep, "decoded"])

    return encoded.mapInArrow(run, StructType([*schema]).add("decoded", StringType()))

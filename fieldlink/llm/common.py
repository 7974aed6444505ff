"""What the operators share: the shared scratch folder, bounded text slices and flat words.

Python runs only inside Spark tasks here, over Arrow batches; a batch is cut into
slices of bounded bytes, so a worker's memory doesn't follow the batch size.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

SLICE_BYTES = 2 << 20
#: Control and private characters, rare in text.
MARKS = [chr(c) for c in [*range(1, 9), *range(0xE000, 0xE100)]]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written in the scopes that are open in this context, so in this thread.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, safe when executors go. Inside scratch() it goes when that ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those that the yielded function was given."""
    paths: list[str] = []
    outer = _scopes.get()
    token = _scopes.set((*outer, paths))

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df._written_at)
        if outer:
            outer[-1].append(df._written_at)
        return df

    try:
        yield keep
    finally:
        _scopes.reset(token)
        deleted(spark, paths)


def deleted(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables by their paths."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleared(df: DataFrame, added: Iterable[str]) -> DataFrame:
    """df with its own columns that have the name of an added one renamed to doc_<name> (again doc_ in front while that is taken)."""
    taken, names = {c.lower() for c in df.columns} | {a.lower() for a in added}, []
    for c in df.columns:
        new = c
        if c.lower() in {a.lower() for a in added}:
            while new.lower() in taken:
                new = f"doc_{new}"
            taken.add(new.lower())
        names.append(new)
    return df.toDF(*names)


def beside(df: DataFrame, column: str, added: Iterable[str]) -> tuple[DataFrame, str]:
    """cleared(), and the name that `column` has then."""
    out = cleared(df, added)
    return out, out.columns[df.columns.index(column)]


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by place, so that no name can clash, and the new name of each."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(new).alias(old) for old, new in names.items()))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with `_row`, an own key of each row."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """Unsigned crc32 of the id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def hash_share(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of df at any size, the same ones in each run, chosen by the key's hash."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < int(most / n * (1 << 20)))


def slices(batch: pa.RecordBatch, *columns: str, most: int = SLICE_BYTES):
    """Parts of the batch of about `most` bytes of text in all columns; a row of more is a part of its own."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def flat(lists: pa.ListArray) -> tuple[np.ndarray, list, np.ndarray]:
    """Lists of strings as (code of each string, distinct strings, strings per list)."""
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), counts


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, distinct words, words per text) of the words `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.binary_length(words).to_numpy(zero_copy_only=False) == 0
    if empty.any():
        real = ~empty[codes]
        doc = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(doc[real], minlength=len(counts)).astype(np.int64)
        codes = codes[real]
    return codes, words, counts


def ascii_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, list, np.ndarray]:
    """coded_words() with a list of words."""
    codes, words, counts = coded_words(texts, lower)
    return codes, words.to_pylist(), counts


def unused_mark(texts: pa.Array) -> str | None:
    """A character that none of the texts has, to cut them by; None if they have all of MARKS."""
    return next((c for c in MARKS if not pc.any(pc.match_substring(texts, c)).as_py()), None)


def give_back() -> None:
    """Memory freed by this process goes back to the system, where the C library has a call for it; it would keep that of many small arrays."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def gather(codes: np.ndarray, counts: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code stands for values[offsets[code]:offsets[code + 1]]: the values of all codes, and their number for each list."""
    lens = offsets[1:] - offsets[:-1]
    each = lens[codes]
    total = starts_of(each)
    at = np.arange(total[-1]) + np.repeat(offsets[codes] - total[:-1], each)
    ends = starts_of(counts)
    return values[at], total[ends[1:]] - total[ends[:-1]]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts_of(counts).astype(np.int32)), pa.array(values, type=kind))


#: Characters of strings that a worker keeps in a memory of those it has seen.
MEMORY_CHARS = 8 << 20


class Known:
    """Ids of the strings that a worker has met, of at most about `most` and MEMORY_CHARS characters; encode gives (all ids, ids per string) of new ones."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.chars = 0
        self.values, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def ids(self, codes: np.ndarray, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per list) of lists of words as flat() has them."""
        if len(self.seen) > self.most or self.chars > MEMORY_CHARS:
            self.forget()
        places = np.fromiter(map(self.seen.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        if len(new):
            ids, lengths = self.encode(unknown := [words[i] for i in new])
            places[new] = np.arange(len(self.seen), len(self.seen) + len(new))
            self.seen.update(zip(unknown, places[new].tolist()))
            self.chars += sum(map(len, unknown))
            self.values, self.lengths = np.concatenate([self.values, ids]), np.concatenate([self.lengths, lengths])
        return gather(places[codes], counts, self.values, starts_of(self.lengths))

"""Operator 6: toxicity by a convolutional text classifier.

Words become hashed embeddings, each the sum of its own and of its stems' (its first
characters), so rare forms of a word share what is known of it; filters of several widths run over the whole
text, each keeps its largest response, and a linear layer weighs those. An embedding
is what all labelled rows say of its bucket: how much likelier rows with it are toxic, bent
at fixed places. A labelled row's own fold doesn't count in its embeddings, so the filters
learn how far to trust those of new rows.

Learning reads every labelled row: one pass in Spark counts buckets, then tasks train the
filters on parts of the rows, round by round from the mean of all parts (parameters only come to the
driver), and a last pass counts the outputs of all rows for the thresholds. A row's
language is guessed from its words by naive Bayes, learned on the same rows where they
name one, and each guessed language has its own threshold, which the score puts at 0.5.

Only the text enters a score. A null or empty text has no words and gets the score
of an empty one; repeated rows each get a row, an empty table none; with nothing to
learn from all scores are 0. Further columns pass through; one that is named like a
result comes back as doc_<name>. Ids may be of any type.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from . import common

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 16, (1, 2, 3), 12
#: Characters of the stems of a longer word.
STEMS = (4, 5, 6, 7)
PAD = max(WIDTHS) - 1
#: Buckets of the words that tell languages; buckets that go together where counts are summed up; words of a text that go by at once.
LANGS, CHUNK, PIECE = 1 << 15, 1 << 12, 60_000
#: Where embeddings bend: values of a bucket's log odds above and below nothing.
ABOVE, BELOW = (0, 0.25, 0.5, 0.75, 1, 1.5, 2, 2.5, 3, 4), (0, 0.5, 1, 1.5, 2, 3)
#: Outputs are told apart to so many parts of one where thresholds are set.
STEPS = 1024
#: A toxic row that is missed counts as so many false alarms where thresholds are set.
MISSED = 2
STRIP = ".,;:!?\"'()[]{}<>*_-…«»¿¡"


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """xxh32 of each text's UTF-8, of all short ones at once."""
    import xxhash

    turned = lambda h, k: (h << np.uint32(k)) | (h >> np.uint32(32 - k))
    p1, p2, p3, p4, p5 = map(np.uint32, (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    lengths, held = np.diff(offsets), np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    first = np.concatenate([held, np.zeros(16, np.uint8)])[(offsets[:-1] - offsets[0])[:, None] + np.arange(16)]
    h = lengths.astype(np.uint32) + np.uint32((seed + int(p5)) & 0xFFFFFFFF)
    four = first.view("<u4")
    for i in range(3):
        h = np.where(lengths >= 4 * i + 4, turned(h + four[:, i] * p3, 17) * p4, h)
    for j in range(3):
        at = np.minimum(lengths // 4 * 4 + j, 15)
        h = np.where(at < lengths, turned(h + first[np.arange(len(at)), at] * p5, 11) * p1, h)
    h = (h ^ (h >> np.uint32(15))) * p2
    h = (h ^ (h >> np.uint32(13))) * p3
    h ^= h >> np.uint32(16)
    long = np.flatnonzero(lengths >= 16)
    h[long] = [xxhash.xxh32_intdigest(w, seed) for w in words.take(pa.array(long)).to_pylist()]
    return h


def buckets_of(words: pa.Array) -> np.ndarray:
    """A row for each word: buckets from 1 on of the word and of its stems, 0 for stems that aren't shorter than it."""
    made = lambda texts, seed: 1 + (hashes(texts, seed) % np.uint32(BUCKETS - 1)).astype(np.int32)
    lengths, out = pc.utf8_length(words).to_numpy(zero_copy_only=False), np.zeros((len(words), 1 + len(STEMS)), np.int32)
    out[:, 0] = made(words, 0)
    for k, n in enumerate(STEMS, 1):
        longer = np.flatnonzero(lengths > n)
        out[longer, k] = made(pc.utf8_slice_codeunits(words.take(pa.array(longer)), 0, n), n)
    return out


def featured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each distinct word, number of each word among those, words per text)."""
    codes, words, counts = common.coded_words(texts)
    return buckets_of(pc.utf8_trim(words.cast(pa.string()), STRIP)), codes, counts


def embedded(odds: np.ndarray, trust: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The embedding of each word, from its buckets' log odds; row 0 is padding."""
    s, t = odds[words].astype(np.float32), trust[words].astype(np.float32)
    bent = [*(np.maximum(s - k, 0) for k in ABOVE), *(np.maximum(-s - k, 0) for k in BELOW)]
    return np.concatenate([np.zeros((1, DIM), np.float32), np.stack([(b * t).sum(1) for b in bent], 1) / 4])


class Net:
    """The classifier's parameters; row 0 is padding. parts has the rows of e that make up each word, word 0 is padding; trust has each row's weight.

    `e` gives the embeddings, a row a word; without it they are made at random.
    """

    def __init__(self, rows: int, parts: np.ndarray | None = None, trust: np.ndarray | None = None, seed: int = 3, e: np.ndarray | None = None):
        self.parts = np.arange(rows)[:, None] if parts is None else parts
        self.trust = np.ones((rows, 1), np.float32) if trust is None else trust.astype(np.float32)[:, None]
        made = np.random.default_rng(seed)
        self.w = [(made.standard_normal((n, DIM, FILTERS)) / np.sqrt(n * DIM)).astype(np.float32) for n in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (made.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.e = (made.standard_normal((rows, DIM)) * 0.1).astype(np.float32) if e is None else e
        self.e[0] = 0
        self.words = self.e if parts is None and trust is None else (self.e[self.parts] * self.trust[self.parts]).sum(1)
        self.moments = [np.zeros_like(p) for p in self.params() * 2]
        self.steps = 0

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.b, self.out, self.bias]

    def packed(self) -> np.ndarray:
        """Parameters, their moments and the number of steps, as one row of numbers."""
        return np.concatenate([*(p.ravel() for p in [*self.params(), *self.moments]), [self.steps]]).astype(np.float32)

    def unpacked(self, numbers: np.ndarray) -> Net:
        """This network with the parameters that packed() gave."""
        start = 0
        for p in [*self.params(), *self.moments]:
            p[...] = numbers[start : start + p.size].reshape(p.shape)
            start += p.size
        self.steps = float(numbers[start])
        return self

    def pooled(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For padded ids (texts x longest + PAD): the filters' largest responses, and where they are. Long texts go by in pieces."""
        weights = np.concatenate([w[j] for w in self.w for j in range(len(w))], 1)
        tops = np.zeros((len(ids), FILTERS * len(WIDTHS)), np.float32)
        places = np.zeros(tops.shape, np.int64)
        for start in range(0, ids.shape[1] - PAD, PIECE):
            part = ids[:, start : start + PIECE + PAD]
            longest = part.shape[1] - PAD
            each = (self.words[part].reshape(-1, DIM).astype(np.float32) @ weights).reshape(*part.shape, -1)
            outside = np.arange(start, start + longest)[None, :] >= lengths[:, None]
            at = 0
            for c, (n, b) in enumerate(zip(WIDTHS, self.b)):
                r = each[:, :longest, at : at + FILTERS] + b
                for j in range(1, n):
                    r += each[:, j : j + longest, at + j * FILTERS : at + (j + 1) * FILTERS]
                at += n * FILTERS
                r[outside] = 0
                place = r.argmax(1)
                top, own = np.take_along_axis(r, place[:, None], 1)[:, 0], slice(c * FILTERS, (c + 1) * FILTERS)
                better = top > tops[:, own] if start else np.ones(top.shape, bool)
                tops[:, own] = np.where(better, np.maximum(top, 0), tops[:, own])
                places[:, own] = np.where(better, place + start, places[:, own])
        return tops, [places[:, c * FILTERS : (c + 1) * FILTERS] for c in range(len(WIDTHS))]

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int, ratio: float, rate: float = 0.02, tokens: int = PIECE, seed: int = 5) -> None:
        """Goes on from its parameters and moments; a toxic row weighs `ratio` times another. Embeddings stay as they are."""
        made = np.random.default_rng(seed)
        weight = np.where(labels == 1, min(10.0, ratio), 1.0)
        params, count = self.params(), len(self.params())
        first, second = self.moments[:count], self.moments[count:]
        for epoch in range(epochs):
            # texts of like length go together
            order = np.array(sorted(made.permutation(len(texts)), key=lambda i: len(texts[i]) // 64))
            batches, start = [], 0
            while start < len(order):
                end = start + 1
                while end < len(order) and end - start < 32 and (end - start + 1) * (max(len(texts[order[end]]), len(texts[order[start]])) + PAD) <= tokens:
                    end += 1
                batches.append(order[start:end])
                start = end
            for done, k in enumerate(made.permutation(len(batches))):
                # steps get shorter towards the end, so the last texts don't decide
                pace = rate * 0.5 * (1 - (epoch + done / len(batches)) / epochs)
                rows = batches[k]
                lengths = np.array([len(texts[i]) for i in rows])
                ids = np.zeros((len(rows), max(1, lengths.max()) + PAD), np.int32)
                for r, i in enumerate(rows):
                    ids[r, : lengths[r]] = texts[i]
                top, places = self.pooled(ids, lengths)
                z = top @ self.out + self.bias
                d = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                back = d[:, None] * self.out * (top > 0)
                grads_w, grads_b = [], []
                for c, (n, place) in enumerate(zip(WIDTHS, places)):
                    g = back[:, c * FILTERS : (c + 1) * FILTERS]
                    grads_w.append(np.stack([np.einsum("bfd,bf->df", self.words[np.take_along_axis(ids, place + j, 1)].astype(np.float32), g) for j in range(n)]))
                    grads_b.append(g.sum(0))
                grads = [*grads_w, *grads_b, top.T @ d + 1e-3 * self.out, np.array([d.sum()], np.float32)]
                self.steps += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= pace * (m / (1 - 0.9**self.steps)) / (np.sqrt(np.maximum(v, 0) / (1 - 0.99**self.steps)) + 1e-6)

    def tables(self) -> list[list[np.ndarray]]:
        """Each row's share in each filter's response, by width and place in the window, in 16 bits; row 0 is for words that say nothing."""
        e = (self.e * self.trust)[1:]
        return [[np.concatenate([np.zeros((1, FILTERS), np.float32), e @ w[j]]).astype(np.float16) for j in range(n)] for n, w in zip(WIDTHS, self.w)]

    def rows(self, index: np.ndarray) -> np.ndarray:
        """The row of tables() for each bucket, from that of e."""
        return index.astype(np.int32)


def logits(model: dict, words: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The network's output for each text, from tables of bucket responses; words and texts as featured() has them, of any length."""
    if not len(counts):
        return np.zeros(0)
    starts = common.starts_of(counts + PAD)
    padded = np.zeros(starts[-1], np.int32)
    real = np.ones(starts[-1], bool)
    for k in range(PAD):
        real[starts[1:] - 1 - k] = False
    padded[real] = codes + 1
    parts = np.concatenate([np.zeros((1, words.shape[1]), np.int32), model["rows"][words]])
    of = lambda table: sum(table[parts[:, k]].astype(np.float32) for k in range(parts.shape[1]))
    tops = []
    for tables, b in zip(model["tables"], model["b"]):
        r = of(tables[0])[padded] + b
        for j in range(1, len(tables)):
            r[:-j] += of(tables[j])[padded[j:]]
        r[~real] = 0
        tops.append(np.maximum(np.maximum.reduceat(r, starts[:-1]), 0))
    return np.concatenate(tops, 1) @ model["out"] + model["bias"]


def outputs(params: np.ndarray, odds: np.ndarray, trust: np.ndarray, words: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """logits() of the network with these parameters (as Net.packed() has them) on texts as featured() has them."""
    e = embedded(odds, trust, words)
    net = Net(len(e), e=e).unpacked(params)
    own = np.arange(len(e), dtype=np.int32)
    return logits({"rows": own, "tables": net.tables(), "b": net.b, "out": net.out, "bias": net.bias}, own[1:, None], codes, counts)


def languages_of(table: np.ndarray, words: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The likeliest language of each text by its known words; the number of languages for a text without one."""
    if not table.shape[1] or not len(codes):
        return np.full(len(counts), table.shape[1])
    own = table[words[:, 0] % LANGS].astype(float)
    doc = np.repeat(np.arange(len(counts)), counts)
    votes = np.stack([np.bincount(doc, own[codes, j], minlength=len(counts)) for j in range(own.shape[1])], 1)
    return np.where(np.ptp(votes, axis=1) > 0, votes.argmax(1), table.shape[1])


def language_table(counts: np.ndarray) -> np.ndarray:
    """Log odds of each word bucket for each language, from its numbers of texts (languages x LANGS); a bucket without texts says nothing."""
    if not len(counts):
        return np.zeros((LANGS, 0), np.float16)
    p = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * LANGS))
    return np.where(counts.sum(0)[:, None] > 0, (p - p.mean(0)).T, 0).astype(np.float16)


def odds_of(n: np.ndarray, hits: np.ndarray, share: float, doubt: float, least_docs: int, part: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, trust) of each bucket that n rows have, `hits` of them toxic, where `share` of all are; rows count by `part`."""
    known, n, hits = n >= least_docs, n * part, hits * part
    share = min(max(share, 1e-6), 1 - 1e-6)
    own = (hits + share) / (n + 1)
    odds = np.log(own / share) - np.log((1 - own) / (1 - share))
    return np.where(known, odds, 0).astype(np.float16), (n / (n + doubt)).astype(np.float16)


def best_threshold(z: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """Halfway across the cut with the best F measure, of outputs z that n rows have, `hits` of them toxic; the middle of the widest such cut."""
    order = np.argsort(-z)
    caught = np.cumsum(hits[order])
    f = (1 + MISSED) * caught / (np.cumsum(n[order]) + MISSED * hits.sum())
    cuts = np.concatenate([z[order], [z.min() - 2.0]])
    good = np.flatnonzero(f >= f.max() - 1e-12)
    k = max(good, key=lambda i: cuts[i] - cuts[i + 1])
    return float((cuts[k] + cuts[k + 1]) / 2)


SLICES = "words binary, codes binary, counts binary, y binary, fold binary, l array<string>"
COUNTS = "name string, fold int, chunk int, at binary, n binary, hits binary"


def featured_rows(rows: DataFrame, folds: int) -> DataFrame:
    """rows (k, y, l, t) as a row a slice: featured(), labels, folds and languages of its texts."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                words, codes, counts = featured(part.column("t"))
                crc = np.array([zlib.crc32((k or "").encode()) for k in part.column("k").to_pylist()], np.int64)
                y = (part.column("y").to_numpy(zero_copy_only=False) > 0).astype(np.int8)
                binary = [words, codes.astype(np.int32), counts.astype(np.int64), y, ((crc * 2654435761 >> 16) % folds).astype(np.int8)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in binary), pa.array([part.column("l").to_pylist()], pa.list_(pa.string()))], names=["words", "codes", "counts", "y", "fold", "l"])

    return rows.mapInArrow(run, SLICES)


def _slices(batches):
    """(words, codes, counts, y, fold, languages) of each row of featured_rows()."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield (np.frombuffer(r["words"], np.int32).reshape(-1, 1 + len(STEMS)), *(np.frombuffer(r[c], t) for c, t in (("codes", np.int32), ("counts", np.int64), ("y", np.int8), ("fold", np.int8))), r["l"])


def counted(rows: DataFrame, folds: int) -> DataFrame:
    """COUNTS from featured_rows(): by fold, the rows with a bucket and the toxic ones of them; name is "" for all, else = and the language, "#" for rows in all."""

    def partial(batches):
        held: dict[tuple[str, int], np.ndarray] = {}
        for words, codes, counts, y, fold, langs in _slices(batches):
            ends = common.starts_of(counts)
            for a, b, label, k, lang in zip(ends[:-1], ends[1:], y, fold, langs):
                some = words[np.unique(codes[a:b])]
                for name, size, at in (("", BUCKETS, np.unique(some)), ("#", 1, np.zeros(1, int)), *([] if lang is None else [(f"={lang}", LANGS, some[:, 0] % LANGS)])):
                    if (name, k) not in held:
                        held[name, k] = np.zeros((2, size), np.int32)
                    np.add.at(held[name, k][0], at, 1)
                    if label:
                        np.add.at(held[name, k][1], at, 1)
        for (name, k), both in held.items():
            if name == "":
                both[:, 0] = 0  # what stems that a word doesn't have are
            for c in range(0, both.shape[1], CHUNK):
                n, hits = both[:, c : c + CHUNK]
                at = np.flatnonzero(n)
                if len(at):
                    yield _counts_row(name, int(k), c // CHUNK, at, n[at], hits[at])

    def total(key, table):
        n = np.zeros((2, CHUNK), np.int64)
        for r in table.to_pylist():
            at = np.frombuffer(r["at"], np.int16)
            n[0, at] += np.frombuffer(r["n"], np.int64)
            n[1, at] += np.frombuffer(r["hits"], np.int64)
        at = np.flatnonzero(n[0])
        return pa.Table.from_batches([_counts_row(*(x.as_py() for x in key), at, n[0, at], n[1, at])])

    return rows.mapInArrow(partial, COUNTS).groupBy("name", "fold", "chunk").applyInArrow(total, COUNTS)


def _counts_row(name: str, fold: int, chunk: int, at: np.ndarray, n: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    binary = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int16), n.astype(np.int64), hits.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([fold], pa.int32()), pa.array([chunk], pa.int32()), *binary], names=["name", "fold", "chunk", "at", "n", "hits"])


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", lang: str | None = None, most: int = 8_000, most_bytes: int = 24 << 20, epochs: int = 8, doubt: float = 4.0, folds: int = 2, least_labels: int = 12, least_docs: int = 1, rounds: int = 3, dealt: bool = False) -> dict | None:
    """Learns from all labelled rows, whatever their number and length.

    Tasks train on parts of about `most` rows and `most_bytes` of features (bounds of their memory); rows of one part go by
    `epochs` times in one task, of several parts once in each of `rounds` rounds, after which parameters are averaged.
    `dealt` says that rows stand in partitions by a hash already.
    The driver gets counts of 2^20 buckets, parameters, and the numbers of rows by output. Thresholds are set on the outputs of all rows, each by a
    network that its fold wasn't trained on; the one that scores learns from all. A bucket that df texts have
    counts by df / (df + `doubt`), so a word of few texts decides little by itself; one of under `least_docs` says nothing. `lang` names the rows' languages, to learn
    to tell them by their words. A language with fewer than `least_labels` toxic rows
    takes the threshold of all.
    """
    spark = labelled.sparkSession
    name = F.lit(None) if lang is None else F.col(f"`{lang}`")
    chosen = labelled.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{label}`").cast("int").alias("y"), name.cast("string").alias("l"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).where("y is not null")
    if not dealt:
        mixed = F.xxhash64(F.lit("part"), F.coalesce("k", "t"))
        tasks = max(1, -(-chosen.select("k", "y").count() // most))
        chosen = chosen.repartition(tasks, mixed).sortWithinPartitions(mixed, "y", F.xxhash64("t"))
    with common.scratch(spark):
        rows = common.written(featured_rows(chosen, folds), "labelled")
        return learned(rows, most, most_bytes, epochs, rounds, doubt, folds, least_labels, least_docs)


def learned(rows: DataFrame, most: int, most_bytes: int, epochs: int, rounds: int, doubt: float, folds: int, least_labels: int, least_docs: int) -> dict | None:
    """fit() on featured_rows()."""
    spark = rows.sparkSession
    tables: dict[str, np.ndarray] = {}
    for r in counted(rows, folds).toLocalIterator():
        size = {"": BUCKETS, "#": 1}.get(r["name"], LANGS)
        held = tables.setdefault(r["name"], np.zeros((folds, 2, size), np.int32))
        at = np.frombuffer(r["at"], np.int16).astype(int) + r["chunk"] * CHUNK
        held[r["fold"], 0, at], held[r["fold"], 1, at] = np.frombuffer(r["n"], np.int64), np.frombuffer(r["hits"], np.int64)
    if not tables:
        return None
    of_fold = tables["#"][:, :, 0].astype(float)
    both = of_fold.sum(0)
    if both[1] in (0, both[0]):
        return None
    buckets, names = tables.get("", np.zeros((folds, 2, BUCKETS), np.int32)), sorted(t for t in tables if t.startswith("="))
    # a fold without which one label is missing can't be kept out
    alone = [0 < (both - of_fold[k])[1] < (both - of_fold[k])[0] for k in range(folds)]
    rest = lambda t, k: t.sum(0) - (t[k] if k < folds and alone[k] else 0)
    # new rows' embeddings are as strong as those that the networks and thresholds are made on
    part = (folds - 1) / folds if all(alone) else 1.0
    odds = [odds_of(*rest(buckets, k), rest(of_fold, k)[1] / rest(of_fold, k)[0], doubt, least_docs, part if k == folds else 1.0) for k in range(folds + 1)]
    languages = [language_table(np.array([rest(tables[t], k)[0] for t in names])) for k in range(folds + 1)]
    del tables, buckets
    ratios = [(rest(of_fold, k)[0] - rest(of_fold, k)[1]) / rest(of_fold, k)[1] for k in range(folds + 1)]
    shared = spark.sparkContext.broadcast((odds[:folds], languages[:folds]))

    def trained(held: list, state: list, times: int) -> pa.RecordBatch:
        """Each network after `times` epochs on the rows of some slices that it may learn from."""
        vectors, texts, labels, own, size = [np.zeros((1, DIM), np.float16)], [], [], [], 1
        for words, codes, counts, y, fold, _ in held:
            ends = common.starts_of(counts)
            for k in np.unique(fold):
                some = np.flatnonzero(fold == k)
                used, place = np.unique(np.concatenate([codes[ends[i] : ends[i + 1]] for i in some]), return_inverse=True)
                vectors.append(embedded(*shared.value[0][k], words[used])[1:].astype(np.float16))
                texts += np.split((place + size).astype(np.int32), np.cumsum(counts[some])[:-1])
                size += len(used)
                labels.append(y[some])
                own.append(fold[some])
        e, y, fold = np.concatenate(vectors), np.concatenate(labels).astype(int), np.concatenate(own)
        del vectors
        out = []
        for k, start in enumerate(state):
            some = np.flatnonzero(fold != k) if k < folds and alone[k] else np.arange(len(y))
            if len(some):
                net = Net(len(e), e=e)
                if start is not None:
                    net.unpacked(start)
                net.train([texts[i] for i in some], y[some], times, ratios[k])
                out.append((k, len(some), net.packed().tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["net", "n", "params"])

    def round_of(state: list, times: int) -> list:
        def run(batches):
            held, n, size = [], 0, 0
            for one in _slices(batches):
                held, n, size = [*held, one], n + len(one[2]), size + one[0].nbytes + one[1].nbytes
                if n >= most or size >= most_bytes:
                    yield trained(held, state, times)
                    held, n, size = [], 0, 0
            if held:
                yield trained(held, state, times)

        got = parts.mapInArrow(run, "net int, n long, params binary").collect()
        weighed = lambda k: [(r["n"], np.frombuffer(r["params"], np.float32)) for r in got if r["net"] == k]
        return [np.average([p for _, p in own], axis=0, weights=[n for n, _ in own]).astype(np.float32) for own in map(weighed, range(folds + 1))]

    state: list = [None] * (folds + 1)
    single, parts = both[0] <= most, rows.coalesce(int(-(-both[0] // most)))
    for _ in range(1 if single else rounds):
        state = round_of(state, epochs if single else 1)

    def seen(batches):
        held: list[np.ndarray] = []
        for words, codes, counts, y, fold, _ in _slices(batches):
            z, language = np.zeros(len(y)), np.zeros(len(y), int)
            for k in np.unique(fold):
                z[fold == k] = outputs(state[k], *shared.value[0][k], words, codes, counts)[fold == k]
                language[fold == k] = languages_of(shared.value[1][k], words, codes, counts)[fold == k]
            held.append(np.stack([language, np.rint(np.clip(z, -50, 50) * STEPS).astype(np.int64), np.ones(len(y), np.int64), y.astype(np.int64)], 1))
        if held:
            each = pd.DataFrame(np.concatenate(held), columns=["language", "z", "n", "hits"]).groupby(["language", "z"], as_index=False).sum()
            yield pa.RecordBatch.from_pandas(each.astype("int64"), preserve_index=False)

    found = rows.mapInArrow(seen, "language long, z long, n long, hits long").groupBy("language", "z").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toPandas()
    shared.destroy()

    def threshold(some: pd.DataFrame) -> float:
        each = some.groupby("z")[["n", "hits"]].sum()
        return best_threshold(each.index.to_numpy() / STEPS, each["n"].to_numpy(), each["hits"].to_numpy())

    whole = threshold(found)
    groups = [found[found["language"] == j] for j in range(len(names))]
    cuts = [threshold(g) if g["hits"].sum() >= least_labels and (g["hits"] < g["n"]).any() else whole for g in groups]
    return {"params": state[folds], "odds": odds[folds][0], "trust": odds[folds][1], "languages": languages[folds], "thresholds": np.array([*cuts, whole])}


def scored(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    docs, text = common.beside(docs, text, ("score", "predicted"))
    schema, keep = docs.schema, docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in common.slices(batch, text):
                p = np.zeros(part.num_rows)
                if m is not None:
                    found = featured(part.column(text))
                    z = outputs(m["params"], m["odds"], m["trust"], *found).astype(float)
                    p = 1 / (1 + np.exp(-np.clip(z - m["thresholds"][languages_of(m["languages"], *found)], -50, 50)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*schema]).add("score", DoubleType()).add("predicted", IntegerType()))


def left(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, as they are."""
    plain, names = common.positional(docs)
    return common.named_back(scored(plain, model, names[text]).where("predicted = 0"), names)

"""Operator 13: document quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words each, and all of them are encoded: shares of
the words' shapes (letters, capitals, digits and signs, hashed) and of repeats,
lengths and kinds of characters go through one learned layer. Gated attention, a product of a tanh and a
sigmoid gate, gives each passage a weight within its document; the weighted sum of
the passages is scored by a linear layer. Only documents have labels, so the
attention learns by itself which passages decide. Trained in numpy on a bounded
sample of labelled rows; scored in Spark tasks. The cut comes from logits of folds that
weren't trained on, and the score puts it at `cut`.

Only the text enters a score. A null or empty text, or one of spaces only, is one passage without
features; repeated rows each get a row, an empty table none; with nothing to learn from
all scores are 0. Very long texts are scored whole, passages in blocks; one over a hundredth of `most_bytes`
isn't learned from. Further columns pass through; one that is named like a result
comes back as doc_<name>. Ids may be of any type.
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

PASSAGE, BUCKETS, HIDDEN, GATES = 48, 96, 24, 12
#: Numbers of a passage besides the shares of shapes.
NUMBERS = 9
WIDTH = BUCKETS + NUMBERS
#: Passages that are encoded at once.
BLOCK = 8192
#: Shapes of words: what stands for a run of letters or digits; a shape has at most so many characters.
SHAPES, LONGEST = [(r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")], 6


def word_facts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shape bucket, [length, letters, capitals, digits]) of each word."""
    shape = words
    for pattern, sign in SHAPES:
        shape = pc.replace_substring_regex(shape, pattern, sign)
    coded = pc.utf8_slice_codeunits(shape, 0, LONGEST).dictionary_encode()
    bucket = np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS for s in coded.dictionary.to_pylist()], dtype=np.int64)
    count = lambda pattern: pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    facts = np.stack([pc.utf8_length(words).to_numpy(zero_copy_only=False), count(r"\p{L}"), count(r"\p{Lu}"), count(r"\p{N}")], 1) if len(words) else np.zeros((0, 4))
    return bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64), facts.astype(float)


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether each key stood earlier in the list."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


class Bags:
    """The passages of texts: `per` has their number for each text; features() encodes some of them."""

    def __init__(self, texts: pa.Array):
        self.codes, words, counts = common.ascii_words(texts, lower=False)
        self.bucket, self.facts = word_facts(pa.array(words, pa.string()))
        self.per = np.maximum(1, -(-counts // PASSAGE))
        doc = np.repeat(np.arange(len(counts)), counts)
        starts = common.starts_of(counts)
        place = np.arange(len(self.codes)) - starts[doc]
        first = common.starts_of(self.per)
        self.passage = first[doc] + place // PASSAGE
        self.ends = np.searchsorted(self.passage, np.arange(first[-1] + 1))
        c, same = self.codes.astype(np.uint64), np.zeros(len(doc), bool)
        same[1:] = (self.codes[1:] == self.codes[:-1]) & (doc[1:] == doc[:-1])
        with np.errstate(over="ignore"):
            key = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k, odd in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)):
                key[: len(key) - 2] += c[k : len(c) - 2 + k] * np.uint64(odd)
        again = np.zeros(len(doc), bool)
        inner = np.flatnonzero(counts[doc] - place >= 3)
        again[inner] = seen_before(key[inner])
        self.flags = np.stack([same, seen_before(self.passage.astype(np.int64) << 32 | self.codes.astype(np.int64)), again], 1).astype(float)

    def features(self, start: int, end: int) -> np.ndarray:
        """(passages x WIDTH) of passages start to end."""
        part = slice(self.ends[start], self.ends[end])
        row, codes = self.passage[part] - start, self.codes[part]
        n = end - start
        size = np.bincount(row, minlength=n).astype(float)
        of = lambda v: np.bincount(row, v, minlength=n)
        shapes = np.bincount(row * BUCKETS + self.bucket[codes], minlength=n * BUCKETS).reshape(n, BUCKETS)
        length, letters, capitals, digits = (of(self.facts[codes, k]) for k in range(4))
        words, chars = np.maximum(size, 1), np.maximum(length, 1)
        numbers = [of(self.flags[part, k]) / words for k in range(3)]
        numbers += [np.minimum(length / words / 10, 3), of(self.facts[codes, 0] > 20) / words, np.log1p(size) / 4, (length - letters - digits) / chars, capitals / chars, digits / chars]
        return np.concatenate([shapes / words[:, None], np.stack(numbers, 1)], 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def attended(h: np.ndarray, e: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each passage's weight in its document, the documents' weighted sums); every document has a passage."""
    starts = common.starts_of(per)[:-1]
    doc = np.repeat(np.arange(len(per)), per)
    a = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    a /= np.add.reduceat(a, starts)[doc]
    return a, np.add.reduceat(a[:, None] * h, starts, axis=0)


class Net:
    """The model's parameters: encoder w1, b1; gates v, u and attention w; output w2, b2."""

    NAMES = ("w1", "b1", "v", "u", "w", "w2", "b2")

    def __init__(self, seed: int = 3):
        made = np.random.default_rng(seed)
        init = lambda *shape: made.standard_normal(shape) / np.sqrt(shape[0])
        self.p = {"w1": init(WIDTH, HIDDEN) * 3, "b1": np.zeros(HIDDEN), "v": init(HIDDEN, GATES), "u": init(HIDDEN, GATES), "w": init(GATES), "w2": init(HIDDEN), "b2": np.zeros(1)}

    def encoded(self, f: np.ndarray) -> tuple[np.ndarray, ...]:
        """(passage vectors, tanh gate, sigmoid gate, attention before the softmax)."""
        p = self.p
        h = np.tanh(f @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        return h, t, s, (t * s) @ p["w"]

    def logits(self, bags: Bags) -> np.ndarray:
        """The output for each text, its passages encoded in blocks."""
        n = int(bags.per.sum())
        h, e = np.zeros((n, HIDDEN), np.float32), np.zeros(n)
        for at in range(0, n, BLOCK):
            end = min(at + BLOCK, n)
            h[at:end], _, _, e[at:end] = self.encoded(bags.features(at, end))
        return attended(h, e, bags.per)[1] @ self.p["w2"] + self.p["b2"] if n else np.zeros(0)

    def gradients(self, f: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(weighted cross entropy, its gradients) of documents given by their passages' features."""
        p, doc, starts = self.p, np.repeat(np.arange(len(per)), per), common.starts_of(per)[:-1]
        h, t, s, e = self.encoded(f)
        a, z = attended(h, e, per)
        o = z @ p["w2"] + p["b2"]
        share = weight / weight.sum()
        loss = float((share * (np.logaddexp(0, o) - y * o)).sum())
        do = share * (sigmoid(o) - y)
        dz = do[:, None] * p["w2"]
        dh = a[:, None] * dz[doc]
        da = (dz[doc] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[doc])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh += dt @ p["v"].T + ds @ p["u"].T
        pre = dh * (1 - h * h)
        return loss, {"w1": f.T @ pre, "b1": pre.sum(0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ de, "w2": z.T @ do, "b2": np.array([do.sum()])}

    def train(self, bags: list[np.ndarray], y: np.ndarray, epochs: int, rate: float = 0.01, docs: int = 64, seed: int = 5) -> None:
        made = np.random.default_rng(seed)
        weight = np.where(y == 1, 1.0, np.clip((y == 1).sum() / max(1, (y == 0).sum()), 0.1, 10.0))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = made.permutation(len(bags))
            for at in range(0, len(order), docs):
                rows = order[at : at + docs]
                _, grads = self.gradients(np.concatenate([bags[i] for i in rows]), np.array([len(bags[i]) for i in rows]), y[rows], weight[rows])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest cut between logits that keeps most of both labels, by the mean of their shares."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order] == 1) / max(1, (y == 1).sum())
    kept = hits + 1 - np.cumsum(y[order] == 0) / max(1, (y == 0).sum())
    edges = np.append(z[order], z.min() - 2.0)
    good = np.flatnonzero(kept >= kept.max() - 1e-12)
    k = max(good, key=lambda i: edges[i] - edges[i + 1])
    return float((edges[k] + edges[k + 1]) / 2)


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", cut: float = 0.5, most: int = 6_000, most_bytes: int = 16 << 20, epochs: int = 12, folds: int = 3) -> dict | None:
    """Learns from at most about `most` labelled rows of about `most_bytes` of text in all (documented bounds of fitting; the features of their passages come to the driver, some 30 MB).

    The cut is where the logits of all rows, each from a model that its fold wasn't in, tell the labels best.
    """
    chosen = labelled.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{label}`").cast("int").alias("y"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    chosen = chosen.where(F.col("y").isNotNull() & (F.octet_length("t") <= most_bytes // 100))
    n, size = chosen.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    share = min(1.0, most / max(1, n), most_bytes / max(1, size or 0))
    rows = chosen if share == 1.0 else chosen.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("k")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                bags = Bags(part.column("t"))
                ends = common.starts_of(bags.per)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array([bags.features(a, b).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["k", "y", "f"])

    model = learned(rows.mapInArrow(run, "k string, y int, f binary").toPandas(), cut, epochs, folds)
    common.give_back()
    return model


def learned(sample: pd.DataFrame, cut: float, epochs: int, folds: int) -> dict | None:
    """fit() on its rows (k, y, f), on the driver."""
    sample = sample.sort_values(["k", "y", "f"], kind="stable").reset_index(drop=True)
    y = (sample["y"].to_numpy() > 0).astype(int)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in sample["f"]]
    fold = np.array([zlib.crc32(f"fold:{k}".encode()) % folds for k in sample["k"]])
    z = np.full(len(y), np.nan)
    for k in range(folds):
        held, train = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(held) and len(train) and y[train].min() < y[train].max():
            net = Net()
            net.train([bags[i] for i in train], y[train], epochs)
            z[held] = _outputs(net, [bags[i] for i in held])
    net = Net()
    net.train(bags, y, epochs)
    if np.isnan(z).any():
        z = _outputs(net, bags)
    return {"net": net, "shift": float(np.log(cut / (1 - cut))) - best_cut(z, y)}


def _outputs(net: Net, bags: list[np.ndarray]) -> np.ndarray:
    out = []
    for at in range(0, len(bags), 256):
        part = bags[at : at + 256]
        h, _, _, e = net.encoded(np.concatenate(part))
        out.append(attended(h, e, np.array([len(b) for b in part]))[1] @ net.p["w2"] + net.p["b2"])
    return np.concatenate(out)


def scored(docs: DataFrame, model: dict | None, text: str = "text", cut: float = 0.5) -> DataFrame:
    """docs with score and predicted (1 if the score is `cut` or more)."""
    docs, text = common.beside(docs, text, ("score", "predicted"))
    schema, keep = docs.schema, docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in common.slices(batch, text):
                p = np.zeros(part.num_rows)
                if m is not None:
                    p = sigmoid(m["net"].logits(Bags(part.column(text))) + m["shift"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*schema]).add("score", DoubleType()).add("predicted", IntegerType()))

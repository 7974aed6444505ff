"""Operator 1: language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability; a word's
likelihood is the sum over all its segmentations, found by a forward pass, and a
text's is the product over its words. Probabilities are learned by expectation
maximisation over the words of labelled documents: Spark counts the words per
language, each round sums expected piece counts per (language, piece).

A null text, or one without letters, is `und` with score 0. Repeated rows each
get a row, an empty table none; with nothing to learn from all rows are `und`. Of
equal likelihoods the language first in order is taken. Only `text` is read when
predicting; further columns pass through, one that is named like a result comes back
as doc_<name>.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from . import common, unigram

#: Longer words go by rescaled or logarithmic loops, a word at a time.
PART = 24
UNKNOWN_P = 1e-7
#: Numbers in a worker's memory of words.
CACHE_NUMBERS = 1_600_000
#: Languages that are learned and scored at once (a table of a number for each piece and language).
GROUP = 64


class Pieces:
    """Piece rows of words: for words of one length, the piece at each (start, length) or the last row for none."""

    def __init__(self, path: str):
        vocabulary = unigram.load(path)
        self.index = {vocabulary.pieces[i]: r for r, i in enumerate(vocabulary.normal)}
        self.size, self.longest = len(self.index), vocabulary.longest
        ranks = 1.0 / np.arange(1, self.size + 1)
        self.start = ranks / ranks.sum()

    def rows(self, words: list[str]) -> np.ndarray:
        n, get = len(words[0]), self.index.get
        most = min(n, self.longest)
        flat = [get(w[s : s + m], -1) if s + m <= n else -1 for w in words for s in range(n) for m in range(1, most + 1)]
        return np.array(flat, dtype=np.int32).reshape(len(words), n, most)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str], most: int = 4096):
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        n, end = len(words[order[start]]), start
        while end < len(order) and end - start < most and len(words[order[end]]) == n:
            end += 1
        yield n, order[start:end]
        start = end


def forward(rows: np.ndarray, p: np.ndarray, own: np.ndarray) -> np.ndarray:
    """alpha[word, position] of each word in its own language over pieces' rows; p has a last row of zeros, for no piece."""
    words, n, most = rows.shape
    alpha = np.zeros((words, n + 1))
    alpha[:, 0] = 1.0
    for s in range(n):
        alpha[:, s + 1] += np.where(rows[:, s, 0] >= 0, 0.0, alpha[:, s] * UNKNOWN_P)
        for m in range(1, min(most, n - s) + 1):
            r = rows[:, s, m - 1]
            if (r >= 0).any():
                alpha[:, s + m] += alpha[:, s] * p[r, own]
    return alpha


def long_word(word: str, table: Pieces, p: np.ndarray) -> np.ndarray:
    """Log likelihood of a word of any length, rescaled as it goes; memory is bounded by the longest piece."""
    ring = {0: np.ones(p.shape[1])}
    log = np.zeros(p.shape[1])
    for s in range(len(word)):
        here = ring.pop(s)
        top = here.max()
        if top < 1e-100:
            here, ring = here / top, {k: v / top for k, v in ring.items()}
            log += np.log(top)
        for m in range(1, min(table.longest, len(word) - s) + 1):
            r = table.index.get(word[s : s + m], -1)
            if r >= 0:
                ring[s + m] = ring.get(s + m, 0.0) + here * p[r]
            elif m == 1:
                ring[s + 1] = ring.get(s + 1, 0.0) + here * UNKNOWN_P
    return log + np.log(np.maximum(ring[len(word)], 1e-300)) if word else log


@functools.lru_cache(maxsize=2)
def matcher(path: str):
    """Aho-Corasick over the pieces: a match gives 32 * row + length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for piece, row in pieces(path).index.items():
        found.add_word(piece, 32 * row + len(piece))
    found.make_automaton()
    return found


def short_words(words: list[str], found, p: np.ndarray) -> np.ndarray:
    """The forward pass of words of up to PART characters, by end position for all words at once: likelihoods (words x languages)."""
    keys: list[int] = []
    for i, w in enumerate(words):
        base = i << 40
        keys.extend([base + (at << 32) + v for at, v in found.iter(w)])
    match = np.array(keys, dtype=np.int64)
    n, languages = len(words), np.arange(p.shape[1])
    lens = np.array([len(w) for w in words])
    word, at, row, length = match >> 40, match >> 32 & 255, (match & 0xFFFFFFFF) >> 5, match & 31
    unknown = np.full((PART + 1, n), UNKNOWN_P)
    unknown[at[length == 1], word[length == 1]] = 0.0
    order = np.argsort(at.astype(np.uint8), kind="stable")
    ends = np.searchsorted(at[order], np.arange(PART + 1))
    # alpha has a row for each (position, word); a match adds its start's row to its end's
    start, into, weight = ((at + 1 - length) * n + word)[order], word[order], np.take(p, row[order], 0)
    alpha = np.zeros(((PART + 1) * n, len(languages)))
    alpha[:n] = 1.0
    for e in range(int(lens.max(initial=0))):
        some = slice(ends[e], ends[e + 1])
        part = np.take(alpha, start[some], 0) * weight[some]
        got = np.bincount((into[some, None] * len(languages) + languages).ravel(), part.ravel(), minlength=alpha[:n].size)
        alpha[(e + 1) * n : (e + 2) * n] = got.reshape(n, -1) + unknown[e][:, None] * alpha[e * n : (e + 1) * n]
    return alpha[lens * n + np.arange(n)]


def log_likelihoods(words: list[str], path: str, p: np.ndarray) -> np.ndarray:
    """A row of log p(word | language) for each word."""
    found, table = matcher(path), pieces(path)
    out = np.zeros((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= PART]
    for k in range(0, len(short), 4096):
        some = short[k : k + 4096]
        out[some] = np.log(np.maximum(short_words([words[i] for i in some], found, p), 1e-300))
    for i, w in enumerate(words):
        if len(w) > PART:
            out[i] = long_word(w, table, p)
    return out


def long_counts(word: str, table: Pieces, p: np.ndarray) -> tuple[list[int], list[float]]:
    """(pieces, expected counts) of one word of any length under probabilities p of one language, by logarithms."""
    n, most, get = len(word), table.longest, table.index.get
    rows = [[get(word[s : s + m], -1) for m in range(1, min(most, n - s) + 1)] for s in range(n)]
    with np.errstate(divide="ignore"):
        cost = [np.array([np.log(p[r]) if r >= 0 else np.log(UNKNOWN_P) if m == 0 else -np.inf for m, r in enumerate(own)]) for own in rows]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0], beta[n] = 0.0, 0.0
    for s in range(n):
        to = slice(s + 1, s + 1 + len(cost[s]))
        alpha[to] = np.logaddexp(alpha[to], alpha[s] + cost[s])
    for s in range(n - 1, -1, -1):
        beta[s] = np.logaddexp.reduce(cost[s] + beta[s + 1 : s + 1 + len(cost[s])])
    pieces_, times = [], []
    for s in range(n):
        share = np.exp(alpha[s] + cost[s] + beta[s + 1 : s + 1 + len(cost[s])] - alpha[n])
        for r, c in zip(rows[s], share):
            if r >= 0 and c > 0:
                pieces_.append(r)
                times.append(float(c))
    return pieces_, times


def expected(words: list[str], language: np.ndarray, count: np.ndarray, table: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected piece counts [language, piece] of counted words, by a forward and a backward pass."""
    at_, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
    for n, group in by_length(words):
        if not n:
            continue
        if n > PART:
            for i in group:
                found, times = long_counts(words[i], table, p[:, language[i]])
                at_.append(language[i] * (table.size + 1) + np.array(found, np.int64))
                counts.append(count[i] * np.array(times))
            continue
        rows = table.rows([words[i] for i in group])
        own, times = language[group], count[group].astype(float)
        alpha = forward(rows, p, own)
        beta = np.zeros_like(alpha)
        beta[:, n] = 1.0
        for s in range(n - 1, -1, -1):
            beta[:, s] += np.where(rows[:, s, 0] >= 0, 0.0, beta[:, s + 1] * UNKNOWN_P)
            for m in range(1, min(rows.shape[2], n - s) + 1):
                beta[:, s] += p[rows[:, s, m - 1], own] * beta[:, s + m]
        whole = np.maximum(alpha[:, n], 1e-300)
        for s in range(n):
            for m in range(1, min(rows.shape[2], n - s) + 1):
                r = rows[:, s, m - 1]
                got = r >= 0
                if got.any():
                    c = (times * alpha[:, s] * p[r, own] * beta[:, s + m] / whole)[got]
                    at_.append(own[got] * (table.size + 1) + r[got])
                    counts.append(c)
    total = np.bincount(np.concatenate(at_), np.concatenate(counts), minlength=p.shape[1] * (table.size + 1))
    return total.reshape(p.shape[1], -1)[:, :-1]


def marked(words: list[str]) -> list[str]:
    return [unigram.MARK + w for w in words]


def word_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n)."""

    def count(batches):
        for batch in batches:
            for part in common.slices(batch, text):
                codes, words, counts = common.ascii_words(part.column(text), lower=False)
                langs = part.column(lang).dictionary_encode()
                doc = np.repeat(langs.indices.to_numpy(zero_copy_only=False), counts)
                keys, n = np.unique(doc.astype(np.int64) * max(1, len(words)) + codes, return_counts=True)
                names = langs.dictionary.to_pylist()
                rows = [(names[k // len(words)], unigram.MARK + words[k % len(words)], int(c)) for k, c in zip(keys.tolist(), n.tolist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counted = labelled.select(text, lang).mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", vocabulary: str | None = None, rounds: int = 2, most: int = 8_000, smoothing: float = 2000.0) -> dict:
    """Learns from at most about `most` labelled documents (a documented bound of fitting).

    Languages are learned GROUP by GROUP; the model has the expected counts of pieces that a language's
    words may hold, so it grows with the sample and not with pieces times languages.
    """
    path = vocabulary or unigram.default_path()
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = common.written(word_counts(common.hash_share(known, key, most), text, lang), "lang-words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())  # at most one a row of the sample
    model = {"id": uuid.uuid4().hex, "path": path, "languages": languages, "smoothing": smoothing, "groups": [None] * -(-len(languages) // GROUP)}
    for g in range(len(model["groups"])):
        names = languages[g * GROUP : (g + 1) * GROUP]
        own = counts.where(F.col("lang").isin(names)) if len(languages) > GROUP else counts
        for _ in range(rounds):
            model["groups"][g] = _round(own, names, path, dense(model, g))
    common.deleted(labelled.sparkSession, [counts._written_at])
    return model


def dense(model: dict, group: int) -> np.ndarray:
    """Probabilities (pieces and a row of zeros, for no piece, x languages) of a group of languages."""
    start, names = pieces(model["path"]).start, model["languages"][group * GROUP : (group + 1) * GROUP]
    p = np.repeat(start[:, None], len(names), 1)
    if model["groups"][group] is not None:
        piece, own, n = model["groups"][group]
        c = np.zeros_like(p)
        c[piece, own] = n
        p = (c + model["smoothing"] * p) / (c.sum(0) + model["smoothing"])
    return np.vstack([p, np.zeros(len(names))])


def _round(counts: DataFrame, names: list[str], path: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, language, expected count) of counted words under probabilities p."""
    shared = counts.sparkSession.sparkContext.broadcast((names, p))

    def count(batches):
        names_, q = shared.value
        at = {x: i for i, x in enumerate(names_)}
        total = np.zeros((len(names_), q.shape[0] - 1))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                own = np.array([at[x] for x in part.column(0).to_pylist()], dtype=np.int64)
                total += expected(part.column(1).to_pylist(), own, part.column(2).to_numpy(zero_copy_only=False), pieces(path), q)
        own, piece = np.nonzero(total > 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[own, piece])], names=["language", "piece", "n"])

    summed = counts.select("lang", "word", "n").mapInArrow(count, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).orderBy("language", "piece").toPandas()
    shared.unpersist()
    return summed["piece"].to_numpy(), summed["language"].to_numpy(), summed["n"].to_numpy()


_cache: dict = {"model": None, "words": {}, "rows": [], "chars": 0, "p": None}


def _table(model: dict, group: int) -> np.ndarray:
    """dense() of the group that this worker used last."""
    if _cache["model"] != (model["id"], group):
        _cache.update(model=(model["id"], group), words={}, rows=None, chars=0, p=dense(model, group))
    return _cache["p"]


def _word_rows(words: list[str], model: dict, group: int) -> np.ndarray:
    """log_likelihoods with a bounded memory of words seen by this worker."""
    p = _table(model, group)
    if _cache["rows"] is None or len(_cache["words"]) * p.shape[1] > CACHE_NUMBERS or _cache["chars"] > common.MEMORY_CHARS:
        _cache.update(words={}, rows=np.zeros((0, p.shape[1]), np.float32), chars=0)
    seen = _cache["words"]
    new = [w for w in words if w not in seen]
    if new:
        seen.update(zip(new, range(len(seen), len(seen) + len(new))))
        _cache["chars"] += sum(map(len, new))
        _cache["rows"] = np.concatenate([_cache["rows"], log_likelihoods(marked(new), model["path"], p).astype(np.float32)])
    return _cache["rows"][[seen[w] for w in words]].astype(np.float64)


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of that language under equal priors). Groups of languages are scored one by one and their best and sums combined, which is exact."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, text = common.beside(docs, text, ("lang_pred", "score"))
    keep = docs.columns
    schema = StructType([*docs.schema]).add("lang_pred", StringType()).add("score", DoubleType())

    def score(batches):
        m = shared.value
        names = m["languages"]
        for batch in batches:
            for part in common.slices(batch, text):
                texts = pc.fill_null(part.column(text), "")
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                n = part.num_rows
                top, whole, best = np.full(n, -np.inf), np.zeros(n), np.zeros(n, np.int64)
                codes, words, counts = common.ascii_words(texts, lower=False)
                doc = np.repeat(np.arange(n), counts)
                for g in range(len(m["groups"])):
                    rows = _word_rows(words, m, g)
                    log = np.stack([np.bincount(doc, rows[codes, j], minlength=n) for j in range(rows.shape[1])], 1) if len(codes) else np.zeros((n, rows.shape[1]))
                    now = log.max(1)
                    best = np.where(now > top, g * GROUP + log.argmax(1), best)
                    high = np.maximum(top, now)
                    whole, top = whole * np.exp(top - high) + np.exp(log - high[:, None]).sum(1), high
                real = letters & (len(names) > 0)
                named = np.where(real, np.array([*names, ""], dtype=object)[best], "und")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(named, type=pa.string()), pa.array(np.where(real, 1 / np.maximum(whole, 1e-300), 0.0))], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)

"""Operator 5: MinHash near-duplicates with sequential Bayesian verification.

1. A document's set: its distinct `shingle`-word shingles (all words as one, if
   fewer; nothing without words). One pass over the texts gives each document the
   set's size, a fingerprint of the set and a MinHash signature.
2. Documents with equal sets are one class; its smallest id stands for it.
3. Signatures are cut into bands; classes that agree in a band are candidates. In
   each band's bucket only one member, the head, meets all others (a star), so a
   bucket of n gives n - 1 pairs. Where members are still in different components
   afterwards, the pairs between components follow if they are few for the bucket.
   Members of other buckets are dealt out anew by those of their rarest shingles that
   two similar sets must have one in common of; buckets that are hard even so meet
   block by block, as sets, in tasks that hand out links only.
4. Signatures of a pair are compared batch by batch; after each, the pair goes if
   the posterior chance that its similarity reaches the threshold is under `miss`.
   Survivors are confirmed on the full sets of both texts.
5. Links join to components by repeated smallest-neighbour steps.

Very long texts count with all their shingles. A null or empty text, or one of spaces only, has an empty set and is linked with
nothing. Rows are told apart by an own key, so rows that repeat an id or have none
are rows of their own. A component is named by its smallest id, null if it has
none; exactly one row of it is kept: of the smallest id, rows without one last. Ids
may be of any ordered type. Only id and text are read: further columns don't take
part, whatever their names. An empty table gives no rows. Sets are compared by 64-bit hashes of their
shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = (85, 100)  # intersection * 100 >= union * 85
BANDS, ROWS = 24, 7
MISS = 1e-4
#: A bucket's pairs between components are listed if they are up to this many times its members; else its members meet in blocks.
EASY = 8
BLOCK, BLOCK_BYTES = 128, 2 << 20
#: Shares of the table by which elements are ordered, rare ones first (a number each comes to the driver).
SHARES = 1 << 20
#: Up to so many ids (8 bytes each) are broadcast.
BROADCAST_IDS = 200_000
BATCH = 24
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal bits in, spread bits out."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles, repeats included, shingles per text)."""
    import xxhash

    codes, words, counts = common.ascii_words(texts)
    own = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    h = own[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    starts = common.starts_of(counts)[:-1]
    at = np.arange(n.sum()) - np.repeat(common.starts_of(n)[:-1] - starts, n)
    short = np.repeat(counts < shingle, n)
    out = np.zeros(len(at), np.uint64)
    width = np.where(short, np.repeat(counts, n), shingle)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            use = k < width
            out = np.where(use, mixed(out * np.uint64(31) + np.uint64(k + 1) + h[np.where(use, at + k, 0)]) if len(h) else out, out)
    return out, n


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each list, and their number."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[first], np.bincount(d[first], minlength=len(counts)).astype(np.int64)


def coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(seed)
    return made.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), made.integers(0, 2**32, n, dtype=np.uint32)


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """MinHash signatures (lists x n) of non-empty lists; empty ones get zeros."""
    out = np.zeros((len(counts), n), np.uint32)
    some = counts > 0
    starts = common.starts_of(counts)[:-1][some]
    if len(starts):
        low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for i, (a, b) in enumerate(zip(*coefficients(n))):
                x = low * a + (high ^ b)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                out[some, i] = np.minimum.reduceat(x, starts)
    return out


def summarised(docs: DataFrame, doc_id: str, text: str, shingle: int, n: int) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sig) of each row."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                h, c = distinct_sets(*shingle_hashes(part.column("text"), shingle))
                sig = signatures(h, c, n)
                with np.errstate(over="ignore"):
                    ends, m = common.starts_of(c), mixed(h)
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (m, mixed(m ^ M2))]
                    f1, f2 = (s[ends[1:]] - s[ends[:-1]] for s in sums)
                raw = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((np.arange(len(c) + 1) * 4 * n).astype(np.int32).tobytes()), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), raw], names=["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary")


def least_matches(n: int, t: float, miss: float) -> int:
    """The fewest of n equal values at which the similarity may reach t: below, its posterior chance (flat prior) is under miss."""
    chance = 0.0  # of similarity >= t given m matches: P(Bin(n + 1, t) <= m)
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if chance >= miss:
            return m
    return n


def bayes(pairs: DataFrame, threshold: tuple[int, int], miss: float, batch: int) -> DataFrame:
    """Pairs (a, b) from (a, b, n_a, n_b, sig_a, sig_b) that sizes and signatures leave possible."""
    per, of = threshold

    def run(batches):
        for part in batches:
            for at in range(0, part.num_rows, 2048):
                s = part.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(s.column(c).to_pylist()), np.uint32).reshape(s.num_rows, -1) for c in ("sig_a", "sig_b"))
                na, nb = (s.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
                alive = np.flatnonzero(of * np.minimum(na, nb) >= per * np.maximum(na, nb))
                same = np.zeros(s.num_rows, np.int64)
                for start in range(0, x.shape[1], batch):
                    end = min(start + batch, x.shape[1])
                    same[alive] += (x[alive, start:end] == y[alive, start:end]).sum(1)
                    alive = alive[same[alive] >= least_matches(end, per / of, miss)]
                yield pa.RecordBatch.from_arrays([pc.take(s.column(c), pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) among (a, b, text_a, text_b), by the full sets."""
    per, of = threshold

    def run(batches):
        for part in batches:
            for s in common.slices(part, "text_a", "text_b"):
                sets = [distinct_sets(*shingle_hashes(s.column(c), shingle)) for c in ("text_a", "text_b")]
                (x, nx), (y, ny) = sets
                doc = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                h = np.concatenate([x, y])
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                twice = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
                both = np.bincount(doc[1:][twice], minlength=len(nx))
                good = pa.array(np.flatnonzero((of * both >= per * (nx + ny - both)) & (both > 0)))
                yield pa.RecordBatch.from_arrays([pc.take(s.column(c), good) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for each id in a link.

    Each round, all neighbours of a node are linked to the smallest of them (large
    ones first, then small ones), until links form stars.
    """
    edges = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:  # the smallest ids only ever move on to neighbours, so rounds end
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # tables, so that a node of many links can be dealt to several tasks
        least = common.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = common.written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = common.written(small, "links")
        now = state(edges)
        if now == before:
            break
        before = now
    return common.written(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")


def joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after further links between ids of known components; ids without a link so far may be in links."""
    own = known.select(F.col("id").alias("_id"), "component")
    for side in ("a", "b"):
        links = links.join(own, F.col(side) == F.col("_id"), "left").withColumn(side, F.coalesce("component", side)).drop("_id", "component")
    above = components(links).select(F.col("id").alias("component"), F.col("component").alias("_top"))
    moved = known.join(above, "component", "left").select("id", F.coalesce("_top", "component").alias("component"))
    new = above.join(known.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("_top").alias("component"))
    return common.written(moved.unionByName(new), "components")


def _pairs_with(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with columns of table (by id) for both sides."""
    for side in ("a", "b"):
        own = table.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        pairs = pairs.join(own, side)
    return pairs


class Search:
    """Candidates to links, for one set of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, doc_id: str, text: str, shingle: int, threshold: tuple[int, int], miss: float):
        self.shingle, self.threshold, self.miss = shingle, threshold, miss
        self.numbered = classes.select("id", F.col("n_shingles").alias("n"), "sig")
        self.docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def texts(self, ids: DataFrame) -> DataFrame:
        """Few ids go to the texts, else the texts are dealt out by id."""
        return common.written(self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), "texts")

    @staticmethod
    def some(links: DataFrame) -> DataFrame | None:
        found = common.written(links, "links")
        return found if found.limit(1).count() else None

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """The links among candidate pairs (a, b), written; None if there are none."""
        left = common.written(bayes(_pairs_with(pairs, self.numbered, ["n", "sig"]), self.threshold, self.miss, BATCH), "survivors")
        ids = common.written(left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct(), "ids")
        if not ids.count():
            return None
        texts = self.texts(ids)
        return self.some(confirmed(_pairs_with(left, texts, ["text"]), self.shingle, self.threshold))

    def stars_and_rest(self, shared: DataFrame, final: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(final, hard): components after the stars of all buckets and the pairs of easy ones, and the buckets that stay hard."""
        found = self.links(stars(shared))
        final = final if found is None else joined(final, found)
        easy, hard = divided(shared, final)
        found = self.links(across(easy))
        return (final if found is None else joined(final, found)), hard

    def hard(self, hard: DataFrame, final: DataFrame) -> DataFrame:
        """final after the links in hard buckets: their members are dealt out anew by the rarest shingles that similar sets must share, and what is hard even so meets in blocks."""
        ids = common.written(hard.select("id").distinct(), "ids")
        if not ids.count():
            return final
        sets = common.written(sets_of(self.texts(ids), self.shingle), "sets")
        final, left = self.stars_and_rest(buckets(common.written(prefixes(sets, self.threshold), "prefixes")), final)
        found = self.some(blocked(left, sets, self.threshold))
        return final if found is None else joined(final, found)


def buckets(members: DataFrame) -> DataFrame:
    """(key, id, a, n) of the keys that n > 1 ids have. a, the head, is the id that meets the most others in all its buckets: the text that copies were made from is nearer to each than they are to each other.

    Sizes and heads are written, so that a large bucket can be dealt to several tasks.
    """
    sizes = common.written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = common.written(members.join(sizes, "key"), "shared")
    met = common.written(shared.groupBy("id").agg(F.sum("n").alias("met")), "met")
    heads = shared.join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("_i")))["_i"].alias("_a"))
    return common.written(shared.join(common.written(heads.select("key", (-F.col("_a")).alias("a")), "heads"), "key"), "buckets")


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def stars(shared: DataFrame) -> DataFrame:
    """Pairs of each bucket's head with its others."""
    return shared.where("id <> a").select(*ordered("a", "id")).distinct()


def divided(shared: DataFrame, final: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(easy, hard): buckets whose members are in several components, with component, the bucket's largest component `_main` and the head's component.

    In an easy one the pairs between components are few for its size.
    """
    own = common.written(shared.join(final, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    per = own.groupBy("key", "component").agg(F.count("*").alias("_n"), F.max("n").alias("_all"))
    cross = (F.max("_all") * F.max("_all") - F.sum(F.col("_n") * F.col("_n"))) / 2
    open_ = common.written(per.groupBy("key").agg(F.max_by("component", F.struct("_n", "component")).alias("_main"), cross.alias("_cross")).where("_cross > 0"), "open")
    both = common.written(own.join(open_, "key"), "open-buckets")
    return both.where(F.col("_cross") <= EASY * F.col("n")), both.where(F.col("_cross") > EASY * F.col("n"))


def across(easy: DataFrame) -> DataFrame:
    """All pairs between components in a bucket: one of a pair isn't in the largest."""
    x = easy.where("component <> _main").select("key", F.col("id").alias("x"), F.col("component").alias("_c"))
    y = easy.select("key", F.col("id").alias("y"), F.col("component").alias("_d"), (F.col("component") == F.col("_main")).alias("_in"))
    return x.join(y, "key").where("_c <> _d and (_in or x < y)").select(*ordered("x", "y")).distinct()


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, size, s): the distinct shingle hashes of each text of (id, text), sorted, as bytes."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                h, n = distinct_sets(*shingle_hashes(part.column("text"), shingle))
                ends = common.starts_of(n)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array([h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())], names=["id", "size", "s"])

    return texts.mapInArrow(run, "id long, size long, s binary")


def times_of(sets: DataFrame) -> np.ndarray:
    """How many elements of all sets fall into each of SHARES shares of the hashes."""

    def run(batches):
        total = np.zeros(SHARES, np.int64)
        for batch in batches:
            for s in batch.column("s").to_pylist():
                np.add.at(total, np.frombuffer(s, np.uint64) % np.uint64(SHARES), 1)
        share = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), pa.array(total[share])], names=["share", "times"])

    found = sets.mapInArrow(run, "share int, times long").groupBy("share").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(SHARES, np.int64)
    out[found.column("share").to_numpy()] = found.column("times").to_numpy()
    return out


def prefixes(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(id, key): the rarest elements of each set that two sets of the threshold's similarity must share one of.

    Of two sets so similar, at least share * n elements of each are in both; so the
    first n - ceil(share * n) + 1 of each in one order of all elements have one in
    common. The order is by how full an element's share of the hashes is, a table of fixed size, so what many texts have in
    common seldom counts; an element alone in its share is in no other set.
    """
    per, of = threshold
    times = sets.sparkSession.sparkContext.broadcast(times_of(sets).astype(np.int32))

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for i, s in zip(batch.column("id").to_pylist(), batch.column("s").to_pylist()):
                h = np.frombuffer(s, np.uint64)
                often = times.value[h % np.uint64(SHARES)]
                first = np.lexsort((h, often))[: len(h) - -(-len(h) * per // of) + 1]
                keys.append(h[first[often[first] > 1]])
                ids.append(np.full(len(keys[-1]), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))], names=["id", "key"])

    return sets.mapInArrow(run, "id long, key long")


def blocked(hard: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links between components in large buckets, on full sets: each two blocks of a bucket's members, of BLOCK sets and BLOCK_BYTES at most on average, meet in a task, and only links leave it."""
    per, of = threshold
    held = hard.join(sets.select("id", "size"), "id").groupBy("key").agg(F.count("*").alias("_sets"), (8 * F.sum("size")).alias("_bytes"))
    many = held.select("key", F.ceil(F.greatest(F.col("_sets") / BLOCK, F.col("_bytes") / BLOCK_BYTES)).cast("int").alias("_blocks"))
    placed = hard.select("key", "id", "component").join(many, "key").withColumn("_b", F.pmod(F.xxhash64("id"), "_blocks").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = placed.select("key", "id", "component", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y")).join(sets.select("id", "s"), "id")

    def run(pdf):
        sets_ = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
        n = np.array([len(s) for s in sets_], dtype=np.int64)
        h, doc = np.concatenate(sets_), np.repeat(np.arange(len(n)), n)
        _, code, times = np.unique(h, return_inverse=True, return_counts=True)
        doc, code = doc[times[code] > 1], code[times[code] > 1]
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        doc, code = doc[order], code[order]
        both = np.zeros((len(n), len(n)), np.float32)
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            part = slice(np.searchsorted(code, start), np.searchsorted(code, start + 4096))
            m = np.zeros((len(n), 4096), np.float32)
            m[doc[part], code[part] - start] = 1
            both += m @ m.T
        component = pdf["component"].to_numpy()
        x, y = np.nonzero((of * both.astype(np.float64) >= per * (n[:, None] + n[None] - both.astype(np.float64))) & (component[:, None] != component[None]))
        ids = pdf["id"].to_numpy()
        good = ids[x] < ids[y]
        return pd.DataFrame({"a": ids[x[good]], "b": ids[y[good]]})

    return dealt.groupBy("key", "_x", "_y").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    rows_ = common.numbered(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "rows")
    return grouped(rows_, shingle=shingle, threshold=threshold, bands=bands, rows=rows, miss=miss).drop("_row")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """near_duplicates() of rows that have `_row`, with it."""
    with common.scratch(docs.sparkSession) as keep:
        placed = common.written(components_of_rows(docs, "_row", text, **how), "placed")
        names = docs.select("_row", F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
        named = keep(common.written(placed.join(names, "_row"), "named"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "_h", "_row"))
        # a table, so that a large component can be dealt to several tasks
        heads = keep(common.written(named.groupBy("component").agg(first.alias("_head")).select("component", F.col("_head.doc_id").alias("component_id"), F.col("_head._row").alias("_kept")), "component-heads"))
    return named.join(heads, "component").select("_row", "doc_id", "n_shingles", "component_id", (F.col("_row") == F.col("_kept")).alias("kept"))


def components_of_rows(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(_row, n_shingles, component) for each row of docs, by a key that no two rows share."""
    n = bands * rows
    every = common.written(summarised(docs, doc_id, text, shingle, n), "signatures")
    sets = ["n_shingles", "fp1", "fp2"]
    filled = every.where("n_shingles > 0")
    named = common.written(filled.groupBy(*sets).agg(F.min("doc_id").alias("id"), F.count("*").alias("n_docs")).where("id is not null"), "classes")
    # a class's signature is that of the document that stands for it
    classes = named.select(*sets, "id").join(every.select(F.col("doc_id").alias("id"), *sets, "sig"), ["id", *sets]).dropDuplicates(["id"])
    classes = common.written(classes, "class-signatures")
    search = Search(docs, classes, doc_id, text, shingle, threshold, miss)
    key = lambda band: F.xxhash64(F.lit(band), F.substring(F.col("sig"), 4 * rows * band + 1, 4 * rows))
    banded = classes.select("id", F.array(*(key(b) for b in range(bands))).alias("keys"))
    final, hard = search.stars_and_rest(buckets(banded.select("id", F.explode("keys").alias("key"))), named.select("id", F.col("id").alias("component")))
    final = search.hard(hard, final)
    place = named.join(final, "id", "left").select(*sets, F.coalesce("component", "id").alias("component_id"))
    placed = every.drop("sig").join(place, sets, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select(F.col("doc_id").alias("_row"), "n_shingles", component.alias("component"))

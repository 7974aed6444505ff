"""Shared values of column pairs, by one inverted index on (view, signature)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import written
from .melt import to_text

#: Pairs that a task compares at once.
PAIRS = 512
VIEWS = ("raw", "date", "amount", "pan", "padded", "prefix", "token")
#: Words of 63 bits that a signature's columns and views may take in the index of a dictionary.
WORDS = 8


def signatures(d: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """(side, col_idx, view, sig), distinct: each column's values in the views asked for; only those are made."""
    some = V.signature_views(d.where("value is not null").select("side", "col_idx", "value"), "value", views)
    one = F.array(*(F.struct(F.lit(k).alias("view"), F.col(f"v_{k}").cast("string").alias("sig")) for k in views if k != "token"))
    if "token" in views:
        one = F.concat(one, F.transform(V.tokens(F.col("value")), lambda t: F.struct(F.lit("token").alias("view"), t.alias("sig"))))
    made = some.select("side", "col_idx", F.inline(one)).where(F.col("sig").isNotNull())
    return made if views == ("raw",) else made.distinct()  # values of the dictionary are distinct already


def sizes(s: DataFrame) -> DataFrame:
    return s.groupBy("side", "col_idx", "view").agg(F.count("*").alias("size"))


def shared(s: DataFrame) -> DataFrame:
    """(side_a, col_a, side_b, col_b, view, shared): signatures that two columns share. A signature's columns are as few as the tables' columns, so no row skews."""
    held = s.groupBy("view", "sig").agg(F.collect_list(F.struct("side", "col_idx")).alias("cols")).where(F.size("cols") > 1)
    pairs = held.select("view", F.explode("cols").alias("a"), "cols").select("view", "a", F.explode("cols").alias("b")).where("a < b")
    return pairs.groupBy(F.col("a.side").alias("side_a"), F.col("a.col_idx").alias("col_a"), F.col("b.side").alias("side_b"), F.col("b.col_idx").alias("col_b"), "view").agg(F.count("*").alias("shared"))


def overlaps(s: DataFrame) -> DataFrame:
    """shared() with sizes, coverage of both columns, Jaccard and overlap ratio."""
    return _measured(shared(s), sizes(s))


def dictionary_overlaps(d: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """overlaps(signatures(d, views)) of a dictionary that is a table of its own.

    Most values have themselves as signature in most views. So a row of the index is a
    signature with a bit for each column and view that has it; signatures of equal bits are counted together
    before pairs are made. Tables too wide for that take signatures one by one.
    """
    columns = sorted(tuple(r) for r in d.select("side", "col_idx").distinct().collect())  # metadata
    fit = 63 // len(views)
    words = -(-len(columns) // fit)
    if not 0 < words <= WORDS:
        return overlaps(signatures(d, views))
    spark, bit = d.sparkSession, {k: 1 << i for i, k in enumerate(views)}
    places = [(*c, i // fit, 1 << (i % fit * len(views))) for i, c in enumerate(columns)]
    unit = spark.createDataFrame(places, "side string, col_idx int, word int, unit long")
    v = F.col("value")
    some = V.parted(V.signature_views(d.where(v.isNotNull()).select("side", "col_idx", "value").join(F.broadcast(unit), ["side", "col_idx"]), "value", views))
    own = {k: F.col(f"v_{k}").cast("string") for k in views if k != "token"}
    same = reduce(lambda a, b: a + b, (F.when(c == v, bit[k]).otherwise(0) for k, c in own.items()), F.lit(0))
    alone = F.col("_alone")
    if "token" in views:
        some, same = some.withColumn("_alone", V.is_token(v)), same + F.when(alone, bit["token"]).otherwise(0)
    one = F.array(F.struct(v.alias("sig"), same.alias("m")), *(F.struct(F.when(c != v, c).alias("sig"), F.lit(bit[k]).alias("m")) for k, c in own.items() if k != "raw"))
    if "token" in views:
        some, t = some.withColumn("_t", F.when(alone, F.array().cast("array<string>")).otherwise(V.tokens(v))), F.col("_t")
        one = F.concat(one, F.arrays_zip(t, F.array_repeat(F.lit(bit["token"]), F.size(t))).cast("array<struct<sig:string,m:int>>"))
    rows = some.select("word", "unit", F.inline(one)).where(F.col("sig").isNotNull() & (F.col("m") > 0))
    held = [f"w{i}" for i in range(words)]
    bits = rows.groupBy("sig").agg(*(F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("m") * F.col("unit"))), F.lit(0)).alias(w) for i, w in enumerate(held)))
    counted = bits.groupBy(*held).agg(F.count("*").alias("n"))
    each = spark.createDataFrame([(side, c, k, w, u * bit[k]) for side, c, w, u in places for k in views], "side string, col_idx int, view string, word int, mask long")
    has = F.get(F.array(*held), F.col("word")).bitwiseAND(F.col("mask")) != 0
    kinds = counted.crossJoin(F.broadcast(each)).where(has).groupBy(*held, "view").agg(F.max("n").alias("n"), F.collect_list(F.struct("side", "col_idx")).alias("cols"))
    kinds = written(kinds, "shared-columns")
    pairs = kinds.select("view", "n", F.explode("cols").alias("a"), "cols").select("view", "n", "a", F.explode("cols").alias("b")).where("a < b")
    both = pairs.groupBy(F.col("a.side").alias("side_a"), F.col("a.col_idx").alias("col_a"), F.col("b.side").alias("side_b"), F.col("b.col_idx").alias("col_b"), "view").agg(F.sum("n").alias("shared"))
    return _measured(both, kinds.select(F.inline("cols"), "view", "n").groupBy("side", "col_idx", "view").agg(F.sum("n").alias("size")))


def _measured(shared_: DataFrame, n: DataFrame) -> DataFrame:
    a, b = (n.select(F.col("side").alias(f"side_{x}"), F.col("col_idx").alias(f"col_{x}"), "view", F.col("size").alias(f"size_{x}")) for x in "ab")
    return shared_.join(a, ["side_a", "col_a", "view"]).join(b, ["side_b", "col_b", "view"]).select(
        "side_a", "col_a", "side_b", "col_b", "view", "shared", "size_a", "size_b", (F.col("shared") / F.col("size_a")).alias("coverage_a"), (F.col("shared") / F.col("size_b")).alias("coverage_b"),
        (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("size_a", "size_b")).alias("overlap_ratio"),
    )


def numbers(d: DataFrame) -> DataFrame:
    """Mean and population deviation of a column's numbers; null value texts are left out.

    Two passes over the dictionary: the second takes squares about the first's mean and
    corrects that by what is left over, so large numbers close together lose nothing.
    """
    keys, cnt = ["side", "col_idx"], F.col("cnt")
    x = d.select(*keys, "cnt", F.when(F.col("value").rlike(V.NUMBER), F.col("value").try_cast("double")).alias("x"))
    some = x.where(F.col("x").isNotNull())
    rough = some.groupBy(*keys).agg(F.sum("cnt").alias("n"), (F.sum(F.col("x") * cnt) / F.sum("cnt")).alias("_m"))
    off = F.col("x") - F.col("_m")
    about = some.join(F.broadcast(rough), keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("_m").alias("_m"), (F.sum(off * cnt) / F.max("n")).alias("_left"), (F.sum(off * off * cnt) / F.max("n")).alias("_sq"))
    moments = about.select(*keys, "n", (F.col("_m") + F.col("_left")).alias("mean"), F.sqrt(F.greatest(F.col("_sq") - F.col("_left") * F.col("_left"), F.lit(0.0))).alias("std"))
    return x.select(*keys).distinct().join(F.broadcast(moments), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def numeric_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(col_a, col_b, numeric): likeness of two columns' distributions; column statistics only meet here."""
    x = a.select(F.col("col_idx").alias("col_a"), F.col("n").alias("_na"), F.col("mean").alias("_ma"), F.col("std").alias("_sa"))
    y = b.select(F.col("col_idx").alias("col_b"), F.col("n").alias("_nb"), F.col("mean").alias("_mb"), F.col("std").alias("_sb"))
    gap = (F.abs(F.col("_ma") - F.col("_mb")) + F.abs(F.col("_sa") - F.col("_sb"))) / (2 * F.greatest(F.abs("_ma"), F.abs("_mb"), F.lit(1.0)))
    value = F.when((F.col("_na") < 5) | (F.col("_nb") < 5), 0.0).otherwise(1 - F.least(F.lit(1.0), gap))
    return x.crossJoin(F.broadcast(y)).select("col_a", "col_b", value.alias("numeric"))


def value_similarity(over: DataFrame, numeric: DataFrame, sizes_: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """(col_a, col_b, score, reasons): 0 to 100 of overlap, Jaccard, prefixes and distribution, and what speaks for it or takes from it (fixed texts and limits)."""
    wide = over.where((F.col("side_a") == a) & (F.col("side_b") == b)).groupBy("col_a", "col_b").agg(*(F.coalesce(F.max(F.when(F.col("view") == v, F.col(m))), F.lit(0.0)).alias(n) for n, v, m in (("_o", "raw", "overlap_ratio"), ("_j", "raw", "jaccard"), ("_p", "prefix", "jaccard"))))
    raw = sizes_.where("view = 'raw'")
    n = lambda side, name: raw.where(F.col("side") == side).select(F.col("col_idx").alias(f"col_{name}"), F.col("size").alias(f"_n{name}"))
    full = numeric.join(wide, ["col_a", "col_b"], "left").join(n(a, "a"), "col_a", "left").join(n(b, "b"), "col_b", "left").na.fill(0, ["_o", "_j", "_p", "_na", "_nb"])
    score = (F.col("_o") * 45 + F.col("_j") * 25 + F.col("_p") * 10 + F.col("numeric") * 20) * F.when((F.col("_na") < 5) | (F.col("_nb") < 5), 0.85).otherwise(1.0)
    reasons = F.array_compact(F.array(
        F.when(F.col("_o") > 0.8, "High normalized value overlap").when(F.col("_o") > 0.45, "Partial value overlap found"), F.when(F.col("numeric") > 0.65, "Numeric distribution appears aligned"),
        F.when(F.col("_p") > 0.5, "Common value prefix/suffix patterns detected"), F.when((F.col("_na") < 5) | (F.col("_nb") < 5), "Low distinct value volume; confidence reduced"),
    ))
    return full.select("col_a", "col_b", F.least(F.lit(100.0), F.floor(score + 0.5)).cast("double").alias("score"), reasons.alias("reasons"))


def row_misses(df: DataFrame, pairs: list[tuple[int, int]], allowed: float | None = None) -> DataFrame:
    """(a, b, misses, n): for each pair of columns (by place) the rows in which their normal values differ, null being null's equal, in one scan.

    Cells go by as one long column, row after row, so plans don't grow with the columns and each
    cell is normalized once. Tasks count all pairs at once and leave a pair that misses more than
    `allowed` rows already; its count only says so then.
    """
    used = sorted({c for p in pairs for c in p})
    fields = [df.schema[c] for c in used]
    wide = df.select(*(to_text(F.col(f"`{f.name}`"), f.dataType).alias(str(i)) for i, f in enumerate(fields)))
    cells = V.with_cell(wide.unpivot([], wide.columns, "_c", "_raw").select("_raw"), "_raw", "value")
    a, b = (np.array([used.index(p[k]) for p in pairs], np.int64) for k in (0, 1))
    c, most = len(used), allowed if allowed is not None else float("inf")

    def run(batches):
        misses, n, rest = np.zeros(len(a), np.int64), 0, pa.array([], pa.string())
        alive = np.arange(len(a))
        for batch in batches:
            values = pa.concat_arrays([rest, batch.column("value").cast(pa.string())])
            whole = len(values) // c * c
            codes = values.slice(0, whole).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, c)
            rest, n = values.slice(whole), n + len(codes)
            for at in range(0, len(alive), PAIRS):
                some = alive[at : at + PAIRS]
                misses[some] += (codes[:, a[some]] != codes[:, b[some]]).sum(0)
            alive = alive[misses[alive] <= most]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.arange(len(a)), misses, np.full(len(a), n))], names=["pair", "misses", "n"])

    counted = cells.mapInArrow(run, "pair long, misses long, n long").groupBy("pair").agg(F.sum("misses").alias("misses"), F.sum("n").alias("n"))
    named = df.sparkSession.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "pair long, a int, b int")
    return named.join(counted, "pair", "left").select("a", "b", F.coalesce("misses", F.lit(0)).alias("misses"), F.coalesce("n", F.lit(0)).alias("n"))


def rows_equal(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, share): share of rows in which two columns' normal values agree, null with null; 0 without rows."""
    places = {name: i for i, name in enumerate(df.columns)}
    names = F.array(*map(F.lit, df.columns))
    return row_misses(df, [(places[x], places[y]) for x, y in pairs]).select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), F.coalesce(1 - F.try_divide("misses", "n"), F.lit(0.0)).alias("share"))

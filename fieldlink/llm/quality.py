"""Operator 9 [native]: quality rules and robust multivariate outliers.

Base rules count words, repeats and symbols of each text. Then each group of
language and source gets a minimum-covariance-determinant estimate of location and
scatter of its documents' transformed statistics: from three starts, concentration
steps refit on the half of the group that lies nearest until the determinant stops
falling, and the smallest determinant stays. Documents at a far Mahalanobis distance
are rejected; how far follows from the chi-squared distribution.

Statistics are whole numbers (fixed point) and documents of equal statistics are
counted together first, so sums are exact, medians come from counts and results
don't depend on the order of rows. A group's estimate is drawn to that of all
documents, the more the fewer it has. Only DataFrame operations run.

A null text has no words and fails; very long texts are counted whole. Null languages and sources are groups of
their own. Repeated rows each count. Further columns pass through; one that is named
like a result comes back as doc_<name>. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT = 256  # fixed point: 1.0 of a statistic
#: No statistic is taken to spread less than this: half a unit. Most texts have no symbol or repeat at all, and a few then aren't far.
FLOOR = UNIT / 2.0
#: Logarithms of mean word length, symbols a word, repeated words a word and words.
STATS = ("z_len", "z_sym", "z_rep", "z_words")
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
#: The chance of a squared distance beyond which a document is rejected: of 10^12 clean ones about one would be.
TAIL = 1e-12
#: Up to so many groups, of some 300 bytes each, are broadcast.
BROADCAST_GROUPS = 100_000


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    keep = [f"`{c}`" for c in docs.columns if c not in own]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # explode(array(x)) holds x as computed once; a lambda would compute it for each element
    step = docs.select(*keep, F.explode(F.array(F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))).alias("_h"))
    windows = "if(size(_h) < 3, cast(array() as array<bigint>), slice(zip_with(zip_with(_h, slice(_h, 2, size(_h)), (a, b) -> xxhash64(a, b)), slice(_h, 3, size(_h)), (p, c) -> xxhash64(p, c)), 1, size(_h) - 2))"
    step = step.select(*keep, F.size("_h").cast("long").alias("n_words"), F.explode(F.array(F.expr(windows))).alias("_w"))
    # (hash, place) in order: a window that equals a neighbour is found twice or more
    step = step.withColumn("_s", F.expr("if(size(array_distinct(_w)) = size(_w), cast(array() as array<struct<h:bigint,p:int>>), sort_array(transform(_w, (x, i) -> struct(x as h, i as p))))"))
    step = step.select(*keep, "n_words", F.explode(F.array(F.col("_s"))).alias("_s"))
    # places of such windows in order; each covers three words, less where the next begins
    twice = "zip_with(_s, zip_with(concat(array(cast(null as struct<h:bigint,p:int>)), slice(_s, 1, greatest(size(_s) - 1, 0))), slice(_s, 2, greatest(size(_s), 1)), (a, b) -> struct(a.h as a, b.h as b)), (x, n) -> if(x.h <=> n.a or x.h <=> n.b, x.p, null))"
    step = step.select(*keep, "n_words", F.explode(F.array(F.expr(f"if(size(_s) = 0, cast(array() as array<int>), sort_array(array_compact({twice})))"))).alias("_p"))
    covered = "aggregate(_p, named_struct('n', 0L, 'end', -1), (s, p) -> named_struct('n', s.n + p + 3 - greatest(p, s.end), 'end', p + 3), s -> s.n)"
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    bare = F.regexp_replace(t, SPACE, "")
    return step.select(
        *keep, "n_words", F.char_length(bare).cast("long").alias("word_chars"), (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.explode(F.array(lines)).alias("_l"), F.expr(covered).alias("n_repeat_words"),
    ).select(*keep, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.col("n_repeat_words").cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics() -> list[Column]:
    """Transformed statistics in fixed point, in the order of STATS."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    fixed = lambda c: F.round(c * UNIT).cast("long")
    return [
        fixed(F.log2((F.col("word_chars") + 1) / n) * 4),
        fixed(F.log2(1 + 1000 * F.col("n_symbols") / n) / 2),
        fixed(F.log2(1 + 100 * F.col("n_repeat_words") / n) / 2),
        fixed(F.log2(n)),
    ]


def _spread() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def chi_squared(p: float, tail: float) -> float:
    """The value that a chi-squared variable of len(STATS) = 4 degrees exceeds with chance `tail`, or stays under with chance `p`."""
    upper = lambda x: math.exp(-x / 2) * (1 + x / 2)
    low, high, aim = 0.0, 2000.0, tail if p is None else 1 - p
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > aim else (low, mid)
    return low


def _few(df: DataFrame) -> DataFrame:
    """df, a written table of a row a group, for a broadcast if its rows are proven few; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


MEANS, LOWER = [f"m_{i}" for i in range(len(STATS))], [f"l_{i}_{j}" for i, j in _spread()]
SCATTER = [f"v_{i}_{j}" for i, j in _spread()]


def _factored(scatter: DataFrame, by: list[str]) -> DataFrame:
    """by, n, MEANS and SCATTER with LOWER, the lower Cholesky factor, and logdet, the logarithm of the scatter's determinant."""
    steps = []
    for i, j in _spread():
        rest = " - ".join([f"v_{i}_{j}", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))])
        steps.append(f"sqrt(greatest({rest}, 1.0D)) AS l_{i}_{j}" if i == j else f"({rest}) / l_{j}_{j} AS l_{i}_{j}")
    logdet = " + ".join(f"2 * ln(l_{i}_{i})" for i in range(len(STATS)))
    return scatter.selectExpr(*by, "n", *MEANS, *SCATTER, *steps, f"{logdet} AS logdet")


def _distance(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep and d2, the squared Mahalanobis distance, of rows with MEANS and LOWER: |y|^2 where L y = x - m."""
    steps = ["(" + " - ".join([f"{s} - m_{i}", *(f"l_{i}_{k} * y_{k}" for k in range(i))]) + f") / l_{i}_{i} AS y_{i}" for i, s in enumerate(STATS)]
    return rows.selectExpr(*keep, *steps, " + ".join(f"y_{i} * y_{i}" for i in range(len(STATS))) + " AS d2").select(*keep, "d2")


def _moments(rows: DataFrame, by: list[str], values: list[str], ridge: float = 0.0) -> DataFrame:
    """by, n, MEANS and SCATTER of whole numbers that stand for _n rows each, from exact sums; `ridge` is added to variances."""
    sums = [F.expr(f"sum({s} * _n) AS s_{i}") for i, s in enumerate(values)]
    crosses = [F.expr(f"sum({values[i]} * {values[j]} * _n) AS c_{i}_{j}") for i, j in _spread()]
    scatter = [f"c_{i}_{j} / double(n) - (s_{i} / double(n)) * (s_{j} / double(n)){f' + {ridge}D' if i == j else ''} AS v_{i}_{j}" for i, j in _spread()]
    return rows.groupBy(*by).agg(F.sum("_n").alias("n"), *sums, *crosses).selectExpr(*by, "n", *(f"s_{i} / double(n) AS m_{i}" for i in range(len(STATS))), *scatter)


def starts(cells: DataFrame, hint) -> DataFrame:
    """Three starts of each group: medians and median deviations, each statistic by itself; the same with the common movement of
    tanh-bounded scores; plain mean and scatter. Medians come from counts of equal values, which tasks add up first."""
    k = range(len(STATS))
    mid = cells.groupBy("_group").agg(*(F.expr(f"percentile({s}, 0.5, _n) AS med_{i}") for i, s in enumerate(STATS)))
    off = cells.join(hint(mid), "_group").groupBy("_group").agg(*(F.expr(f"greatest(percentile(abs({s} - med_{i}), 0.5, _n) * 1.4826D, {FLOOR}D) AS w_{i}") for i, s in enumerate(STATS)))
    centre = common.written(mid.join(off, "_group"), "medians")
    bounded = cells.join(hint(centre), "_group").selectExpr("_group", "_n", *(f"cast(round(tanh(({s} - med_{i}) / w_{i}) * 1024) AS long) AS t_{i}" for i, s in enumerate(STATS)))
    shape = _moments(bounded, ["_group"], [f"t_{i}" for i in k]).selectExpr("_group", "n", *(f"{v} AS t{v}" for v in SCATTER))
    both = shape.join(centre, "_group")
    med = [f"med_{i} AS m_{i}" for i in k]
    first = both.selectExpr("_group", "0 AS _start", "n", *med, *(f"{f'w_{i} * w_{i}' if i == j else '0.0D'} AS v_{i}_{j}" for i, j in _spread()))
    second = both.selectExpr("_group", "1 AS _start", "n", *med, *(f"w_{i} * w_{j} * {'1.0D' if i == j else f'tv_{i}_{j} / sqrt(greatest(tv_{i}_{i} * tv_{j}_{j}, 1.0D))'} AS v_{i}_{j}" for i, j in _spread()))
    third = _moments(cells, ["_group"], list(STATS), FLOOR * FLOOR).withColumn("_start", F.lit(2))
    return common.written(_factored(first.unionByName(second).unionByName(third), ["_group", "_start"]), "mcd")


def _bin() -> str:
    """A squared distance as a whole number, in steps of a 256th of its logarithm, so that a median is one of counted values."""
    return "cast(floor(log2(1 + d2) * 256) AS int)"


def concentrated(cells: DataFrame, fits: DataFrame, hint) -> DataFrame:
    """A concentration step of each fit: location and scatter of the half of its group that lies nearest. fits is written."""
    by = ["_group", "_start"]
    near = _distance(cells.join(hint(fits.select(*by, *MEANS, *LOWER)), "_group"), [*by, *STATS, "_n"]).selectExpr(*by, *STATS, "_n", f"{_bin()} AS _bin")
    half = near.groupBy(*by).agg(F.expr("percentile(_bin, 0.5, _n) AS _cut"))
    return _factored(_moments(near.join(hint(half), by).where("_bin <= _cut"), by, list(STATS), FLOOR * FLOOR), by)


def fit(cells: DataFrame, settled: float = 0.01) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group: (_group, n, MEANS, SCATTER), the scatter scaled to be consistent.

    cells: (_group, STATS, _n), written. Each start takes two concentration steps; the
    one of the smallest determinant goes on until no group's determinant falls by more
    than a share of `settled`. Rows stay where they are, only counts and sums move.
    """
    few = cells.select("_group").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    hint = lambda df: F.broadcast(df) if few else df  # noqa: E731  at most three rows a group
    fields = ["_group", "_start", "n", *MEANS, *SCATTER, *LOWER, "logdet"]
    smallest = lambda fits, *more: common.written(fits.groupBy("_group").agg(F.expr(f"min_by(struct({', '.join(fields)}), struct(logdet, _start)) AS _b"), *more).select("_b.*", *(["_fell"] if more else [])), "mcd")
    best, falling = smallest(concentrated(cells, common.written(concentrated(cells, starts(cells, hint), hint), "mcd"), hint)), True
    while falling:
        both = best.select(*fields, F.lit(0).alias("_new")).unionByName(concentrated(cells, best, hint).withColumn("_new", F.lit(1)))
        best = smallest(both, F.expr("max(if(_new = 0, logdet, null)) - min(logdet) AS _fell"))
        falling = best.where(F.col("_fell") > settled).limit(1).count() > 0
    median = _distance(cells.join(hint(best.select("_group", *MEANS, *LOWER)), "_group"), ["_group", "_n"]).groupBy("_group").agg(F.expr(f"percentile({_bin()}, 0.5, _n) AS _mid"), F.sum("_n").alias("n"))
    # the half's scatter is too small: scale it so that the median distance is the chi-squared median
    scale = f"greatest((pow(2.0D, (_mid + 0.5D) / 256) - 1) / {chi_squared(0.5, 0)}D, 1.0D)"
    return common.written(best.drop("n").join(hint(median), "_group").selectExpr("_group", "n", *MEANS, *(f"{v} * {scale} AS {v}" for v in SCATTER)), "mcd")


POOLED = "pooled"


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with the counts, base_failed, the statistics and _own, the name of the document's group."""
    out = measured(docs, text).withColumn("base_failed", base_failed())
    for s, c in zip(STATS, statistics()):
        out = out.withColumn(s, c)
    return out.withColumn("_own", F.to_json(F.struct(F.col(f"`{lang}`").alias("l"), F.col(f"`{source}`").alias("s"))))


def estimates(rows: DataFrame, weight: float = 50.0) -> DataFrame:
    """(_group, m_i, l_i_j) of each group of documents that pass the base rules, and of all of them as POOLED.

    A group's estimate is drawn to the pooled one, which counts as `weight` documents:
    so a group of any size has one, a small one mostly that of all.
    """
    each = rows.where(~F.col("base_failed")).select(F.explode(F.array("_own", F.lit(POOLED))).alias("_group"), *STATS)
    found = fit(common.written(each.groupBy("_group", *STATS).agg(F.count("*").alias("_n")), "quality-cells"))
    all_ = found.where(F.col("_group") == POOLED).selectExpr(*(f"{p} AS p_{p}" for p in [*MEANS, *SCATTER]))
    mixed = [f"_w * m_{i} + (1 - _w) * p_m_{i} AS m_{i}" for i in range(len(STATS))]
    mixed += [f"_w * v_{i}_{j} + (1 - _w) * p_v_{i}_{j} + _w * (1 - _w) * (m_{i} - p_m_{i}) * (m_{j} - p_m_{j}) AS v_{i}_{j}" for i, j in _spread()]
    drawn = found.withColumn("_w", F.expr(f"if(_group = '{POOLED}', 1.0D, n / (n + {float(weight)}D))")).crossJoin(F.broadcast(all_))  # all_ is one row
    return common.written(_factored(drawn.selectExpr("_group", "n", *mixed), ["_group"]).select("_group", *MEANS, *LOWER), "mcd")


def verdicts(rows: DataFrame, fitted: DataFrame, cut: float) -> DataFrame:
    """counted() rows with distance (null if no document passed the base rules) and kept, without the statistics."""
    others = [c for c in rows.columns if c not in ("_own", *STATS)]
    pooled = fitted.where(F.col("_group") == POOLED).first()
    named = _few(fitted.where(F.col("_group") != POOLED)).select(F.col("_group").alias("_own"), *(F.col(c).alias(f"o_{c}") for c in [*MEANS, *LOWER]))
    own = rows.join(named, "_own", "left").select(*others, *STATS, *(F.coalesce(f"o_{c}", F.lit(pooled and pooled[c]).cast("double")).alias(c) for c in [*MEANS, *LOWER]))
    far = _distance(own, others)
    return far.select(*others, F.col("d2").alias("distance"), (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).alias("kept"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL, weight: float = 50.0) -> DataFrame:
    """docs without the text, with the counts, base_failed, distance (squared, robust) and kept.

    A document is rejected if a normal one would be as far with a chance under `tail`. Texts are read once.
    """
    plain, names = common.positional(docs)
    rows = common.written(counted(plain, *(names[c] for c in (text, lang, source))).drop(names[text]), "quality")
    out = verdicts(rows, estimates(rows, weight), chi_squared(None, tail))
    given = common.cleared(docs.drop(text).limit(0), RESULTS).columns
    back = [F.col(new).alias(g) for (c, new), g in zip(((c, n) for c, n in names.items() if c != text), given)]
    return out.select(*back, *RESULTS)


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL, weight: float = 50.0) -> DataFrame:
    """The rows of docs that judged() keeps, as they are. They are written once with their counts, so texts are gone through once."""
    plain, names = common.positional(docs)
    rows = common.written(counted(plain, *(names[c] for c in (text, lang, source))), "quality")
    return common.named_back(verdicts(rows, estimates(rows, weight), chi_squared(None, tail)).where("kept"), names)

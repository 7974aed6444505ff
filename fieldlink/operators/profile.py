"""Column profiles from the value dictionary (side, col_idx, value, cnt, first_pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import written

KEYS = ["side", "col_idx"]


def _share(condition: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.when(condition, F.col("cnt")).otherwise(0)), n), F.lit(0.0))


def shapes(d: DataFrame) -> DataFrame:
    """(side, col_idx, value, cnt, most, n): values that differ in their digits alone as one, with 0 for each digit, their number and their cells.

    No kind of value asks which digit one is, but for codes of two digits; so texts of up to four characters stay as they are.
    """
    v = F.col("value")
    shape = F.when(F.length(v) > 4, F.translate(v, "123456789", "000000000")).otherwise(v)
    return d.groupBy(*KEYS, shape.alias("value")).agg(F.sum("cnt").alias("cnt"), F.max("cnt").alias("most"), F.count("*").alias("n"))


def profile(d: DataFrame) -> DataFrame:
    """A row for each column: counts, ratios and the share of each kind of value among those that aren't null. Kinds are told by shapes()."""
    d, v, cnt = shapes(d), F.col("value"), F.col("cnt")
    n_distinct = F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0))
    n = F.sum(F.when(v.isNotNull(), cnt))
    p = V.predicates(v)
    shares = [_share(p[k], n).alias(f"r_{k}") for k in p]
    more = {
        "integer": v.rlike(r"^[-+]?\d+$"), "decimal": v.rlike(r"^[-+]?\d*\.\d+$"), "date_like": v.rlike(r"\d{2,4}[/-]\d{1,2}[/-]\d{1,2}"), "datetime_like": v.rlike(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"),
        "text_like": v.rlike("[A-Za-z]{3,}"), "uppercase": v == F.upper(v), "masked_like": v.rlike("[*xX#]"),
    }
    return d.groupBy(*KEYS).agg(
        F.sum(cnt).alias("n_rows"), F.coalesce(n, F.lit(0)).alias("n_values"), n_distinct.alias("n_distinct"),
        F.coalesce(F.try_divide(F.sum(F.when(v.isNull(), cnt).otherwise(0)), F.sum(cnt)), F.lit(1.0)).alias("null_ratio"),
        F.coalesce(F.try_divide(n_distinct, n), F.lit(0.0)).alias("uniqueness_ratio"),
        F.coalesce(F.try_divide(n - n_distinct, n), F.lit(0.0)).alias("repeated_ratio"),
        F.coalesce(F.min(F.length(v)), F.lit(0)).alias("min_length"), F.coalesce(F.max(F.length(v)), F.lit(0)).alias("max_length"), F.coalesce(F.try_divide(F.sum(F.length(v) * cnt), n), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.try_divide(F.max(F.when(v.isNotNull(), F.col("most"))), n), F.lit(0.0)).alias("top_share"),
        *shares, *(_share(c, n).alias(f"r_{k}") for k, c in more.items()),
    )


def top_values(d: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each column with their share; ties by first occurrence."""
    some = d.where(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("cnt").desc(), "first_pos", "value"))
    totals = some.groupBy(*KEYS).agg(F.sum("cnt").alias("_n"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).join(totals, KEYS).select(*KEYS, "rank", "value", "cnt", (F.col("cnt") / F.col("_n")).alias("ratio"))


def first_distinct(d: DataFrame, k: int = 8) -> DataFrame:
    """The first k distinct values of each column in row order, and the pattern hints they give."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("first_pos", "value"))
    some = d.where(F.col("value").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)
    return some.groupBy(*KEYS).agg(F.expr("transform(array_sort(collect_list(struct(rank, value))), x -> x.value)").alias("sample"))


def hints(profiled: DataFrame, sample: DataFrame) -> DataFrame:
    joined = profiled.join(sample, KEYS, "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))
    has = lambda pattern: F.exists("sample", lambda x: x.rlike(pattern))
    return joined.withColumn("pattern_hints", F.array_compact(F.array(F.when(F.col("uniqueness_ratio") > 0.9, "mostly_unique"), F.when(F.col("null_ratio") > 0.5, "sparse"), F.when(has(V.NUMBER), "contains_numeric"), F.when(has("[A-Za-z]{3,}"), "contains_text"))))


def record(cells: DataFrame, names: DataFrame) -> DataFrame:
    """The whole profile of each column, from cells and columns(): counts, ratios and types, top values, samples, hints and the normalization score."""
    from . import melt, types

    d = written(melt.dictionary(cells), "dictionary")
    base = hints(profile(d), first_distinct(d)).join(names.select("side", "col_idx", "col_id", "original_name", "normalized_name"), KEYS)
    typed = base.withColumn("observed_type", types.observed_type()).withColumn("column_type", types.column_type())
    ordered = lambda fields: F.expr(f"transform(array_sort(collect_list(struct(rank, {fields}))), x -> named_struct({', '.join(f'{chr(39)}{f}{chr(39)}, x.{f}' for f in fields.split(', '))}))")
    top = top_values(d).groupBy(*KEYS).agg(ordered("value, cnt, ratio").alias("top_frequent"))
    first = written(first_values(cells).coalesce(1), "first-values")  # k rows a column
    listed = first.groupBy(*KEYS).agg(ordered("value, folded").alias("first_values"))
    score = normalization_score(first).select(*KEYS, F.col("score").alias("normalization_score"), F.col("level").alias("normalization_level"))
    return typed.join(top, KEYS, "left").join(listed, KEYS, "left").join(score, KEYS, "left").withColumn("normalization_level", F.coalesce("normalization_level", F.lit("none")))


def first_values(cells: DataFrame, k: int = 50) -> DataFrame:
    """The first k values of each column in row order: (side, col_idx, rank, value, folded).

    A cell has a value exactly where its text is none of the null words; so the rank limit comes
    first, in part before the shuffle, and only k cells of a column are normalized.
    """
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("row_idx"))
    first = cells.where(V.has_value(F.col("raw"))).withColumn("rank", rank).where(F.col("rank") <= k)
    return V.with_cell(first, "raw", "value").select(*KEYS, "rank", "value", F.lower(F.trim("value")).alias("folded"))


def normalization_score(first: DataFrame) -> DataFrame:
    """How much a column's first values need cleaning: spread of formats, mix of types and share of dirty values."""
    v = F.col("value")
    spread = lambda c, name: first.groupBy(*KEYS, c.alias("_c")).agg(F.count("*").alias("_n")).groupBy(*KEYS).agg((1 - F.max("_n") / F.sum("_n")).alias(name))
    dirty = first.groupBy(*KEYS).agg(F.avg(V.is_dirty(v).cast("double")).alias("dirty_value"))
    out = spread(V.format_class(v), "format_difference").join(spread(V.type_class(v), "mixed_type"), KEYS).join(dirty, KEYS)
    out = out.withColumn("score", 0.4 * F.col("format_difference") + 0.3 * F.col("mixed_type") + 0.3 * F.col("dirty_value"))
    return out.withColumn("level", F.when(F.col("score") > 0.4, "strong").when(F.col("score") >= 0.2, "light").otherwise("none"))

"""Tables to value dictionaries: one shuffle from cells to distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V


def _shortest(x: Column, own: Column) -> Column:
    """The shortest text that reads back as the double x, or its own text if that is no longer than any."""
    # up to 15 digits tell a double: nothing shorter reads back as it. Beyond, the JVM's text may have a digit too many
    tried = [F.format_string(f"%.{n}e", x) for n in (14, 15)]
    return F.when(F.length(own) <= 16, own).otherwise(F.coalesce(*(F.when(t.try_cast("double") == x, t) for t in tried), own))


def _unscaled(t: Column) -> Column:
    """A number's text without an exponent, by which its point moves, and without zeros at the end of its fraction."""
    low = F.lower(t)
    number, dot = F.substring_index(low, "e", 1), F.lit(".")
    digits = F.replace(number, dot, F.lit(""))
    at = F.length(F.substring_index(number, ".", 1)) + F.when(low.contains("e"), F.substring_index(low, "e", -1).cast("int")).otherwise(0)
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    left = F.when(at > 0, F.concat(F.substring(digits, F.lit(1), at), zeros(at - F.length(digits)))).otherwise("0")
    right = F.concat(zeros(-at), F.substring(digits, F.greatest(at, F.lit(0)) + 1, F.length(digits)))
    # trimmed, not by a pattern, which would try each zero of a long run anew
    return F.rtrim(F.rtrim(F.concat(left, dot, right), F.lit("0")), dot)


def double_text(c: Column) -> Column:
    """A float or double as its shortest exact decimal text, without an exponent; equal values have equal texts, NaN has none."""
    x = c.cast("double")
    own = F.abs(x).cast("string")
    # lambdas name a part once; few values come here
    rare = F.get(F.transform(F.array(F.struct(F.abs(x).alias("x"), own.alias("t"))), lambda s: F.get(F.transform(F.array(_shortest(s["x"], s["t"])), _unscaled), 0)), 0)
    plain = F.when(own.endswith(".0") & ~own.contains("E"), F.left(own, F.length(own) - 2)).when(own.contains("E") | ((F.length(own) > 16) & own.contains(".")), rare).otherwise(own)
    return F.when(~F.isnan(x), F.concat(F.when(x < 0, "-").otherwise(""), plain))


def to_text(c: Column, kind: T.DataType) -> Column:
    """A native value as the text both sides are compared by; a date without time is a date only."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_text(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(c == F.date_trunc("day", c), F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def columns(df: DataFrame, side: str) -> DataFrame:
    """(side, col_idx, col_id, original_name, header_tokens, header_groups, normalized_name, safe_name): a row for each column."""
    from ..functions import headers as H

    rows = [(side, i, f"{side}_{i + 1}", n) for i, n in enumerate(df.columns)]
    named = df.sparkSession.createDataFrame(rows, "side string, col_idx int, col_id string, original_name string").withColumn("header_tokens", H.tokens_of(F.col("original_name")))
    named = named.withColumn("normalized_name", F.array_join("header_tokens", " ")).withColumn("header_groups", H.synonym_groups(F.col("normalized_name")))
    made = [r.asDict() for r in named.collect()]  # names of columns are metadata that the driver has
    safe = safe_names([r["normalized_name"] for r in made])
    return df.sparkSession.createDataFrame([(*r.values(), s) for r, s in zip(made, safe)], named.schema.add("safe_name", "string"))


def safe_names(names: list[str]) -> list[str]:
    """Each name, or `column {n}` for an empty one, with the first free number from 2 on where it is taken."""
    used: dict[str, None] = {}
    for i, name in enumerate(names):
        base, n = name or f"column {i + 1}", 1
        made = base
        while made in used:
            n += 1
            made = f"{base} {n}"
        used[made] = None
    return list(used)


def melt(df: DataFrame, side: str, order: str | None = None, hidden: bool = False) -> DataFrame:
    """(side, col_idx, row_idx, raw): a row for each cell. Without `order`, rows count as they are read; `hidden` says that the ordering column is none of the table's."""
    fields = [f for f in df.schema if not (hidden and f.name == order)]
    texts = [to_text(F.col(f"`{f.name}`"), f.dataType).alias(str(i)) for i, f in enumerate(fields)]
    row = (F.col(f"`{order}`") if order else F.monotonically_increasing_id()).alias("row_idx")
    wide = df.select(row, *texts)
    return wide.unpivot(["row_idx"], [str(i) for i in range(len(texts))], "col_idx", "raw").select(F.lit(side).alias("side"), F.col("col_idx").cast("int").alias("col_idx"), "row_idx", "raw")


def dictionary(cells: DataFrame) -> DataFrame:
    """(side, col_idx, value, cnt, first_pos): distinct normal values, null among them. Raw texts collapse first, so each is normalized once."""
    raw = cells.groupBy("side", "col_idx", "raw").agg(F.count("*").alias("cnt"), F.min("row_idx").alias("first_pos"))
    return V.with_cell(raw, "raw", "value").groupBy("side", "col_idx", "value").agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"))

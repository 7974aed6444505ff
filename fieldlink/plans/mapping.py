"""Map the columns of table A to those of table B."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import duplicates, match, melt, overlap, profile, types
from ..sources.shared import small, written

#: Views of values that the mapping compares.
VIEWS = ("raw", "date", "amount", "pan", "padded", "token")


@dataclass
class Mapping:
    """The frames of one mapping. The dictionary has a row for each distinct value; all others have a row for each column or pair of columns and are read from small tables."""

    dictionary: DataFrame
    columns: DataFrame
    overlaps: DataFrame
    checked: DataFrame
    warnings: DataFrame
    duplicates: DataFrame
    pairs: DataFrame
    decisions: DataFrame
    resolved: DataFrame
    rejected: DataFrame
    buckets: DataFrame
    derived: DataFrame
    results: DataFrame
    unmatched: DataFrame
    reverse: DataFrame
    summary: DataFrame


def map_columns(a: DataFrame, b: DataFrame, order: str | None = None) -> Mapping:
    """The mapping of A's columns to B's. `order` names a column of both that only says where a row stands, as read_text_table() gives it; without one rows count as they are read."""
    d = written(melt.dictionary(melt.melt(a, "A", order, True).unionByName(melt.melt(b, "B", order, True))), "dictionary")
    a, b = (df.drop(order) if order else df for df in (a, b))
    columns = melt.columns(a, "A").unionByName(melt.columns(b, "B"))
    profiled = columns.join(profile.profile(d), ["side", "col_idx"], "left").na.fill(0.0).na.fill(0)
    checked = small(types.checked(profiled), "columns")
    over = small(overlap.dictionary_overlaps(d, VIEWS), "overlaps")
    near = duplicates.near_pairs(over, "B", duplicates.TARGET_LIMITS).unionByName(duplicates.near_pairs(over, "A", duplicates.SOURCE_LIMITS)).unionByName(equal_columns(a, checked, over))
    dups = small(duplicates.duplicates(duplicates.clusters(near.distinct()), checked), "duplicates")
    all_ = small(match.pairs(checked, over, dups), "pairs")
    decisions = small(match.decided(match.scored(match.shortlisted(all_))), "decisions")
    resolved = small(match.resolved(decisions), "resolved")
    rejected = match.rejected(decisions, resolved)
    derived = match.derived(all_, decisions)
    results = small(match.results(checked, decisions, resolved), "results")
    unmatched = match.unmatched(results, dups, resolved, checked)
    return Mapping(d, columns, over, checked, types.warnings(checked), dups, all_, decisions, resolved, rejected, match.buckets(resolved), derived, results, unmatched, match.reverse_check(checked, results), match.summary(results, resolved, derived, rejected, unmatched))


def equal_columns(a: DataFrame, checked: DataFrame, over: DataFrame, least: float = duplicates.SOURCE_LIMITS["raw"]) -> DataFrame:
    """(side, a, b): columns of table A that agree row by row in a share of `least` rows, but for those that shared values make near already.

    A value that only one of two such columns has costs a row at least; so the inverted index leaves pairs that
    share all but a few distinct values, with about as many nulls. Those are counted in one
    scan; the driver holds two numbers for each.
    """
    own = checked.where("side = 'A'").select("col_idx", "n_rows", "n_values", "n_distinct")
    x, y = (own.select(*(F.col(c).alias(f"{c}_{n}") for c in own.columns)) for n in "ab")
    inner = over.where("side_a = 'A' and side_b = 'A'")
    held = inner.where("view = 'raw'").select(F.col("col_a").alias("col_idx_a"), F.col("col_b").alias("col_idx_b"), "shared")
    done = duplicates.near_pairs(inner, "A", duplicates.SOURCE_LIMITS).select(F.col("a").alias("col_idx_a"), F.col("b").alias("col_idx_b"))
    off, shared = F.col("n_rows_a") * (1 - least) + 1e-9, F.coalesce("shared", F.lit(0))
    alike = (F.col("col_idx_a") < F.col("col_idx_b")) & (F.abs(F.col("n_values_a") - F.col("n_values_b")) <= off)
    both = x.join(F.broadcast(y), alike).join(held, ["col_idx_a", "col_idx_b"], "left").where((F.col("n_distinct_a") - shared <= off) & (F.col("n_distinct_b") - shared <= off) & (F.col("n_rows_a") > 0))
    rows = both.join(done, ["col_idx_a", "col_idx_b"], "left_anti").select("col_idx_a", "col_idx_b", "n_rows_a").collect()
    if not rows:
        return a.sparkSession.createDataFrame([], "side string, a int, b int")
    pairs = sorted((r.col_idx_a, r.col_idx_b) for r in rows)
    counted = overlap.row_misses(a, pairs, rows[0].n_rows_a * (1 - least) + 1e-9)
    return counted.where(1 - F.try_divide("misses", "n") >= least).select(F.lit("A").alias("side"), "a", "b")

"""Near-duplicate columns in one table: pairs, greedy clusters in column order, and the column to keep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_score() -> Column:
    """Which column of a cluster is the real one; over checked() rows."""
    name = F.lower("original_name")
    kind = F.col("observed_type")
    return (
        F.when(F.col("uniqueness_ratio") > 0.55, 10.0).otherwise(-5.0) + F.col("alignment") + F.when((kind == "amount") & name.rlike("amount|authorized|replaced|posted|value"), 30.0).otherwise(0.0)
        - F.when((kind == "amount") & name.rlike("account|acct"), 35.0).otherwise(0.0) - F.when((kind == "card_number") & name.rlike("date|time|datetime"), 12.0).otherwise(0.0) - F.col("null_ratio") * 10
    )


def near_pairs(over: DataFrame, side: str, limits: dict[str, float]) -> DataFrame:
    """(side, a, b): pairs of columns in a table whose overlap ratio reaches a view's limit."""
    hit = F.lit(False)
    for view, least in limits.items():
        hit = hit | ((F.col("view") == view) & (F.col("overlap_ratio") >= least))
    return over.where((F.col("side_a") == side) & (F.col("side_b") == side) & hit).select(F.col("side_a").alias("side"), F.col("col_a").alias("a"), F.col("col_b").alias("b")).distinct()


#: Why a column goes (fixed texts).
SOURCE_REASON, TARGET_REASON = "Near-identical source column detected; weaker duplicate rejected", "Near-identical target column detected; weaker duplicate rejected"
TARGET_LIMITS = {"raw": 0.97, "amount": 0.98, "date": 0.98, "pan": 0.95}
SOURCE_LIMITS = {"raw": 0.999, "amount": 0.999}


def clusters(pairs: DataFrame) -> DataFrame:
    """(side, col_idx, cluster): stars in column order; a column that is in a cluster starts none. Rows are pairs of columns, as few as a table's columns allow."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(int(a), set()).add(int(b))
            near.setdefault(int(b), set()).add(int(a))
        taken: dict[int, int] = {}
        for c in sorted(near):
            if c not in taken:
                later = [x for x in sorted(near[c]) if x > c and x not in taken]
                if later:
                    taken.update({x: c for x in (c, *later)})
        return pd.DataFrame({"side": pdf["side"].iloc[0], "col_idx": list(taken), "cluster": list(taken.values())})

    return pairs.groupBy("side").applyInPandas(run, "side string, col_idx int, cluster int")


def duplicates(clustered: DataFrame, checked: DataFrame) -> DataFrame:
    """(side, col_idx, col_id, original_name, canonical_idx, canonical_id, canonical_name, reason): columns that repeat another of their cluster."""
    named = ["col_id", "original_name"]
    scored = clustered.join(checked.select("side", "col_idx", *named, canonical_score().alias("_score")), ["side", "col_idx"])
    order = Window.partitionBy("side", "cluster").orderBy(F.col("_score").desc(), "col_idx")
    ranked = scored.withColumn("_rank", F.row_number().over(order)).withColumn("_first", F.first(F.struct("col_idx", *named)).over(order))
    reason = F.when(F.col("side") == "A", SOURCE_REASON).otherwise(TARGET_REASON)
    return ranked.where("_rank > 1").select("side", "col_idx", *named, F.col("_first.col_idx").alias("canonical_idx"), F.col("_first.col_id").alias("canonical_id"), F.col("_first.original_name").alias("canonical_name"), reason.alias("reason"))

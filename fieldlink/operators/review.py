"""Results for people: mappings, explanations, overrides and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def final_mappings(results: DataFrame) -> DataFrame:
    return results.select("source_id", "source_name", "target_id", "target_name", F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("status", F.lit("unmatched")).alias("status"))


def explained(results: DataFrame) -> DataFrame:
    """(source_id, explanation): the scores and reasons of the best match; the wording is fixed."""
    number = lambda c: F.format_string("%.0f", F.col(f"scores.{c}").cast("double"))
    text = F.concat(F.lit("Header score "), number("header_score"), F.lit(", Value score "), number("value_score"), F.lit(", Type score "), number("type_score"), F.lit(", Total score "), number("total_score"), F.lit(". Reasons: "), F.array_join("reason", "; "))
    return results.select("source_id", F.when(F.col("target_id").isNull(), "No confident candidate was found.").otherwise(text).alias("explanation"))


def filtered(results: DataFrame, kind: str) -> DataFrame:
    """all, accepted, or one category."""
    if kind == "all":
        return results
    return results.where(F.col("category").isin("exact", "transformed", "semantic")) if kind == "accepted" else results.where(F.col("category") == kind)


def effective_target(results: DataFrame, overrides: DataFrame, targets: DataFrame) -> DataFrame:
    """results with effective_target: an override's target or its withdrawal, else the best match. overrides: (source_id, override_id), a null for no target."""
    own = overrides.select("source_id", "override_id", F.lit(True).alias("_set"))
    named = targets.select(F.col("col_id").alias("override_id"), F.col("original_name").alias("_name"))
    name = F.when(F.col("_set") & F.col("override_id").isNull(), "Unmatched (manual)").when(F.col("_set"), F.coalesce("_name", "override_id")).otherwise(F.coalesce("target_name", F.lit("-")))
    return results.join(own, "source_id", "left").join(named, "override_id", "left").withColumn("effective_target", name).drop("_set", "_name")


def feedback_rows(verdicts: DataFrame, results: DataFrame, overrides: DataFrame) -> DataFrame:
    """(source_id, target_id, verdict, updated_at): the override's target if there is an override, else the best one."""
    own = overrides.select("source_id", "override_id", F.lit(True).alias("_set"))
    chosen = F.when(F.col("_set"), F.col("override_id")).otherwise(F.col("target_id"))
    return verdicts.join(results.select("source_id", "target_id"), "source_id", "left").join(own, "source_id", "left").select("source_id", chosen.alias("target_id"), "verdict", "updated_at")


def latest(feedback: DataFrame, key: str = "source_id", at: str = "updated_at", tie: str | None = None) -> DataFrame:
    """The last entry of each source column."""
    order = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in [at, *([tie] if tie else [])]))
    return feedback.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 80, "Strong").when(c >= 60, "Medium").when(c < 40, "Low").otherwise("Weak")

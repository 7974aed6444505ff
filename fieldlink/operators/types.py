"""Semantic types of columns from their profiles, type compatibility and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers as H

#: Target types that score 72 for a source type; the same type scores 100 (fixed values).
COMPATIBLE = {
    "debit_credit": ["status_code", "generic_text"],
    "transaction_id": ["reference_number", "auth_code"],
    "reference_number": ["transaction_id", "auth_code", "customer_id"],
    "amount": ["debit_amount", "credit_amount", "generic_numeric"],
    "debit_amount": ["amount", "generic_numeric"],
    "credit_amount": ["amount", "generic_numeric"],
    "currency": [],
    "date": ["datetime"],
    "datetime": ["date"],
    "card_number": ["masked_pan", "account_number"],
    "account_number": ["reference_number", "customer_id"],
    "masked_pan": ["card_number", "account_number"],
    "merchant_text": ["narration_text", "merchant_name", "narration", "generic_text"],
    "narration_text": ["merchant_text", "narration", "merchant_name", "generic_text"],
    "merchant_name": ["narration", "generic_text"],
    "narration": ["merchant_name", "generic_text"],
    "status_code": ["generic_text"],
    "auth_code": ["reference_number", "transaction_id"],
    "customer_id": ["reference_number", "account_number"],
    "branch_code": ["reference_number", "generic_text"],
    "generic_text": ["narration", "merchant_name"],
    "generic_numeric": ["amount", "debit_amount", "credit_amount"],
    "unknown": ["generic_text", "generic_numeric"],
}


def _r(name: str) -> Column:
    return F.col(f"r_{name}")


def observed_type(masked: str = "masked_run") -> Column:
    """Type by value ratios of profile(); order and thresholds are fixed values."""
    return (
        F.when(_r("currency") > 0.8, "currency").when(_r("datetime") > 0.72, "datetime").when(_r("date") > 0.75, "date").when(_r("drcr") > 0.8, "debit_credit")
        .when((_r("card") > 0.55) & (_r(masked) > 0.25), "masked_pan").when(_r("card") > 0.55, "card_number").when(_r("status") > 0.75, "status_code")
        .when(_r("amount") > 0.82, "amount").when(_r("numeric") > 0.9, "generic_numeric").when(_r("txn_id") > 0.7, "transaction_id")
        .when((_r("account") > 0.72) & (_r("text") < 0.2), "account_number").when((_r("long_text") > 0.7) & (_r("text") > 0.7), "narration_text")
        .when(_r("text") > 0.75, "generic_text").otherwise("unknown")
    )


def column_type() -> Column:
    """Type by header and values: header rules, then observed_type(); order, words and thresholds are fixed values."""
    h = lambda *terms: F.col("normalized_name").rlike("|".join(terms))
    observed = observed_type()
    return (
        F.when(h("debit", "withdrawal", "dr"), "debit_amount").when(h("credit", "deposit", "cr"), "credit_amount")
        .when(h("tran type", "part tran", "debit credit", "drcr"), F.when(_r("datetime") >= 0.5, "datetime").when(_r("date") >= 0.5, "date").otherwise("debit_credit"))
        .when(h("amount", "amt") & (_r("numeric") > 0.5), "amount").when(h("currency", "ccy", "curr") | (_r("currency") > 0.7), "currency")
        .when(h("datetime", "timestamp") & (_r("datetime") > 0.2), "datetime").when(h("date", "value date", "posting") & (_r("date") > 0.4), "date")
        .when(h("time", "timestamp", "datetime"), "datetime").when(h("merchant", "acceptor"), "merchant_text").when(h("narration", "description", "remark", "particular"), "narration_text")
        .when(h("status", "response"), "status_code").when(h("auth", "authorization"), "auth_code").when(h("customer", "cust"), "customer_id").when(h("branch", "sol"), "branch_code")
        .when(h("account", "iban", "a c") | (_r("long_id") > 0.7), "account_number")
        .when(h("pan", "card") | (_r("card") > 0.5) | (_r("masked_run") > 0.5), F.when(_r("masked_run") > 0.2, "masked_pan").otherwise("card_number"))
        .when(h("transaction", "txn", "trace", "rrn", "stan", "identifier"), "transaction_id").when(h("reference", "ref"), "reference_number")
        .when(observed != "unknown", observed).when(_r("spaced") > 0.4, "narration_text").otherwise("unknown")
    )


def compatibility(source: Column, target: Column) -> Column:
    """100, 72, 40 or 15; not symmetric."""
    listed = F.create_map(*(x for k, v in COMPATIBLE.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    hit = F.coalesce(F.array_contains(listed[source], target), F.lit(False))
    return F.when(source == target, 100).when(hit, 72).when((source == "unknown") | (target == "unknown"), 40).otherwise(15).cast("double")


def compatibility_reason(source: Column, target: Column) -> Column:
    """What compatibility() says, in words (fixed texts)."""
    score = compatibility(source, target)
    return F.when(score == 100, "Inferred types are identical").when(score == 72, "Inferred financial types are compatible").when(score == 40, "One side has uncertain type inference").otherwise("Inferred types appear incompatible")


def alignment(name: Column, kind: Column) -> Column:
    """How well a header's expected type fits the observed one."""
    expected = H.expected_type(name)
    return F.when(expected == "unknown", 45.0).otherwise(compatibility(expected, kind))


def checked(profiled: DataFrame) -> DataFrame:
    """profile rows with names: observed_type, expected_type, trust and whether the file's headers look shifted."""
    typed = profiled.withColumn("observed_type", observed_type()).withColumn("column_type", column_type()).withColumn("expected_type", H.expected_type(F.col("original_name")))
    low = (F.col("expected_type") != "unknown") & (F.col("observed_type") != "unknown") & (compatibility(F.col("expected_type"), F.col("observed_type")) < 50)
    side = Window.partitionBy("side")
    own = typed.withColumn("_low", low).withColumn("_next", F.coalesce(F.lag("_low").over(side.orderBy("col_idx")), F.lit(False)))
    count = F.sum(F.col("_low").cast("int")).over(side)
    shifted = (count >= F.greatest(F.lit(2), F.floor(F.count("*").over(side) * 0.35))) | F.max(F.col("_low") & F.col("_next")).over(side)
    out = own.withColumn("shifted", shifted)
    trust = F.when(F.col("_low"), "low").when((F.col("expected_type") == "unknown") | F.col("shifted"), "medium").otherwise("high")
    return out.withColumn("trust", trust).withColumn("alignment", alignment(F.col("original_name"), F.col("observed_type"))).drop("_low", "_next")


def warnings(checked_: DataFrame) -> DataFrame:
    """(side, code, severity, message, affected_columns)."""
    low = checked_.where("trust = 'low'")
    each = low.select("side", F.lit("HEADER_VALUE_INCONSISTENT").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("Header "), "original_name", F.lit(" is inconsistent with observed values")).alias("message"), F.array("col_id").alias("affected_columns"))
    ordered = F.expr("transform(array_sort(collect_list(struct(col_idx, col_id))), x -> x.col_id)")
    whole = low.where("shifted").groupBy("side").agg(ordered.alias("affected_columns")).select("side", F.lit("SCHEMA_SHIFT_SUSPECTED").alias("code"), F.lit("critical").alias("severity"), F.lit("Multiple adjacent header/value mismatches indicate possible schema shift").alias("message"), "affected_columns")
    return each.unionByName(whole)

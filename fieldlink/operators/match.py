"""Candidates, decisions and conflicts on (source column, target column) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers as H
from . import types

#: Weights and limits (fixed values).
SHORTLIST = 7
STRONG, WEAK, AMBIGUOUS = 80, 40, 8
HEADER_WEIGHT = {"low": 3.0, "medium": 12.0, "high": 20.0}
HEADER_FACTOR = {"low": 0.2, "medium": 0.55, "high": 1.0}
DATES, MONEY, CARDS = ["date", "datetime"], ["amount", "generic_numeric"], ["card_number", "masked_pan"]
TEXTS = ["narration", "narration_text", "merchant_name", "merchant_text", "generic_text", "reference_number", "transaction_id"]
BUCKETS = ["ACCEPT_EXACT", "ACCEPT_EXACT_PARTIAL", "ACCEPT_STRONG_DOMAIN_MATCH", "ACCEPT_TRANSFORMED", "ACCEPT_SEMANTIC", "DERIVED_MATCH"]
#: Names of dates that follow from others.
DERIVED_NAMES = r"tran[_\s-]?date|value[_\s-]?date"
CATEGORY = {"ACCEPT_EXACT": "exact", "ACCEPT_EXACT_PARTIAL": "exact", "ACCEPT_STRONG_DOMAIN_MATCH": "exact", "ACCEPT_TRANSFORMED": "transformed", "ACCEPT_SEMANTIC": "semantic"}


def rounded(c: Column) -> Column:
    return F.floor(c + 0.5)


def _by_trust(values: dict[str, float]) -> Column:
    return F.when(F.col("trust") == "low", values["low"]).when(F.col("trust") == "medium", values["medium"]).otherwise(values["high"])


def pairs(checked: DataFrame, over: DataFrame, dups: DataFrame) -> DataFrame:
    """All (source, target) pairs of columns with evidence; metadata-sized."""
    own = checked.join(dups.select("side", "col_idx", F.lit(True).alias("duplicate")), ["side", "col_idx"], "left").na.fill(False, ["duplicate"])
    fields = ["col_idx", "col_id", "original_name", "normalized_name", "header_tokens", "header_groups", "observed_type", "null_ratio", "top_share", "alignment", "duplicate"]
    s = own.where("side = 'A'").select(*(F.col(c).alias(f"s_{c}") for c in fields), "trust", F.col("shifted").alias("s_shifted"))
    t = own.where("side = 'B'").select(*(F.col(c).alias(f"t_{c}") for c in fields), F.col("shifted").alias("t_shifted"))
    measures = [("raw", "coverage_a", "raw_s"), ("raw", "coverage_b", "raw_t"), ("date", "coverage_a", "date_s"), ("amount", "coverage_a", "amount_s"), ("amount", "coverage_b", "amount_t"), ("pan", "coverage_a", "pan_s"), ("pan", "coverage_b", "pan_t"), ("padded", "coverage_a", "padded_s"), ("token", "jaccard", "token_j")]
    wide = over.where("side_a = 'A' and side_b = 'B'").groupBy(F.col("col_a").alias("s_col_idx"), F.col("col_b").alias("t_col_idx")).agg(*(F.max(F.when(F.col("view") == v, F.col(m))).alias(n) for v, m, n in measures))
    # columns by columns, both metadata
    all_ = s.crossJoin(F.broadcast(t)).join(wide, ["s_col_idx", "t_col_idx"], "left").na.fill(0.0, [n for _, _, n in measures])
    out = all_.withColumn("max_transform", F.greatest("date_s", "amount_s", "pan_s", "padded_s")).withColumn("header_score", H.similarity(*({"norm": F.col(f"{x}_normalized_name"), "tokens": F.col(f"{x}_header_tokens"), "groups": F.col(f"{x}_header_groups")} for x in "st"))).withColumn("type_score", types.compatibility(F.col("s_observed_type"), F.col("t_observed_type")))
    out = out.withColumn("low_cardinality", F.greatest("s_top_share", "t_top_share") >= 0.55).withColumn("shifted", F.col("s_shifted") | F.col("t_shifted"))
    quick = F.col("raw_s") * 50 + F.col("max_transform") * 28 + F.col("type_score") / 100 * 20 + F.col("header_score") / 100 * _by_trust(HEADER_WEIGHT)
    plausible = rounded(F.col("type_score") * 0.55 + (F.col("s_alignment") + F.col("t_alignment")) / 2 * 0.35 + F.col("header_score") * 0.1 * _by_trust(HEADER_FACTOR))
    return out.withColumn("quick_score", quick).withColumn("plausibility", plausible)


def shortlisted(all_: DataFrame) -> DataFrame:
    """The best few targets of each source that aren't hopeless."""
    kept = all_.where(~((F.col("type_score") < 30) & (F.col("raw_s") < 0.12) & (F.col("max_transform") < 0.2)))
    order = Window.partitionBy("s_col_idx").orderBy(F.col("quick_score").desc(), "t_col_idx")
    return kept.withColumn("quick_rank", F.row_number().over(order)).where(F.col("quick_rank") <= SHORTLIST)


def metadata_score() -> Column:
    return rounded((1 - F.abs(F.col("s_null_ratio") - F.col("t_null_ratio"))) * 100)


def scored(candidates: DataFrame) -> DataFrame:
    """Confidence, status, scores, evidence and reasons (their wording is fixed)."""
    rs, rt, tr, sem = F.round("raw_s", 4), F.round("raw_t", 4), F.round("max_transform", 4), F.round(F.col("token_j") * 100, 2)
    raw = rs * 48 + rt * 20 + tr * 18 + sem / 100 * 14 + F.col("type_score") / 100 * 16 + F.col("plausibility") / 100 * 16
    raw = raw - F.when(F.col("t_duplicate"), 45).otherwise(0) - F.when(F.col("low_cardinality"), 12).otherwise(0) - F.when(F.col("plausibility") < 45, 15).otherwise(0)
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), rounded(raw))).cast("long")
    reasons = F.array_compact(F.array(
        F.when((rs >= 0.9) & (rt >= 0.83), "High unique-set overlap supports same business field"), F.when(tr >= 0.8, "Transformed signatures strongly overlap"),
        F.when(sem >= 75, "Semantic token overlap indicates related business meaning"), F.when(F.col("t_duplicate"), "Target is in duplicate cluster and receives heavy penalty"),
        F.when(F.col("plausibility") < 45, "Business plausibility is weak for this candidate"), F.when(F.col("low_cardinality"), "Low-cardinality repetition risk detected"),
    ))
    out = candidates.withColumn("raw_s4", rs).withColumn("raw_t4", rt).withColumn("confidence", confidence).withColumn("reason", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("Evidence remains limited"))))
    out = out.withColumn("status", F.when(F.col("confidence") >= STRONG, "matched").when(F.col("confidence") >= WEAK, "weak").otherwise("unmatched"))
    scores = F.struct(F.col("header_score"), rounded((rs * 70 + rt * 30) * 100).alias("value_score"), F.col("type_score"), metadata_score().alias("metadata_score"), F.col("confidence").alias("total_score"))
    return out.withColumn("scores", scores).withColumn("evidence", F.struct(rounded((rs + rt) / 2 * 100).alias("exact"), rounded(tr * 100).alias("transformed"), rounded(sem).alias("semantic")))


def decided(scored_: DataFrame) -> DataFrame:
    """The ordered accept and reject rules; the first that fits decides."""
    s, t, risk = F.col("s_observed_type"), F.col("t_observed_type"), F.col("low_cardinality")
    rs, rt, kind, p, h = F.col("raw_s4"), F.col("raw_t4"), F.col("type_score"), F.col("plausibility"), F.col("header_score")
    dates = s.isin(DATES) & t.isin(DATES)
    low = F.when(F.col("shifted"), "REJECT_SHIFTED_HEADER").otherwise("REJECT_WEAK")
    # (condition, decision, reason of a rejection); the texts are fixed values
    rules = [
        (F.col("s_duplicate") & (t == "amount"), "REJECT_DUPLICATE", "Source column is duplicate/suspicious and not the canonical amount representative"),
        (F.col("t_duplicate"), "REJECT_DUPLICATE", "Duplicate target column rejected; canonical target retained"),
        (dates & F.lower("t_original_name").rlike(DERIVED_NAMES), "REJECT_WEAK", "Target date column is treated as derived date-part mapping"),
        ((kind < 45) & (rs > 0.7), low, "Raw overlap is high but observed business types are incompatible"),
        (((F.col("trust") == "low") | F.col("shifted")) & (rs > 0.72) & (p < 50), "REJECT_SHIFTED_HEADER", "Shifted/misleading header likely; rejected despite overlap"),
        (s.isin(MONEY) & t.isin(MONEY) & (F.col("amount_s") >= 0.94) & (F.col("amount_t") >= 0.94) & (p >= 55) & ~risk, "ACCEPT_EXACT", None),
        ((rs >= 0.9) & (rt >= 0.83) & (kind >= 60) & (p >= 55) & ~risk, "ACCEPT_EXACT", None),
        ((rs >= 0.75) & (rt >= 0.58) & (kind >= 55) & (p >= 52) & ~risk, "ACCEPT_EXACT_PARTIAL", None),
        ((dates & (F.col("date_s") >= 0.82)) | ((rs >= 0.6) & (rt >= 0.5) & (kind >= 68) & (h >= 30) & (p >= 55)), "ACCEPT_STRONG_DOMAIN_MATCH", None),
        (((F.col("pan_s") >= 0.85) & (F.col("pan_t") >= 0.85) & (s.isin([*CARDS, "datetime"]) | t.isin(CARDS))) | ((F.col("max_transform") >= 0.8) & (kind >= 55)), "ACCEPT_TRANSFORMED", None),
        (s.isin(TEXTS) & t.isin(TEXTS) & (F.col("token_j") >= 0.62), "ACCEPT_SEMANTIC", None),
        (F.col("confidence") < WEAK, "UNMATCHED", "No reliable evidence found"),
    ]
    first_rule = reduce(lambda rest, rule: F.when(rule[1][0], rule[0]).otherwise(rest), reversed(list(enumerate(rules))), F.lit(len(rules)))
    scored_ = scored_.withColumn("_rule", first_rule)
    of_rule = lambda values, other: reduce(lambda rest, x: F.when(F.col("_rule") == x[0], x[1]).otherwise(rest), enumerate(values), other)
    decision = of_rule([r[1] for r in rules], F.lit("REJECT_WEAK"))
    scored_ = scored_.withColumn("rejection_reason", of_rule([r[2] for r in rules], F.lit("Evidence too weak for conservative acceptance")))
    accepted = F.col("decision").startswith("ACCEPT")
    order = Window.partitionBy("s_col_idx").orderBy(accepted.cast("int").desc(), F.col("confidence").desc(), "quick_rank")
    out = scored_.withColumn("decision", decision).withColumn("accepted", accepted).drop("_rule")
    by_confidence = Window.partitionBy("s_col_idx").orderBy(F.col("confidence").desc(), "quick_rank")
    out = out.withColumn("rank", F.row_number().over(order)).withColumn("_gap", F.col("confidence") - F.lead("confidence").over(by_confidence)).withColumn("place", F.row_number().over(by_confidence))
    source = Window.partitionBy("s_col_idx")
    ambiguous = F.coalesce(F.max((F.col("place") == 1) & (F.col("_gap") < AMBIGUOUS)).over(source), F.lit(False)) | (F.sum(accepted.cast("int")).over(source) > 1)
    return out.withColumn("ambiguous", ambiguous).drop("_gap")


def _overlap_scores() -> list[Column]:
    """The measures that rows of a bucket carry."""
    return [
        F.col("raw_s4").alias("source_coverage"), F.col("raw_t4").alias("target_coverage"), F.round((F.col("raw_s4") + F.col("raw_t4")) / 2 * 100, 2).alias("overlap_score"),
        F.round(F.round("max_transform", 4) * 100, 2).alias("transformed_score"), F.round(F.col("token_j") * 100, 2).alias("semantic_score"), "low_cardinality",
    ]


def rejected(decided_: DataFrame, resolved_: DataFrame) -> DataFrame:
    """Rejected candidates, one that is merely unmatched as weak, and accepted ones that lost their target; with category, penalty and reason."""
    names = ["s_col_idx", "s_col_id", "s_original_name", "t_col_idx", "t_col_id", "t_original_name", "s_observed_type", "t_observed_type", "trust", "confidence"]
    plain = decided_.where(~F.col("accepted")).withColumn("decision", F.when(F.col("decision") == "UNMATCHED", "REJECT_WEAK").otherwise(F.col("decision")))
    both = plain.select(*names, *_overlap_scores(), "reason", "decision", "rejection_reason").unionByName(losers(resolved_).select(*names, *_overlap_scores(), "reason", F.lit("REJECT_DUPLICATE").alias("decision"), "rejection_reason"))
    twice = F.col("decision") == "REJECT_DUPLICATE"
    return both.withColumn("category", F.when(twice, "duplicate_or_suspicious").otherwise("rejected")).withColumn("duplicate_penalty", F.when(twice, 100).otherwise(0))


def losers(resolved_: DataFrame) -> DataFrame:
    """Accepted pairs whose target another source won, with the reason (fixed wording)."""
    winners = resolved_.where("wins").select("t_col_idx", F.col("s_original_name").alias("_winner"))
    text = F.concat(F.lit("Weaker duplicate candidate for "), "t_original_name", F.lit("; "), "_winner", F.lit(" is the stronger business mapping"))
    return resolved_.where("not wins").join(winners, "t_col_idx").withColumn("rejection_reason", text).drop("_winner")


def derived(all_: DataFrame, decided_: DataFrame) -> DataFrame:
    """Dates that follow from a date column: targets that this source wasn't accepted for, or that are named as transaction or value date."""
    named = F.lower("t_original_name").rlike(DERIVED_NAMES)
    taken = decided_.where("accepted").select("s_col_idx", "t_col_idx", F.lit(True).alias("_taken"))
    dates = all_.where(F.col("s_observed_type").isin(DATES) & F.col("t_observed_type").isin(DATES) & (F.col("date_s") >= 0.78))
    free = dates.join(taken, ["s_col_idx", "t_col_idx"], "left").where(F.col("_taken").isNull() | named)
    return free.select("s_col_idx", "s_col_id", "s_original_name", "t_col_idx", "t_col_id", "t_original_name", "s_alignment", rounded(F.col("date_s") * 100).cast("long").alias("confidence"), F.lit("DERIVED_MATCH").alias("decision"))


def resolved(decided_: DataFrame) -> DataFrame:
    """Accepted rows with wins: each target keeps one source, by confidence and header fit, then bucket, column order and place.

    Targets are settled in the order in which accepted rows first name them, by bucket, source and place: `turn`
    is where a row's target stands in that order.
    """
    bucket = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("decision"))
    target = Window.partitionBy("t_col_idx")
    order = target.orderBy((F.col("confidence") + 0.4 * F.col("s_alignment")).desc(), bucket, "s_col_idx")
    return decided_.where("accepted").withColumn("wins", F.row_number().over(order) == 1).withColumn("turn", F.min(F.struct(bucket, "s_col_idx", "place")).over(target))


def buckets(resolved_: DataFrame) -> DataFrame:
    """A row for each accepted pair that kept its target, with bucket, scores and evidence."""
    return resolved_.where("wins").select(F.col("decision").alias("bucket"), category_of(F.col("decision")).alias("category"), "s_col_idx", "s_col_id", "s_original_name", "t_col_idx", "t_col_id", "t_original_name", "s_observed_type", "t_observed_type", "trust", "confidence", *_overlap_scores(), F.lit(0).alias("duplicate_penalty"), "reason", "evidence")


def category_of(decision: Column) -> Column:
    return F.coalesce(*(F.when(decision == d, c) for d, c in CATEGORY.items()))


def results(checked: DataFrame, decided_: DataFrame, resolved_: DataFrame) -> DataFrame:
    """A row for each source: its best target, unless another source took that target, and up to three other candidates by confidence."""
    lost = losers(resolved_).select("s_col_idx", "t_col_idx", "rejection_reason")
    best = decided_.where("accepted and rank = 1").drop("rejection_reason").join(lost, ["s_col_idx", "t_col_idx"], "left").withColumn("wins", F.col("rejection_reason").isNull())
    kept = lambda c, name: F.when(F.col("wins"), c).alias(name)
    won = best.select(
        F.col("s_col_id").alias("source_id"), F.col("t_col_id").alias("_best"), kept(F.col("t_col_id"), "target_id"), kept(F.col("t_original_name"), "target_name"), kept(F.col("t_observed_type"), "target_type"), kept(F.col("confidence"), "confidence"), kept(F.col("status"), "status"),
        kept(category_of(F.col("decision")), "category"), F.when(F.col("wins"), F.col("decision")).otherwise("REJECT_DUPLICATE").alias("decision"), F.when(F.col("wins"), F.col("reason")).otherwise(F.array("rejection_reason")).alias("reason"), kept(F.col("scores"), "scores"),
    )
    others = decided_.select(F.col("s_col_id").alias("source_id"), "t_col_id", "place", "ambiguous").join(won.select("source_id", "_best"), "source_id", "left").groupBy("source_id").agg(
        F.expr("slice(transform(array_sort(collect_list(if(t_col_id <=> _best, null, struct(place, t_col_id)))), x -> x.t_col_id), 1, 3)").alias("alternatives"), F.max("ambiguous").alias("ambiguous"),
    )
    sources = checked.where("side = 'A'").select("col_idx", F.col("col_id").alias("source_id"), F.col("original_name").alias("source_name"), F.col("observed_type").alias("source_type"), "column_type", "trust")
    full = sources.join(won.drop("_best"), "source_id", "left").join(others, "source_id", "left")
    full = full.withColumn("reason", F.coalesce("reason", F.array(F.lit(NOTHING_FOUND)))).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False))).withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<string>")))
    return full.withColumn("category", F.coalesce("category", F.lit("unmatched"))).withColumn("status", F.coalesce("status", F.lit("unmatched"))).withColumn("decision", F.coalesce("decision", F.lit("UNMATCHED"))).withColumn("confidence", F.coalesce("confidence", F.lit(0)))


#: Why a source has no target.
NOTHING_FOUND = "No accepted match found after strict validation"


def unmatched(results_: DataFrame, dups: DataFrame, resolved_: DataFrame, checked: DataFrame) -> DataFrame:
    """(source_id, source_name, decision, confidence, rejection_reason): sources without a target, sources that repeat another column, and sources that lost every target, by the loss that left them without one; each once."""
    none = results_.where("decision = 'UNMATCHED'").select("source_id", F.lit("UNMATCHED").alias("decision"), F.lit(0).alias("confidence"), F.lit(NOTHING_FOUND).alias("rejection_reason"), F.lit(1).alias("_o"))
    named = checked.select("side", "col_idx", F.col("col_id").alias("source_id"))
    repeats = dups.where("side = 'A'").join(named, ["side", "col_idx"]).select("source_id", F.lit("REJECT_DUPLICATE").alias("decision"), F.lit(0).alias("confidence"), F.col("reason").alias("rejection_reason"), F.lit(2).alias("_o"))
    all_lost = resolved_.groupBy("s_col_id").agg(F.max("wins").alias("_any")).where(~F.col("_any")).select("s_col_id")
    last = losers(resolved_).groupBy("s_col_id").agg(F.max_by(F.struct("confidence", "rejection_reason"), "turn").alias("_l"))
    lost = last.join(all_lost, "s_col_id").select(F.col("s_col_id").alias("source_id"), F.lit("REJECT_DUPLICATE").alias("decision"), "_l.confidence", "_l.rejection_reason", F.lit(3).alias("_o"))
    first = none.unionByName(repeats).unionByName(lost).groupBy("source_id").agg(F.min_by(F.struct("decision", "confidence", "rejection_reason"), "_o").alias("_f"))
    return first.join(checked.select(F.col("col_id").alias("source_id"), F.col("original_name").alias("source_name")), "source_id").select("source_id", "source_name", "_f.*")


def reverse_check(checked: DataFrame, results_: DataFrame) -> DataFrame:
    """Best source of each target, with its name."""
    targets = checked.where("side = 'B'").select(F.col("col_id").alias("target_id"), F.col("original_name").alias("target_name"))
    order = Window.partitionBy("target_id").orderBy(F.col("confidence").desc(), "col_idx")
    best = results_.where("target_id is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("target_id", "source_id", "source_name", "confidence", "status")
    return targets.join(best, "target_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0))).withColumn("status", F.coalesce("status", F.lit("unmatched")))


#: Buckets of the summary in order, and where their rows are.
SUMMARY = ["TOTAL", *BUCKETS, "DUPLICATE", "UNMATCHED"]


def summary(results_: DataFrame, resolved_: DataFrame, derived_: DataFrame, rejected_: DataFrame, unmatched_: DataFrame) -> DataFrame:
    """(bucket, n) for each bucket of SUMMARY, 0 included. DUPLICATE: rejected pairs of duplicates and of lost targets."""
    named = lambda df, bucket: df.select(bucket.alias("bucket"))
    rows = [named(results_, F.lit("TOTAL")), named(resolved_.where("wins"), F.col("decision")), named(derived_, F.col("decision")), named(rejected_.where("decision = 'REJECT_DUPLICATE'"), F.lit("DUPLICATE")), named(unmatched_, F.lit("UNMATCHED"))]
    counted = reduce(lambda a, b: a.unionByName(b), rows).groupBy().agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in SUMMARY))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in SUMMARY))))


def weighted_total(pair: DataFrame) -> DataFrame:
    """The documented weighted score of a pair from header_score, value_score, type_score and metadata_score."""
    return pair.withColumn("weighted_total", 0.30 * F.col("header_score") + 0.45 * F.col("value_score") + 0.20 * F.col("type_score") + 0.05 * F.col("metadata_score"))

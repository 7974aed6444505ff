"""The library's registered queries on the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import values as V
from ..operators import duplicates, match, melt, overlap, profile, review, types
from ..sources import files
from ..sources.shared import written
from .mapping import map_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells in many spellings, by key."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = (
        F.when(k % 9 == 0, "N/A").when(k % 9 == 1, F.concat(F.lit("$"), price, F.lit("00"))).when(k % 9 == 2, F.concat(F.lit("-00"), price)).when(k % 9 == 3, F.lpad(k.cast("string"), 12, "0"))
        .when(k % 9 == 4, F.concat(F.lit(" ORD-"), F.lpad(k.cast("string"), 9, "0"))).when(k % 9 == 5, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 9 == 6, F.date_format("o_orderdate", "yyyy/M/d"))
        .when(k % 9 == 7, F.concat(F.lpad(k.cast("string"), 8, "4"), F.lit("xxxx"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise(F.concat(F.col("o_orderpriority"), F.lit(" -- "), F.col("o_orderstatus")))
    )
    return o.select("o_orderkey", raw.alias("raw"))


def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    cells = V.with_cell(noisy_orders(spark, sf_dir), "raw", "cell")
    return cells.select("o_orderkey", V.null_like(c).alias("null_like"), V.compact_id(c).alias("compact"), V.amount(c).alias("amount"), V.text(c).alias("text"), "cell", V.zero_stripped(c).alias("stripped"), V.card_fingerprint(c).alias("pan"))


def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    return noisy_orders(spark, sf_dir).select("o_orderkey", V.date(c).alias("date"), V.date_part(c).alias("date_part"))


def value_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.explode(V.tokens(F.concat_ws(" ", F.lit("POS Purchase"), "p_name", "p_type"))).alias("token"))
    return p.groupBy("token").agg(F.count("*").alias("n"))


def value_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    some = noisy_orders(spark, sf_dir).where(V.null_like(c).isNotNull())
    return some.groupBy(V.format_class(c).alias("format"), V.type_class(c).alias("type"), V.is_dirty(c).alias("dirty")).agg(F.count("*").alias("n"))


def type_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("v")
    cells = V.with_cell(noisy_orders(spark, sf_dir), "raw", "v").where("v is not null")
    return cells.agg(*(F.count_if(p).alias(k) for k, p in V.predicates(c).items() if k not in ("spaced", "long_id")))


HEADER_SHAPES = ["Txn_Ref No.", "AuthorizedAmount", "Posting Date", "cardNumber", "Acct-No", "value date", "Merchant Desc", "status_code"]


def headers_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.array(*map(F.lit, HEADER_SHAPES))
    pick = lambda k: F.element_at(shapes, (k % len(HEADER_SHAPES) + 1).cast("int"))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", pick(k), "p_brand").alias("header"), pick(F.floor(k / 3)).alias("other"), pick(k).alias("shape"))


def header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("header")
    return headers_of_parts(spark, sf_dir).select("p_partkey", H.normalize(h).alias("normalized"), F.size(H.tokens_of(h)).cast("long").alias("n_tokens"), H.expected_type(h).alias("expected"))


def header_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of headers; the features of each distinct header are made once."""
    pairs = headers_of_parts(spark, sf_dir).select("p_partkey", "shape", "other")
    each = pairs.select("shape").distinct().withColumn("tokens", H.tokens_of(F.col("shape"))).withColumn("norm", F.array_join("tokens", " ")).withColumn("groups", H.synonym_groups(F.col("norm")))
    each = each.withColumn("family", H.family(F.col("shape"))).withColumn("alignment", types.alignment(F.col("shape"), F.lit("amount")))
    features = ["tokens", "norm", "groups", "family", "alignment"]
    both = pairs.join(each.select("shape", *(F.col(c).alias(f"a_{c}") for c in features)), "shape").join(each.select(F.col("shape").alias("other"), *(F.col(c).alias(f"b_{c}") for c in features)), "other")
    a, b = ({"norm": F.col(f"{x}_norm"), "tokens": F.col(f"{x}_tokens"), "groups": F.col(f"{x}_groups")} for x in "ab")
    return both.select("p_partkey", H.similarity(a, b).alias("score"), F.array_join(H.similarity_reasons(a, b), "; ").alias("reasons"), F.array_join("a_groups", ",").alias("groups"), F.array_join("b_family", ",").alias("family"), F.col("a_alignment").alias("alignment"))


def _dictionary(spark: SparkSession, sf_dir: str, a: str, b: str | None = None) -> DataFrame:
    cells = melt.melt(table(spark, sf_dir, a), "A")
    return melt.dictionary(cells.unionByName(melt.melt(table(spark, sf_dir, b), "B")) if b else cells)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(_dictionary(spark, sf_dir, "customer"))
    return p.select("col_idx", "n_rows", "n_values", "n_distinct", *(F.round(c, 6).alias(c) for c in ("null_ratio", "uniqueness_ratio", "repeated_ratio", "avg_length", "top_share", "r_numeric", "r_integer", "r_decimal", "r_date_like", "r_datetime_like", "r_text_like", "r_uppercase", "r_masked_like", "r_text", "r_amount", "r_long_text")), "min_length", "max_length")


def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole profile records of noisy cells, in the order of keys."""
    noisy = noisy_orders(spark, sf_dir)
    r = profile.record(melt.melt(noisy, "A", order="o_orderkey"), melt.columns(noisy, "A"))
    return r.select("col_id", "original_name", "normalized_name", "observed_type", "column_type", "n_values", "n_distinct", F.array_join("sample", "|").alias("sample"), F.array_join("pattern_hints", ",").alias("hints"), F.array_join("top_frequent.value", "|").alias("top"), F.array_join("first_values.folded", "|").alias("first"), F.round("normalization_score", 6).alias("score"), F.col("normalization_level").alias("level"))


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By count, then by the order of keys, in which rows count here."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return profile.top_values(melt.dictionary(melt.melt(c, "A", order="c_custkey"))).where("col_idx > 0").select("col_idx", F.col("rank").cast("long").alias("rank"), "value", "cnt")


def pattern_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = melt.dictionary(melt.melt(table(spark, sf_dir, "events"), "A", order="event_id"))
    return profile.hints(profile.profile(d), profile.first_distinct(d)).select("col_idx", F.array_join("sample", "|").alias("sample"), F.array_join("pattern_hints", ",").alias("hints"))


def normalization_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = melt.melt(noisy_orders(spark, sf_dir), "A", order="o_orderkey")
    return profile.normalization_score(profile.first_values(cells)).select("col_idx", *(F.round(c, 6).alias(c) for c in ("format_difference", "mixed_type", "dirty_value", "score")), "level")


def column_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared values of each column of orders and lineitem, in all seven views."""
    over = overlap.dictionary_overlaps(written(_dictionary(spark, sf_dir, "orders", "lineitem"), "dictionary")).where("side_a = 'A' and side_b = 'B'")
    return over.select("col_a", "col_b", "view", "shared", "size_a", "size_b", *(F.round(c, 6).alias(c) for c in ("coverage_a", "coverage_b", "jaccard", "overlap_ratio")))


def best_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each column of orders the column of lineitem that covers most of its values."""
    over = overlap.dictionary_overlaps(written(_dictionary(spark, sf_dir, "orders", "lineitem"), "dictionary"), ("raw",)).where("side_a = 'A' and side_b = 'B'")
    best = over.groupBy("col_a").agg(F.max_by("col_b", F.struct("coverage_a", "coverage_b", -F.col("col_b"))).alias("col_b"), F.round(F.max("coverage_a"), 6).alias("coverage"))
    return best.select("col_a", "col_b", "coverage")


def numeric_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark, sf_dir, "customer", "supplier")
    n = overlap.numbers(d)
    return overlap.numeric_similarity(n.where("side = 'A'"), n.where("side = 'B'")).select("col_a", "col_b", F.round("numeric", 5).alias("numeric"))


def numeric_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of large numbers close together, of prices and of small ones."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1_000_000_000_000).alias("id"), "o_totalprice", "o_custkey")
    n = overlap.numbers(melt.dictionary(melt.melt(o, "A")))
    return n.select("col_idx", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def double_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles below a cent, above 10^38, of 16 and more digits and subnormal ones as text."""
    x = F.col("l_extendedprice")
    numbers = {"rate": x * F.col("l_discount") / F.lit(1e7), "large": x * F.lit(1e36), "third": x / F.lit(-3.0), "tiny": F.col("l_quantity") / F.lit(1e308) / F.lit(1e12), "tax": F.col("l_tax")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(melt.double_text(c).alias(name) for name, c in numbers.items()))


def value_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of customer and supplier, with headers, observed types and null ratios in the weighted total."""
    a, b = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    d = written(_dictionary(spark, sf_dir, "customer", "supplier"), "dictionary")
    s, n = written(overlap.signatures(d, ("raw", "prefix")), "signatures"), overlap.numbers(d)
    scores = overlap.value_similarity(overlap.overlaps(s), overlap.numeric_similarity(n.where("side = 'A'"), n.where("side = 'B'")), overlap.sizes(s))
    checked = written(types.checked(melt.columns(a, "A").unionByName(melt.columns(b, "B")).join(profile.profile(d), ["side", "col_idx"], "left")), "columns")
    wide = match.pairs(checked, overlap.overlaps(s), spark.createDataFrame([], "side string, col_idx int"))
    whole = scores.withColumnRenamed("score", "value_score").join(wide, (F.col("col_a") == F.col("s_col_idx")) & (F.col("col_b") == F.col("t_col_idx"))).withColumn("metadata_score", match.metadata_score())
    kinds = types.compatibility_reason(F.col("s_observed_type"), F.col("t_observed_type"))
    return match.weighted_total(whole).select("col_a", "col_b", "value_score", F.array_join("reasons", "; ").alias("value_reasons"), kinds.alias("type_reason"), "header_score", "type_score", F.col("metadata_score").cast("long").alias("metadata_score"), F.round("weighted_total", 6).alias("weighted_total"))


def rows_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderkey").cast("string").alias("b"), F.when(F.col("o_orderkey") % 10 == 0, "changed").otherwise(F.col("o_orderkey").cast("string")).alias("c"))
    return overlap.rows_equal(o, [("a", "b"), ("a", "c")]).select("a", "b", F.round("share", 6).alias("share"))


def reconciliation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two files made from orders: the same fields in other spellings, copies and fillers."""
    k, price, day = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderdate")
    o = table(spark, sf_dir, "orders")
    ref = F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 9, "0"))
    card = F.concat(F.lit("4"), F.lpad(k.cast("string"), 15, "7"))
    words = F.concat_ws(" ", "o_orderpriority", F.concat(F.lit("cust"), F.col("o_custkey").cast("string")), F.concat(F.lit("shop"), (F.col("o_custkey") % 97).cast("string")))
    a = o.select(ref.alias("Txn Ref"), price.alias("Amount"), price.alias("Account Number"), F.date_format(day, "yyyy-MM-dd 10:22:33").alias("Txn Datetime"), card.alias("Card"), F.concat(F.lit("POS purchase "), words).alias("Narration"), F.col("o_orderstatus").alias("Status"), F.concat(F.lit("own"), k.cast("string")).alias("Other"))
    shifted = F.when(k % 5 == 0, F.date_add(day, 20000)).otherwise(day.cast("date"))
    b = o.select(F.lower(ref).alias("Transaction Identifier"), F.concat(F.lit("$"), price, F.lit("00")).alias("Authorized Amount"), F.date_format(shifted, "dd/MM/yyyy").alias("Posting Date"), F.date_format(day, "dd/MM/yyyy").alias("Tran Date"), F.date_format(day, "dd/MM/yyyy").alias("Value Date"), F.concat(F.substring(card, 1, 8), F.lit("xxxx"), F.right(card, F.lit(4))).alias("Masked Card"), F.concat(words, F.lit(" withdrawal atm")).alias("Description"), F.lpad((k % 4).cast("string"), 2, "0").alias("Response Code"), F.concat(F.lit("x"), F.md5(k.cast("string"))).alias("Other Target"))
    return a, b


@functools.lru_cache(maxsize=4)
def _mapping(application: str, sf_dir: str, files: tuple):
    """The mapping of the reconciliation pair, made once for the queries of a session that read parts of it as long as the files stay as they are."""
    return map_columns(*reconciliation(SparkSession.getActiveSession(), sf_dir))


def _stamp(df: DataFrame) -> tuple:
    """The files of a table, with sizes and times of change."""
    return tuple(sorted(tuple(r) for r in df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()))


def _mapped(part):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return part(_mapping(spark.sparkContext.applicationId, sf_dir, _stamp(table(spark, sf_dir, "orders"))))

    return query


def _overrides(c) -> DataFrame:
    """By column: every fourth source is withdrawn, every fourth set to the first target."""
    k = F.regexp_extract("source_id", r"(\d+)", 1).cast("int")
    return c.results.select("source_id", F.when(k % 4 == 1, "B_1").alias("override_id"), k.alias("_k")).where("_k % 4 < 2").drop("_k")


def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("verdict"), F.col("ts").alias("updated_at"), "event_id")
    return review.latest(log, tie="event_id").select("source_id", "verdict", "event_id")


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderkey"])


def row_and_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


MAPPED = {
    "schema_check": lambda c: c.checked.select("side", "col_idx", "observed_type", "column_type", "expected_type", "trust", "shifted", "alignment"),
    "schema_warnings": lambda c: c.warnings.select("side", "code", "severity", "message", F.array_join("affected_columns", ",").alias("affected")),
    "duplicate_columns": lambda c: c.duplicates,
    "candidates": lambda c: match.shortlisted(c.pairs).select("s_col_idx", "t_col_idx", F.round("quick_score", 6).alias("quick_score"), "quick_rank", "plausibility", "type_score", "header_score"),
    "decisions": lambda c: c.decisions.select("s_col_idx", "t_col_idx", "decision", "confidence", "status", "rank", "ambiguous", F.array_join("reason", " | ").alias("reason")),
    "rejected_pairs": lambda c: c.rejected.select("s_col_idx", "t_col_idx", "category", "decision", "confidence", "duplicate_penalty", "rejection_reason", F.array_join("reason", " | ").alias("reason"), *(F.round(x, 4).alias(x) for x in ("source_coverage", "target_coverage"))),
    "match_buckets": lambda c: c.buckets.select("bucket", "category", "s_col_idx", "t_col_idx", "confidence", *(F.round(x, 2).alias(x) for x in ("overlap_score", "transformed_score", "semantic_score")), "low_cardinality", F.col("evidence.exact").cast("long").alias("evidence_exact")),
    "derived_dates": lambda c: c.derived.select("s_col_idx", "t_col_idx", "confidence", "decision"),
    "resolved_conflicts": lambda c: c.resolved.select("s_col_idx", "t_col_idx", "decision", "wins"),
    "mapping_results": lambda c: files.export_rows(c.results),
    "alternatives": lambda c: c.results.select("source_id", F.array_join("alternatives", ",").alias("alternatives"), "ambiguous"),
    "unmatched_sources": lambda c: c.unmatched,
    "reverse_check": lambda c: c.reverse,
    "mapping_summary": lambda c: c.summary,
    "final_mappings": lambda c: review.final_mappings(c.results).withColumn("label", review.confidence_label(F.col("confidence"))),
    "explanations": lambda c: review.explained(c.results),
    "accepted_results": lambda c: review.filtered(c.results, "accepted").select("source_id", "target_id", "category"),
    "overridden_targets": lambda c: review.effective_target(c.results, _overrides(c), c.columns.where("side = 'B'")).select("source_id", "effective_target"),
    "feedback_entries": lambda c: review.feedback_rows(c.results.select("source_id", F.lit("correct").alias("verdict"), F.lit("2026-01-01").cast("timestamp_ntz").alias("updated_at")), c.results, _overrides(c)).select("source_id", "target_id", "verdict", "updated_at"),
}


def queries() -> dict:
    own = [best_target, normalize_values, normalize_dates, value_tokens, value_classes, type_predicates, header_normalize, header_similarity, column_profile, profile_records, top_values, pattern_hints, normalization_score, column_overlap, numeric_similarity, numeric_spread, double_texts, value_similarity, rows_equal, feedback_latest, preview, row_and_column_counts]
    return {f.__name__: f for f in own} | {name: _mapped(part) for name, part in MAPPED.items()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()

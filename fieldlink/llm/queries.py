"""The operators' registered queries, with production parameters over whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, common, langid, licenses, mixing, neardup, packed_ids, quality, sentencepiece_stream, spelling, tiff, token_counts, toxicity, whitening


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(common.id_crc() % 4 == 2, F.lit(False)))
    model = langid.fit(docs.where(common.id_crc() % 4 != 2))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "packed-ids")
    packed_ids.write_files(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packed_ids.read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(common.documents(spark, sf_dir).select("doc_id", "text"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.documents(spark, sf_dir).select("doc_id", "text"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> dict | None:
    """Learned from all docs that have a label and of whose id's crc32 the remainder by 5 isn't 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where((common.id_crc() % 5 != 0) & F.col("toxic").isNotNull())
    # a table of bits, of a bounded size, keeps most texts without a label out of the join
    h = F.xxhash64("doc_id")
    place, bit = F.pmod(h, F.lit(1 << 18)).alias("_place"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, 40) % 64).cast("int"))
    known = labels.select(place, bit.alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    some = docs.select("doc_id", "text", "lang", place).join(F.broadcast(known), "_place").where(F.col("_bits").bitwiseAND(bit) != 0)
    rows = some.select("doc_id", "text", "lang").join(labels.hint("merge"), "doc_id")
    return toxicity.fit(rows, lang="lang", dealt=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(common.id_crc() % 5 == 0, F.lit(False)))
    return toxicity.scored(held, toxicity_model(spark, sf_dir, docs)).drop("text")


def _ids_crc(encoded: DataFrame) -> DataFrame:
    """Replaces ids by their number and the crc32 of their little-endian 32-bit form."""
    import zlib

    keep = [f for f in encoded.schema if f.name != "ids"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), common.starts_of(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=[*(f.name for f in keep), "n_ids", "ids_crc32"])

    from pyspark.sql.types import LongType, StructType

    return encoded.mapInArrow(run, StructType([*keep]).add("n_ids", LongType()).add("ids_crc32", LongType()))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = sentencepiece_stream.decode(sentencepiece_stream.encode(common.documents(spark, sf_dir).select("doc_id", "text")))
    again = F.coalesce(F.col("decoded") == F.regexp_replace(F.coalesce("text", F.lit("")), "▁", " "), F.lit(False))
    return _ids_crc(decoded.select("doc_id", again.alias("round_trip"), "ids"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tiff.pages(tiff.write(common.documents(spark, sf_dir).select("doc_id", "text")))
    # joined as hexadecimal text: in proportion to the payload, where concatenating page by page is not
    payload = F.expr("unhex(array_join(transform(pages, p -> hex(coalesce(p.pixels, cast('' as binary)))), ''))")
    once = read.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.expr("array_join(pages.feature, '|')").alias("feature"), F.size("pages").cast("long").alias("n_pages"), F.explode(F.array(payload)).alias("payload"))
    return once.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "n_pages",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(common.documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.documents(spark, sf_dir).select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.components(rows, "embedding").select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where((common.id_crc() % 5 != 0) & F.col("quality").isNotNull())
    # at most about 8,000 ids
    some = F.broadcast(common.hash_share(labels, "doc_id", 8_000))
    with common.scratch(spark):
        model = attention.fit(common.written(docs.join(some, "doc_id"), "labelled"), cut=0.3)
    held = docs.withColumn("held_out", F.coalesce(common.id_crc() % 5 == 0, F.lit(False)))
    return attention.scored(held, model, cut=0.3).drop("text")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_packed_ids, op4_license_scan, op5_near_duplicates, op6_toxicity, op7_sentencepiece, op8_tiff, op9_quality_rules, op10_mixing, op11_spelling_variants, op12_whitening, op13_quality_attention)}


def oracle_sql() -> dict:
    from . import oracles

    return oracles.oracle_sql()

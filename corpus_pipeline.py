"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, SentencePiece ids.

Each stage takes what its predecessor kept; run() writes each stage's rows to the
shared folder and reads them again. All stages but the last give back the columns of
their input as they are, whatever their names. An empty table goes through as an empty
one; documents without text fail the quality rules; very long texts go through whole. Rows that repeat each other are
near copies, of which one stays; of a component's documents with the same smallest id the one with the
smallest hash of its text stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.llm import common, mixing, neardup, quality, queries, sentencepiece_stream, toxicity


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.accepted(docs)


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those labelled, doesn't take for toxic."""
    return toxicity.left(docs, queries.toxicity_model(spark, sf_dir, docs))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of its smallest id, if it has any."""
    plain, names = common.positional(docs)
    rows = common.numbered(plain, "rows")
    kept = neardup.grouped(rows, doc_id=names["doc_id"], text=names["text"]).where("kept").select("_row")
    return common.named_back(rows.join(kept, "_row", "left_semi"), names)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row with the whole text for each full pass, one with the words of its drawn blocks."""
    return mixing.mixed(docs)


def _sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text of the mix, and whether they decode to it (a literal word mark reads as a space)."""
    decoded = sentencepiece_stream.decode(sentencepiece_stream.encode(docs.select("doc_id", "lang", "source", "text")))
    again = F.coalesce(F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " "), F.lit(False))
    return decoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"), again.alias("round_trip"))


STAGES = [("quality", _quality), ("toxicity", _toxicity), ("near_duplicates", _near_duplicates), ("mixing", _mixing), ("sentencepiece", _sentencepiece)]

#: The classifier and the MinHash bands have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table in the shared folder; all other tables go as soon as they are read."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        with common.scratch(spark) as keep:
            out = keep(common.written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if i:
            common.deleted(spark, [docs._written_at])
        docs = out
    return docs

"""Reading delimited text as text cells, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import delimited

def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter found most often in the first five lines of a file, or of the first of several; the earlier of equals."""
    return delimited.Source(spark, path).delimiters().orderBy("file").first().sep


def read_text_table(spark: SparkSession, path: str, delimiter: str | None = None, order: str | None = None) -> DataFrame:
    """All cells as text; the first row of each file names the columns if it has a cell with a value. Blank rows go, short ones are filled up and long ones cut; broken quotes fail.

    `order` names a further column with a row's place: by file, then by record, however files are split.
    """
    return delimited.table(spark, path, delimiter, order)


def preview(df: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """The first k rows, normalized."""
    from ..operators.melt import to_text

    first = df.orderBy(*order).limit(k)
    rows = first.select(*(to_text(F.col(f"`{f.name}`"), f.dataType).alias(f"_p{i}") for i, f in enumerate(first.schema)))
    for i in range(len(df.columns)):
        rows = V.with_cell(rows, f"_p{i}", f"_p{i}")
    return rows.select(*(F.col(f"_p{i}").alias(name) for i, name in enumerate(df.columns)))


def export_rows(results: DataFrame) -> DataFrame:
    """Mapping rows as they are written: eleven columns (their names are fixed), reasons joined, defaults for what is missing."""
    return results.select(
        F.col("source_id").alias("sourceColumnId"), F.col("source_name").alias("sourceColumnName"), F.col("source_type").alias("sourceObservedType"), F.col("category").alias("mappingCategory"), F.col("decision").alias("finalMappingDecision"),
        F.coalesce("target_id", F.lit("")).alias("targetColumnId"), F.coalesce("target_name", F.lit("")).alias("targetColumnName"), F.coalesce("target_type", F.lit("unknown")).alias("targetObservedType"),
        F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("status", F.lit("unmatched")).alias("status"), F.array_join("reason", " | ").alias("reason"),
    )


def write_csv(results: DataFrame, path: str) -> None:
    export_rows(results).write.csv(path, header=True, quote='"', escape='"')


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.json(path)

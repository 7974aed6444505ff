"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on one machine (a local master) an own folder is made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_folder()
    return found.rstrip("/")


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as rows read back have it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind])
    return T.ArrayType(_nullable(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


#: Rows that small() keeps in the plan.
SMALL = 50_000


def small(df: DataFrame, name: str) -> DataFrame:
    """df computed once: as rows within later plans if they are at most SMALL, else as a table of its own. For frames of a row a column or pair of columns."""
    df = df.to(_nullable(df.schema))
    rows = df.coalesce(1).limit(SMALL + 1).toArrow()
    return written(df, name) if rows.num_rows > SMALL else df.sparkSession.createDataFrame(rows, schema=df.schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: computed once, and later plans start from it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_dir
from ..plans.tables import table as written

__all__ = ["bound_batches", "crc_of_id", "documents", "shared_dir", "sized_broadcast", "written"]

#: Rows and bytes of an Arrow batch sent to Python, so that long texts don't pile up in a worker.
ARROW_ROWS, ARROW_BYTES = 400, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for tables with very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of an id written as text; folds are cut by its remainder."""
    return F.crc32(F.col(doc_id).cast("string"))


def sized_broadcast(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within bound, else as it is."""
    return F.broadcast(df) if rows <= bound else df

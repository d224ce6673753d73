"""A store of maps whose pixels and metadata become visible together.

A commit writes both under a folder of its own name and then makes one small file that names it; readers know only of
commits that have one. Later commits add maps or replace those with the same id. A write that fails leaves a folder that
nobody reads; two writers cannot take the same number.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, name) of the commits of a store, in order."""
    fs, hadoop = _files(spark, path)
    place = hadoop(f"{path}/_commits")
    if not fs.exists(place):
        return []
    found = sorted(int(f.getPath().getName()) for f in fs.listStatus(place) if f.isDirectory())
    return [(n, name) for n in found for name in sorted(f.getPath().getName() for f in fs.listStatus(hadoop(f"{path}/_commits/{n:09d}")))[:1]]


def _publish(spark: SparkSession, path: str, name: str) -> int:
    """Take the next number for a commit: a folder of that name is moved into place, which only one writer can do."""
    fs, hadoop = _files(spark, path)
    fs.mkdirs(hadoop(f"{path}/_commits"))
    ready = hadoop(f"{path}/data/{name}/_commit")
    fs.mkdirs(ready)
    fs.createNewFile(hadoop(f"{path}/data/{name}/_commit/{name}"))
    while True:
        number = max((n for n, _ in commits(spark, path)), default=0) + 1
        place = hadoop(f"{path}/_commits/{number:09d}")
        if not fs.exists(place) and fs.rename(ready, place) and fs.exists(hadoop(f"{path}/_commits/{number:09d}/{name}")):
            return number
        if not fs.exists(ready):
            raise OSError(f"another writer took commit {number} of {path} at the same moment; write again")


def write_maps(px: DataFrame, map_info: DataFrame, path: str, date: str = "date_mean", order: Sequence[str] = ("iy", "ix")) -> int:
    """Add maps, or replace those that are there under their map_id, in one commit; returns its number.

    px: map_id and pixels; map_info: a row a map, with its date, by which both are partitioned. Pixels of maps that
    map_info does not name are not written.
    """
    spark, name = px.sparkSession, uuid.uuid4().hex
    days = map_info.withColumn("map_date", F.to_date(date))
    rows = px.join(days.select("map_id", "map_date"), "map_id")
    at = f"{path}/data/{name}"
    rows.repartition("map_date", "map_id").sortWithinPartitions("map_id", *order).write.partitionBy("map_date").parquet(f"{at}/pixels")
    days.write.partitionBy("map_date").parquet(f"{at}/maps")
    return _publish(spark, path, name)


def read_maps(spark: SparkSession, path: str, start=None, end=None, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pixels, map_info) of the maps of a store, each as of the last commit that wrote it; a date range reads only its
    partitions. upto: as the store was after that commit."""
    known = [(n, name) for n, name in commits(spark, path) if upto is None or n <= upto]
    if not known:
        raise ValueError(f"no commit in {path}")

    def rows(kind: str) -> DataFrame:
        parts = [spark.read.parquet(f"{path}/data/{name}/{kind}").withColumn("__number", F.lit(n)) for n, name in known]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    info = rows("maps")
    last = info.groupBy("map_id").agg(F.max("__number").alias("__number"))
    info, px = info.join(last, ["map_id", "__number"]), rows("pixels").join(last, ["map_id", "__number"])
    if start is not None:
        info, px = (df.where(F.col("map_date").between(F.lit(start), F.lit(end))) for df in (info, px))
    return px.drop("__number"), info.drop("__number")

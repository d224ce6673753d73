"""Registration, and the driver tables in their roles: image catalog, sets, parameters, pixels."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query. Its joins broadcast by hint, or by what a shuffle measured, never by the size of files: a written
    table of many rows may be a small file, and would be drawn into the driver."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
                spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def images(spark: SparkSession, d: str) -> DataFrame:
    """events as an image catalog."""
    return read(spark, d, "events").select(
        F.col("event_id").alias("data_id"),
        F.col("ts").alias("date_obs"),
        F.col("event_type").alias("instrument"),
        F.when(F.col("user_id") % 2 == 0, 193).otherwise(195).alias("wavelength"),
        (2100 + F.col("value") / 100).alias("cr_rot"),
        F.when(F.col("value") > 450, 1).otherwise(0).alias("flag"),
        F.col("value"),
    )


IMAGES = """cat AS (SELECT event_id AS data_id, ts AS date_obs, event_type AS instrument,
  CASE WHEN user_id % 2 = 0 THEN 193 ELSE 195 END AS wavelength, 2100 + value / 100 AS cr_rot,
  CASE WHEN value > 450 THEN 1 ELSE 0 END AS flag, value FROM events)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as membership of parts in orders."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("combo_id"), F.col("l_partkey").alias("data_id")).distinct()


MEMBERS = "mem AS (SELECT DISTINCT l_orderkey AS combo_id, l_partkey AS data_id FROM lineitem)"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as parameters q and d of each supplier and month."""
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("date_mean")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))


MONTHLY = """par AS (SELECT l_suppkey AS supp, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date_mean,
  avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as maps of 20 x 40 pixels: the row of least order and price in each cell.

    Every 2000 order numbers are a series of maps, one a line number, so the number of maps follows the table; map_id
    is ten times the series plus the line number.
    """
    li = read(spark, d, "lineitem").select(
        F.expr("l_orderkey div 2000 * 10 + l_linenumber").alias("map_id"), (F.col("l_suppkey") % 20).cast("int").alias("iy"), (F.col("l_partkey") % 40).cast("int").alias("ix"), "l_orderkey", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity"
    )
    one = li.groupBy("map_id", "iy", "ix").agg(F.min(F.struct("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity")).alias("r"))
    return one.select(
        "map_id", "iy", "ix", F.col("r.l_extendedprice").alias("data"), (1 - F.col("r.l_discount")).alias("mu"),
        F.when(F.col("r.l_returnflag") == "R", 1.0).otherwise(0.0).alias("chd"), F.col("r.l_orderkey").alias("origin_image"), F.col("r.l_quantity").alias("value"),
    )


PIXELS = """px AS (SELECT l_orderkey // 2000 * 10 + l_linenumber AS map_id, CAST(l_suppkey % 20 AS INTEGER) AS iy, CAST(l_partkey % 40 AS INTEGER) AS ix,
  arg_min(l_extendedprice, (l_orderkey, l_extendedprice, l_discount, l_returnflag, l_quantity)) AS data, arg_min(1 - l_discount, (l_orderkey, l_extendedprice, l_discount, l_returnflag, l_quantity)) AS mu,
  arg_min(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, (l_orderkey, l_extendedprice, l_discount, l_returnflag, l_quantity)) AS chd, min(l_orderkey) AS origin_image,
  arg_min(l_quantity, (l_orderkey, l_extendedprice, l_discount, l_returnflag, l_quantity)) AS value FROM lineitem GROUP BY 1, 2, 3)"""


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})

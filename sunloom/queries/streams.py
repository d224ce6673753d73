"""Incremental jobs over the driver tables as streams of files."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import HOUR
from ..operators import hist, selection, tracks
from ..plans.tables import shared_dir
from ..streaming import jobs
from .base import query, read
from .grids import _region_px
from .hists import LIMB_EDGES, PX, Y_EDGES, _full


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's file as a stream; the glob lets one file stand for a folder."""
    return jobs.read_feed(spark, f"{d}/{name[:-1]}[{name[-1]}].parquet", read(spark, d, name).schema)


def _place(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/store", f"{base}/checkpoint"


def _feed(spark: SparkSession, df: DataFrame, name: str, files: int, *cut: str) -> tuple[str, str, str]:
    """A table cut into files by a hash: feed, store and checkpoint folders."""
    store, checkpoint = _place(spark, name)
    df.repartition(files, *cut).write.parquet(f"{store}-feed")
    return f"{store}-feed", store, checkpoint


@query(f"WITH {PX}, {_full('data_id')} SELECT * FROM hb")
def t1_update_histograms(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of every image come in several files, a file a batch."""
    px = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("data_id"), hist.log_intensity(F.col("l_extendedprice")).alias("value"), "l_orderkey")
    feed, store, checkpoint = _feed(spark, px, "t1", 4, "l_orderkey")
    jobs.update_histograms(jobs.read_feed(spark, feed, px.schema, 1), store, checkpoint, "value", Y_EDGES, ["data_id"])
    return jobs.histograms(spark, store).select("data_id", "i_int", "n")


MU = [0.1 + 0.09 * k for k in range(11)]


def _image_px(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as pixels of images (instrument and month): mu from 0.1 to 1 by discount, log price as intensity."""
    return read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("instrument"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("date_obs"), (1.0 - 9 * F.col("l_discount")).alias("mu"),
        (hist.log_intensity(F.col("l_extendedprice")) - 2).alias("value"), "l_orderkey",
    )


def _chain(spark: SparkSession, d: str, runs: int, step) -> None:
    """The feed of image pixels arrives in parts that do not follow dates; step(store) runs after each."""
    px = _image_px(spark, d)
    store, checkpoint = _place(spark, "chain")
    edges = [m - 0.045 for m in MU] + [MU[-1] + 0.045]
    part = F.pmod(F.xxhash64("l_orderkey"), F.lit(runs))
    for k in range(runs):
        px.where(part == k).repartition(2, "l_orderkey").write.mode("append").parquet(f"{store}-feed")
        jobs.update_histograms(jobs.read_feed(spark, f"{store}-feed", px.schema, 2), store, checkpoint, "value", LIMB_EDGES, ["instrument", "date_obs"], "mu", edges)
        step(store)


@query()
def t1_update_limb(spark: SparkSession, d: str) -> DataFrame:
    """Histograms and then limb fits of all weeks, after each of two parts of the feed."""
    fits = _place(spark, "limb")[0]
    centers = selection.weekly_centers(spark, datetime(1995, 1, 1), datetime(2002, 1, 1))
    _chain(spark, d, 2, lambda store: jobs.update_limb(spark, store, fits, centers, LIMB_EDGES, MU, "power_log", max_rounds=20))
    found = jobs.coefficients(spark, fits)
    return found.select("instrument", "center", "params", "sse", "rounds", "status")


@query()
def t2_update_fits(spark: SparkSession, d: str) -> DataFrame:
    """Scaling coefficients after each of two parts of the feed, up to the last centre of the limb fits."""
    limb, fits = _place(spark, "limb")[0], _place(spark, "scaling")[0]
    centers = selection.weekly_centers(spark, datetime(1995, 1, 1), datetime(2002, 1, 1))

    def step(store: str) -> None:
        jobs.update_limb(spark, store, limb, centers.where("year(center) < 2001"), LIMB_EDGES, MU, "power_log", max_rounds=4)
        jobs.update_scaling(spark, store, fits, centers, "R", LIMB_EDGES, limit=limb)

    _chain(spark, d, 2, step)
    return jobs.coefficients(spark, fits).select("instrument", "center", "alpha", "x")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS map_date, event_type AS instrument, min(value) AS data, count(*) AS n FROM events GROUP BY 1, 2")
def t3_update_maps(spark: SparkSession, d: str) -> DataFrame:
    store, checkpoint = _place(spark, "t3")

    def build(batch: DataFrame) -> DataFrame:
        days = batch.select(F.to_date("ts").alias("map_date")).distinct()
        every = read(spark, d, "events").withColumn("map_date", F.to_date("ts")).join(days, "map_date", "left_semi")
        return every.groupBy("map_date", F.col("event_type").alias("instrument")).agg(F.min("value").alias("data"), F.count("*").alias("n"))

    jobs.update_maps(_stream(spark, d, "events"), store, checkpoint, build)
    return spark.read.parquet(store).select("map_date", "instrument", "data", "n")


@query()
def t4_track_stream(spark: SparkSession, d: str) -> DataFrame:
    """Regions with their overlaps as a stream of files, tracked frame by frame."""
    px = _region_px(spark, d)
    ts = lambda c: F.timestamp_micros(F.col(c).cast("long") * 2 * HOUR)
    size = px.groupBy("frame", "region").agg(F.sum("da").alias("size"))
    run = F.floor(F.col("frame") / 10).alias("run")  # a series of maps
    over = tracks.window_overlaps(size.select(run, "frame", ts("frame").alias("ts")), px.select(run, "frame", "region", "iy", "ix", "da"), 168.0)
    old = over.groupBy("frame", "region").agg(F.collect_list(F.struct("old_frame", "old_region", "share_new", "share_old")).alias("old"))
    links = size.select("frame", "region").join(old, ["frame", "region"], "left").select(run, "frame", ts("frame").alias("ts"), F.col("region").cast("long").alias("region"), "old")
    store, checkpoint = _place(spark, "t4")
    # a series lies in one file, its frames in order
    links.repartition("run").sortWithinPartitions("run", "frame", "region").write.parquet(f"{store}-links")
    feed = jobs.read_feed(spark, f"{store}-links", links.schema)
    jobs.run_batches(jobs.track_stream(feed, 0.1, 168.0), checkpoint, lambda batch, n: batch.write.mode("append").parquet(store))
    return spark.read.parquet(store)


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events), c AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT start, event_type, n FROM c, m WHERE start + INTERVAL 1 HOUR <= w""")
def t5_feed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has closed."""
    store, checkpoint = _place(spark, "t5")
    feed = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.run_batches(jobs.feed_counts(feed), checkpoint, lambda batch, n: batch.write.mode("append").parquet(store))
    return spark.read.parquet(store).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events),
  g AS (SELECT event_type AS key, ts, round((epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts), epoch_us(TIMESTAMP '2024-01-01') - 1800000000)) / 1800000000::DOUBLE - 1) AS missing FROM events)
  SELECT key, ts AS at, CAST(missing AS BIGINT) AS missing FROM g, m WHERE epoch_ms(ts) <= epoch_ms(w)""")
def t5_feed_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps before the observations that the watermark has passed; events come by day, a file each five days."""
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    store, checkpoint = _place(spark, "t5g")
    for k in range(7):
        events.where(F.floor((F.dayofmonth("ts") - 1) / 5) == k).coalesce(1).write.mode("append").parquet(f"{store}-feed")
    feed = jobs.read_feed(spark, f"{store}-feed", events.schema, 1)
    jobs.run_batches(jobs.feed_gaps(feed, 0.5, datetime(2024, 1, 1), by="event_type"), checkpoint, lambda batch, n: batch.write.mode("append").parquet(store))
    return spark.read.parquet(store).where("kind = 'final'").select("key", F.col("at").cast("timestamp_ntz").alias("at"), "missing")


@query("""SELECT event_id, value < 60 OR (value > 400 AND ts < TIMESTAMP '2024-01-15') OR value = 0 AS bad FROM events""")
def t5_feed_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of images as their moments arrive."""
    rules = spark.createDataFrame([("x", 60.0, 400.0, datetime(2024, 1, 15))], "instrument string, min_sum double, max_mean double, until timestamp_ntz")
    store, checkpoint = _place(spark, "t5f")
    feed = _stream(spark, d, "events").select("event_id", F.lit("x").alias("instrument"), F.col("ts").cast("timestamp_ntz").alias("date_obs"), F.col("value").alias("hist_sum"), F.col("value").alias("hist_mean"))
    jobs.run_batches(jobs.feed_flags(feed, rules), checkpoint, lambda batch, n: batch.write.mode("append").parquet(store))
    return spark.read.parquet(store).select("event_id", "bad")

"""Choosing observations for target times."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, at_micros, micros
from ..plans.asof import bucketed_range_join
from ..plans.tables import table


def time_grid(spark: SparkSession, start: datetime, end: datetime, hours: float, align: bool = False) -> DataFrame:
    """`center`: start, start + hours, ... up to end; align: from the next multiple of hours after midnight."""
    step = round(hours * 3_600_000_000)
    first, last = micros(F.lit(start)), micros(F.lit(end))
    if align:
        day = F.floor(first / DAY) * DAY
        first = day + F.ceil((first - day) / step) * step
    n = F.floor((last - first) / step)
    return spark.range(1).select(F.explode(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<bigint>"))).alias("i")).select(at_micros((first + F.col("i") * step).cast("long")).alias("center"))


def weekly_centers(spark: SparkSession, start: datetime, end: datetime, weekday: str = "MON") -> DataFrame:
    """Midnights of a weekday, from the first on or after start, over floor(days / 7) + 1 weeks up to end."""
    first = F.next_day(F.date_sub(F.to_date(F.lit(start)) + F.when(F.lit(start) > F.to_date(F.lit(start)), 1).otherwise(0), 1), weekday)
    days = F.datediff(F.to_date(F.lit(end)), first)
    weeks = F.when(days >= 0, F.sequence(F.lit(0), F.floor(days / 7).cast("int"))).otherwise(F.array().cast("array<int>"))
    return spark.range(1).select(first.alias("d"), F.explode(weeks).alias("i")).select(F.date_add("d", F.col("i") * 7).cast("timestamp_ntz").alias("center"))


def choose_cadence(obs: DataFrame, centers: DataFrame, half_minutes: float, time: str = "date_obs", by: Sequence[str] = (), center: str = "center", key: str = "data_id", max_group: int = 2_000_000) -> DataFrame:
    """Per centre and group, the observation closest to it within half_minutes, both ends in; the earliest on ties.

    An observation serves one centre. Where windows are apart this is one aggregation; where they touch or overlap,
    centres choose in order, group by group in Python; a group over max_group rows is refused there.
    """
    half = round(half_minutes * 60e6)
    c = centers.select(F.col(center), micros(F.col(center)).alias("__c"))
    gaps = c.select((F.col("__c") - F.lag("__c").over(Window.orderBy("__c"))).alias("g")).agg(F.min("g").alias("g")).first().g  # targets are few
    o = obs.withColumn("__t", micros(F.col(time)))
    spans = c.withColumns({"__lo": F.col("__c") - half, "__hi": F.col("__c") + half})
    pairs = bucketed_range_join(o, spans, "__t", "__lo", "__hi", max(1, 2 * half))
    if gaps is None or gaps > 2 * half:
        best = pairs.groupBy(*by, center).agg(F.min_by(F.struct(*obs.columns), F.struct(F.abs(F.col("__t") - F.col("__c")), F.col("__t"), F.col(key))).alias("o"))
        return best.select(center, "o.*")
    group = list(by) or ["__one"]
    pairs = pairs if by else pairs.withColumn("__one", F.lit(0))
    most = pairs.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most > max_group:
        raise ValueError(f"a group has {most} candidates for overlapping windows; the limit is {max_group}")

    wanted = [center, *obs.columns]

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(__gap=(rows["__t"] - rows["__c"]).abs()).sort_values(["__c", "__gap", "__t", key])
        used, done, keep = set(), set(), []
        for i, at, k in zip(rows.index, rows["__c"], rows[key], strict=True):
            if at not in done and k not in used:
                done.add(at)
                used.add(k)
                keep.append(i)
        return rows.loc[keep, wanted]

    schema = pairs.select(wanted).schema
    return pairs.groupBy(*group).applyInPandas(pick, schema)


def select_synchronic(images: DataFrame, targets: DataFrame, instruments: Sequence[str], half_minutes: float, time: str = "date_obs", target: str = "center", nearest: int | None = None) -> DataFrame:
    """Per target time one image an instrument, the set that is closest in time to itself and to the target.

    The cost is the sum of squared gaps in days over all pairs of images, and of each image to the target. Instruments
    without an image in the window drop out; the first combination in order of time wins ties. nearest: only that
    many images of an instrument are tried (None: all, which is exact).
    """
    half = round(half_minutes * 60e6)
    spans = targets.select(F.col(target), micros(F.col(target)).alias("__c")).withColumns({"__lo": F.col("__c") - half, "__hi": F.col("__c") + half})
    o = images.where(F.col("instrument").isin(list(instruments))).select("data_id", "instrument", F.col(time), micros(F.col(time)).alias("__t"))
    near = bucketed_range_join(o, spans, "__t", "__lo", "__hi", max(1, 2 * half))
    if nearest is not None:
        w = Window.partitionBy(target, "instrument").orderBy(F.abs(F.col("__t") - F.col("__c")), "__t", "data_id")
        near = near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= nearest)
    near = table(near.select(target, "instrument", "data_id", "__t", "__c"), "synchronic_near")
    day = float(DAY)
    firsts = near.groupBy(target, "__c", "instrument").agg(F.min_by("__t", F.struct(F.abs(F.col("__t") - F.col("__c")), "__t", "data_id")).alias("__t"))
    square = lambda a, b: F.pow((a - b) / day, 2)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    bound = total("__ts", lambda x: square(x, F.col("__c"))) + total("__ts", lambda x: total("__ts", lambda y: square(x, y))) / 2
    bounds = firsts.groupBy(target, "__c").agg(F.collect_list("__t").alias("__ts")).select(target, (bound * (1 + 1e-9) + 1e-14).alias("__most"))
    near = near.join(bounds, target).where(square(F.col("__t"), F.col("__c")) <= F.col("__most"))
    found = targets.select(F.col(target), micros(F.col(target)).alias("__c")).join(bounds, target, "left")
    one = F.struct(F.col("data_id"), F.col("__t").alias("t"))
    found = found.withColumns({"__cost": F.lit(0.0), "__set": F.array().cast("array<struct<data_id:bigint,t:bigint>>")})
    for name in instruments:
        mine = near.where(F.col("instrument") == name).select(target, one.alias("__x"))
        found = found.join(mine, target, "left")
        gap = F.aggregate("__set", F.lit(0.0), lambda s, x: s + F.pow((F.col("__x.t") - x["t"]) / day, 2)) + F.pow((F.col("__x.t") - F.col("__c")) / day, 2)
        found = found.withColumn("__cost", F.col("__cost") + F.coalesce(gap, F.lit(0.0))).withColumn("__set", F.when(F.col("__x").isNull(), F.col("__set")).otherwise(F.array_append("__set", F.col("__x")))).drop("__x")
        found = found.where(F.col("__most").isNull() | (F.col("__cost") <= F.col("__most")))
    best = found.groupBy(target).agg(F.min_by("__set", F.struct(F.round("__cost", 15), F.transform("__set", lambda x: x["t"]), "__set")).alias("__set"))
    picked = best.select(target, F.explode("__set").alias("x")).select(target, F.col("x.data_id").alias("data_id"))
    return picked.join(images, "data_id").select(target, *images.columns)


def selection_log(targets: DataFrame, candidates: DataFrame, existing: DataFrame, instruments: Sequence[str], half_minutes: float, failed: DataFrame | None = None) -> DataFrame:
    """(center, instrument, data_id, result) for every target and instrument.

    result: -1 no image in range, 0 new, 1 failed, 2 already there, 3 there with another image, so replaced.
    Candidates whose url names a no-data folder are left out. existing and failed: (center, instrument, data_id).
    """
    ok = candidates.where(~F.coalesce(F.contains("url", F.lit("NoDataDirectory")), F.lit(False)))
    chosen = select_synchronic(ok, targets, instruments, half_minutes).select("center", "instrument", "data_id")
    grid = targets.select("center").withColumn("instrument", F.explode(F.array(*map(F.lit, instruments))))
    out = grid.join(chosen, ["center", "instrument"], "left").join(existing.select("center", "instrument", F.col("data_id").alias("old")), ["center", "instrument"], "left")
    bad: Column = F.lit(False)
    if failed is not None:
        out = out.join(failed.select("center", "instrument", "data_id", F.lit(True).alias("bad")), ["center", "instrument", "data_id"], "left")
        bad = F.coalesce("bad", F.lit(False))
    code = F.when(F.col("data_id").isNull(), -1).when(bad, 1).when(F.col("old") == F.col("data_id"), 2).when(F.col("old").isNotNull(), 3).otherwise(0)
    return out.select("center", "instrument", "data_id", code.alias("result"))

"""Data quality: gaps, outliers, image flags, comparison of stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import HOUR, micros
from ..plans.order import counted_upto


def gaps(obs: DataFrame, cadence_hours: float, start, time: str = "date_obs", by: Sequence[str] = ()) -> DataFrame:
    """obs with `missing`: observations lost since the one before, (gap / cadence) - 1 rounded; the first gap counts
    from start less one cadence (W3)."""
    t, step = micros(F.col(time)), cadence_hours * HOUR
    before = F.coalesce(F.lag(t).over(Window.partitionBy(*by).orderBy(time)), micros(F.lit(start)) - step)
    return obs.withColumn("missing", F.round((t - before) / step - 1).cast("long"))


def outliers(df: DataFrame, col: str, by: Sequence[str], k: float = 3.0) -> DataFrame:
    """Rows further than k population deviations from their group's mean."""
    stats = df.groupBy(*by).agg(F.avg(col).alias("__m"), F.stddev_pop(col).alias("__s"))
    return df.join(stats, list(by)).where(F.abs(F.col(col) - F.col("__m")) > k * F.col("__s")).select(df.columns)


def flag_images(moments: DataFrame, rules: DataFrame) -> DataFrame:
    """moments with `bad`: the sum is zero, or under its instrument's min_sum, or the mean is over max_mean before the
    date `until` (W8). rules: instrument, min_sum, max_mean, until; an instrument without rules has the first test."""
    r = moments.join(rules, "instrument", "left")
    low = F.coalesce(F.col("hist_sum") < F.col("min_sum"), F.lit(False))
    bright = F.coalesce((F.col("hist_mean") > F.col("max_mean")) & (F.col("date_obs") < F.col("until")), F.lit(False))
    return r.withColumn("bad", F.coalesce(F.col("hist_sum") == 0, F.lit(False)) | low | bright).select(*moments.columns, "bad")


def frames_in_window(frames: DataFrame, hours: float, time: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """frames with `in_window`: frames in the trailing time window that ends at each, itself included."""
    span = round(hours * HOUR)
    keys = [f"__k{i}" for i in range(len(by))]
    key = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    times = frames.select(*key, micros(F.col(time)).alias("__t")).groupBy(*keys, "__t").agg(F.count("*").alias("__n"))
    # what lies up to the end, less what lies up to the last moment before the window; a window frame would count each anew
    marks = F.array(F.struct(F.col("__t").alias("at"), F.col("__n").alias("n"), F.lit(1).alias("sign")), F.struct((F.col("__t") - span - 1).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign")))
    line = times.select(*keys, "__t", F.explode(marks).alias("m")).select(*keys, "__t", "m.at", "m.n", "m.sign")
    got = counted_upto(line, "at", "n", keys).groupBy(*keys, "__t").agg(F.when(F.col("__t").isNull(), F.sum("n")).otherwise(F.sum(F.col("sign") * F.col("upto"))).alias("in_window"))
    rows, on = frames.withColumn("__f", micros(F.col(time))), F.col("__f").eqNullSafe(F.col("__t"))
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return rows.join(got, on).select(*frames.columns, "in_window")


def diff_stores(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: only in one store, or with other values."""
    x = a.select(*keys, F.struct(*values).alias("__a"))
    y = b.select(*keys, F.struct(*values).alias("__b"))
    both = x.join(y, list(keys), "full")
    kind = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return both.select(*keys, kind.alias("difference")).where(F.col("difference").isNotNull())

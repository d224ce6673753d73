"""As-of joins as one union and windows over ranges, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import carried


def asof_bracket(left: DataFrame, right: DataFrame, left_time: str, right_time: str, payload: Sequence[str], left_by: Sequence[str] = (), right_by: Sequence[str] | None = None) -> DataFrame:
    """left with `before` and `after`: structs (time, payload) of the nearest right rows at or before, and at or after.

    A row at the same time is both. Of right rows at one time the least payload counts. A side without a row is null,
    and so is a null time's. Ranges of group and time are dealt over the cluster, so a large group is no large task.
    Without groups, each time that is asked is looked up once.
    """
    if not left_by:
        return _bracket_all(left, right, left_time, right_time, payload)
    right_by = list(left_by if right_by is None else right_by)
    keys = [f"__k{i}" for i in range(len(left_by))]
    key_l = [F.col(c).alias(k) for c, k in zip(left_by, keys, strict=True)]
    key_r = [F.col(c).alias(k) for c, k in zip(right_by, keys, strict=True)]
    found = right.where(F.col(right_time).isNotNull()).select(*key_r, F.col(right_time).alias("__t"), F.struct(F.col(right_time).alias("time"), *payload).alias("__r"))
    found = found.groupBy(*keys, "__t").agg(F.min("__r").alias("__r")).withColumn("__l", F.lit(None).cast(left.schema))
    asked = left.select(*key_l, F.col(left_time).alias("__t"), F.lit(None).cast(found.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    # rows of one time are found alike by all that ask there
    line = carried(found.unionByName(asked), "__t", "__r", by=keys)
    return line.where(F.col("__l").isNotNull()).select("__l.*", "before", "after")


def _bracket_all(left: DataFrame, right: DataFrame, left_time: str, right_time: str, payload: Sequence[str]) -> DataFrame:
    """asof_bracket without groups, by ranges of time."""
    found = right.where(F.col(right_time).isNotNull()).select(F.col(right_time).alias("__t"), F.struct(F.col(right_time).alias("time"), *payload).alias("__r")).groupBy("__t").agg(F.min("__r").alias("__r"))
    asked = left.select(F.col(left_time).alias("__t")).where("__t IS NOT NULL").distinct().withColumn("__r", F.lit(None).cast(found.schema["__r"].dataType))
    line = found.unionByName(asked).groupBy("__t").agg(F.max("__r").alias("__r"))
    both = carried(line, "__t", "__r").drop("__r")
    return left.join(both, F.col(left_time) == F.col("__t"), "left").drop("__t")


def _number(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")).cast("double")


def interp_params(left: DataFrame, right: DataFrame, left_time: str, right_time: str, params: Sequence[str], left_by: Sequence[str] = (), right_by: Sequence[str] | None = None, max_gap_days: float | None = None) -> DataFrame:
    """left with each parameter of right, linear in time between the bracketing rows.

    Only one side: its value; the same time: its value; none: null. max_gap_days: null where the brackets lie
    further from the asked time (J6's windows).
    """
    both = asof_bracket(left, right, left_time, right_time, params, left_by, right_by)
    t, t0, t1 = _number(F.col(left_time)), _number(F.col("before.time")), _number(F.col("after.time"))
    near = F.lit(True)
    if max_gap_days is not None:
        most = max_gap_days * 86_400e6
        near = F.coalesce(t - t0 <= most, F.lit(True)) & F.coalesce(t1 - t <= most, F.lit(True))
    share = F.when(t1 > t0, (t - t0) / (t1 - t0))
    cols = []
    for p in params:
        a, b = F.col(f"before.{p}"), F.col(f"after.{p}")
        cols.append(F.when(near, F.when(share.isNotNull(), a + (b - a) * share).otherwise(F.coalesce(a, b))).alias(p))
    return both.select(*left.columns, *cols)


def extrapolate_params(left: DataFrame, right: DataFrame, left_time: str, right_time: str, params: Sequence[str], by: Sequence[str] = (), days: float = 7.0) -> DataFrame:
    """Inside the range, interpolation with brackets at most `days` away (else null); outside, the line through
    the two first or last rows of the group, or its one row."""
    inside = interp_params(left, right, left_time, right_time, params, by, max_gap_days=days)
    rows = right.where(F.col(right_time).isNotNull()).select(*by, F.struct(F.col(right_time).alias("time"), *params).alias("__s"))
    outer = rows.groupBy(*by).agg(F.min("__s").alias("a"), F.max("__s").alias("z"))
    inner = rows.join(outer, list(by)) if by else rows.crossJoin(F.broadcast(outer))  # one row
    inner = inner.groupBy(*by).agg(F.min(F.when(F.col("__s.time") > F.col("a.time"), F.col("__s"))).alias("b"), F.max(F.when(F.col("__s.time") < F.col("z.time"), F.col("__s"))).alias("y"))
    ends = outer.join(inner, list(by)) if by else outer.crossJoin(F.broadcast(inner))  # one row
    joined = inside.join(ends, list(by), "left") if by else inside.crossJoin(F.broadcast(ends))  # one row
    t = _number(F.col(left_time))

    def line(p: str, first: str, second: str) -> Column:
        x0, x1, y0, y1 = _number(F.col(f"{first}.time")), _number(F.col(f"{second}.time")), F.col(f"{first}.{p}"), F.col(f"{second}.{p}")
        return F.when(x1.isNull() | (x0 == x1), y0).otherwise(y0 + (y1 - y0) * (t - x0) / (x1 - x0))

    cols = [F.when(t < _number(F.col("a.time")), line(p, "a", "b")).when(t > _number(F.col("z.time")), line(p, "z", "y")).otherwise(F.col(p)).alias(p) for p in params]
    return joined.select(*left.columns, *cols)


def asof_nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, payload: Sequence[str], left_by: Sequence[str] = (), right_by: Sequence[str] | None = None) -> DataFrame:
    """left with `nearest`: the right row closest in time, the earlier one on ties."""
    both = asof_bracket(left, right, left_time, right_time, payload, left_by, right_by)
    t, a, b = _number(F.col(left_time)), _number(F.col("before.time")), _number(F.col("after.time"))
    first = b.isNull() | F.coalesce(t - a <= b - t, F.lit(False))
    return both.select(*left.columns, F.when(first, F.col("before")).otherwise(F.col("after")).alias("nearest"))


def bucketed_range_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of points and spans with lo <= at <= hi, as an equi-join on buckets of a width (a span goes to each bucket
    that it touches; choose the width near the spans' length)."""
    p = points.withColumn("__bucket", F.floor(F.col(at) / width).cast("long"))
    s = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long"))))
    return p.join(s, ["__bucket", *by]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("__bucket")

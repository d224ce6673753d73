"""Work along one order of all rows without a single task: range partitions, and one carried row a partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import table


def ranged(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """df dealt into ranges of an order and written, with `__part`, the number of its range; rows of equal order share
    one. parts: ranges at most, by default the shuffle partitions."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "number", parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """df with the place of each row in an order, within its group, from 1: its place in its range, and the group's rows
    of the ranges before."""
    rows = ranged(df, *by, *order, parts=parts)
    sizes = _borders(rows, by, F.count("*").alias("__s"))
    starts = sizes.select("__part", *by, F.sum("__s").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    return _across(rows.withColumn("__own", own), starts, by).select(*df.columns, (F.coalesce("__start", F.lit(0)) + F.col("__own")).alias(name))


def _borders(rows: DataFrame, by: Sequence[str], *values: Column) -> DataFrame:
    """(__part, by, values) of the groups that lie in more than one range: two rows a range at most, since ranges follow
    the groups."""
    sums = rows.groupBy("__part", *by).agg(*values)
    return sums.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where("__n > 1").drop("__n") if by else sums


def _across(rows: DataFrame, borders: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of their range and group in borders, null where there are none."""
    right = F.broadcast(borders.select(F.col("__part").alias("__at"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[c for c in borders.columns if c not in ("__part", *by)]))
    on = F.col("__part") == F.col("__at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return rows.join(right, on, "left")


def carried(line: DataFrame, at: str, value: str, parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """line with `before` and `after`: the nearest value that isn't null at or before, and at or after, each row's `at`,
    within its group. Peers of one `at` must not differ in their value.

    Rows with a null `at` have none. Within a range it is a window, read once from either end, so its cost follows the
    rows; over ranges, the last and the first value of each are carried, two rows a range at most.
    """
    rows = ranged(line, *by, at, parts=parts)
    known = F.col(at).isNotNull() & F.col(value).isNotNull()
    ends = _borders(rows, by, F.min_by(value, F.when(known, F.col(at))).alias("__f"), F.max_by(value, F.when(known, F.col(at))).alias("__l"))
    up, down = Window.partitionBy(*by).orderBy("__part"), Window.partitionBy(*by).orderBy(F.desc("__part"))
    beside = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumns({"__last": beside("__l", up), "__first": beside("__f", down)}).drop("__f", "__l")
    group = Window.partitionBy("__part", *by)
    near = lambda w: F.last(F.when(F.col(at).isNotNull(), F.col(value)), ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # the frame after a row is read from the far end: one that ends unbounded is gone through anew for every row
    seen = rows.withColumn("__up", near(group.orderBy(at))).withColumn("__down", near(group.orderBy(F.desc(at))))
    has = F.col(at).isNotNull()
    return _across(seen, ends, by).select(*line.columns, F.when(has, F.coalesce("__up", "__last")).alias("before"), F.when(has, F.coalesce("__down", "__first")).alias("after"))


def counted_upto(line: DataFrame, at: str, n: str, by: Sequence[str] = (), name: str = "upto", parts: int | None = None) -> DataFrame:
    """line with the sum of n over its group's rows up to each row's `at`, peers included."""
    rows = ranged(line, *by, at, parts=parts)
    sums = _borders(rows, by, F.sum(n).alias("__s"))
    sums = sums.select("__part", *by, F.sum("__s").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__start"))
    own = F.sum(n).over(Window.partitionBy("__part", *by).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return _across(rows.withColumn("__own", own), sums, by).select(*line.columns, (F.col("__own") + F.coalesce("__start", F.lit(0))).alias(name))


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), bins: int = 1024, bound: int = 100_000) -> DataFrame:
    """by and `quantiles`, an array with the interpolated quantile of each q, as percentile() gives them, without a
    buffer of a group's values. Nulls and NaN don't count; a group without values has no row.

    Each quantile lies between two ranks. A round counts the values of every rank's interval in even bins and goes on
    with the bin that holds the rank, from its least value to its greatest, until those are equal.
    """
    v = F.col(value).cast("double")
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("__k0")]
    names = [f"__k{i}" for i in range(len(by) or 1)]
    rows = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    ends = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(s).alias("side"), f(F.lit(float(q)) * (F.col("n") - 1)).cast("long").alias("rank"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(qs) for s, f in ((0, F.floor), (1, F.ceil))])
    state = table(ends.withColumn("r", F.explode(ranks)).select(*names, "r.q", "r.side", "r.rank", "r.at", "lo", "hi"), "ranks")
    done = []
    same = lambda a: F.col(f"__s{a[3:]}").eqNullSafe(F.col(a))
    while True:
        ready = table(state.where("lo = hi").select(*names, "q", "side", "at", F.col("lo").alias("v")), "ranks_done")
        done.append(ready)
        todo = state.where("lo < hi")
        if todo.isEmpty():
            break
        todo = table(todo, "ranks")
        asked = todo.select(*[F.col(c).alias(f"__s{c[3:]}") for c in names], "rank", "lo", "hi").distinct()  # two a quantile and group
        asked = F.broadcast(asked) if todo.count() <= bound else asked
        on = F.lit(True)
        for c in names:
            on = on & same(c)
        met = rows.join(asked, on & F.col("__v").between(F.col("lo"), F.col("hi")))
        step = F.least(F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = met.groupBy(*names, "rank", "lo", "hi", step.alias("b")).agg(F.count("*").alias("n"), F.min("__v").alias("a"), F.max("__v").alias("z"))
        upto = F.sum("n").over(Window.partitionBy(*names, "rank", "lo", "hi").orderBy("b"))
        hit = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        hit = hit.select(*[F.col(c).alias(f"__s{c[3:]}") for c in names], F.col("rank").alias("r"), F.col("lo").alias("l"), F.col("hi").alias("h"), (F.col("rank") - F.col("upto") + F.col("n")).alias("left"), "a", "z")
        state = todo.join(hit, on & (F.col("rank") == F.col("r")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")))
        state = table(state.select(*names, "q", "side", F.col("left").alias("rank"), "at", F.col("a").alias("lo"), F.col("z").alias("hi")), "ranks")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    pair = every.groupBy(*names, "q").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("y"), F.max("at").alias("at"))
    part = F.col("at") - F.floor("at")
    pair = pair.select(*names, "q", F.when(part == 0, F.col("x")).otherwise((1 - part) * F.col("x") + part * F.col("y")).alias("v"))
    out = pair.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda s: s["v"]).alias("quantiles"))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(by)], "quantiles")

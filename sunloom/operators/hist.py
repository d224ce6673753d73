"""Histograms as bin tables: building, windows, transforms, scores and fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.photometry import LIMB_MODELS, limb_factors
from ..functions.times import DAY, micros
from ..plans.asof import bucketed_range_join
from ..plans.order import exact_quantiles, row_numbers
from ..plans.tables import table


def hist_to_bins(hists: DataFrame, key: str = "hist_id", counts: str = "hist", n_int: str = "n_intensity_bins") -> DataFrame:
    """Stored histograms as rows (key, i_mu, i_int, n); counts run over intensity first."""
    rows = hists.select(key, F.col(n_int).alias("__n"), F.posexplode(counts).alias("__p", "n"))
    return rows.select(key, F.floor(F.col("__p") / F.col("__n")).cast("int").alias("i_mu"), (F.col("__p") % F.col("__n")).cast("int").alias("i_int"), "n")


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the even bin of a value; the last bin holds its upper edge, values outside have none."""
    n, lo, hi = len(edges) - 1, float(edges[0]), float(edges[-1])
    inside = value.between(lo, hi) & ~F.isnan(value)
    return F.when(inside, F.least(F.floor((value - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int"))


def hist2d(px: DataFrame, by: Sequence[str], x: Column, x_edges: Sequence[float], y: Column, y_edges: Sequence[float]) -> DataFrame:
    """Counts (by, i_x, i_y, n) over the full grid of even bins; values outside it or null are dropped (A1)."""
    binned = px.select(*by, bin_of(x, x_edges).alias("i_x"), bin_of(y, y_edges).alias("i_y"))
    seen = binned.where("i_x IS NOT NULL AND i_y IS NOT NULL").groupBy(*by, "i_x", "i_y").agg(F.count("*").alias("n"))
    grid = px.select(*by).distinct().withColumn("i_x", F.explode(F.sequence(F.lit(0), F.lit(len(x_edges) - 2)))).withColumn("i_y", F.explode(F.sequence(F.lit(0), F.lit(len(y_edges) - 2))))
    return grid.join(seen, [*by, "i_x", "i_y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def log_intensity(value: Column, floor: float = 1e-8) -> Column:
    """log10 of an intensity; 0 and less count as floor."""
    return F.log10(F.when(value <= 0, floor).otherwise(value))


def image_hist(px: DataFrame, mu_bins: int = 18, int_bins: int = 200, band: float = 0.04908738521234052, mu_range=(0.1, 1.0), int_range=(0.0, 5.0)) -> DataFrame:
    """Histogram of mu by log intensity of each image in a band of latitude, ends in (A1)."""
    edges = [[lo + (hi - lo) * k / n for k in range(n + 1)] for n, (lo, hi) in ((mu_bins, mu_range), (int_bins, int_range))]
    inside = px.where(F.col("lat").between(-band, band))
    return hist2d(inside, ["data_id"], F.col("mu"), edges[0], log_intensity(F.col("data")), edges[1])


def hist1d(px: DataFrame, by: Sequence[str], value: Column, edges: Sequence[float]) -> DataFrame:
    """Counts (by, i_y, n) over the full range of even bins (A2)."""
    return hist2d(px, by, F.lit(0.5), [0.0, 1.0], value, edges).select(*by, "i_y", "n")


def window_hist(bins: DataFrame, centers: DataFrame, days: float, date: str = "date_obs", by: Sequence[str] = ("instrument",), bin_cols: Sequence[str] = ("i_int",), center: str = "center") -> DataFrame:
    """Sums of histograms within days / 2 of each centre, both ends in; centres outside the dates are skipped (A3)."""
    half = round(days * DAY / 2)
    day = bins.groupBy(*by, date, *bin_cols).agg(F.sum("n").alias("n")).withColumn("__t", micros(F.col(date)))
    range_ = bins.agg(F.min(date).alias("__a"), F.max(date).alias("__z"))  # one row
    c = centers.select(center).join(F.broadcast(range_), F.col(center).between(F.col("__a"), F.col("__z"))).select(center, (micros(F.col(center)) - half).alias("__lo"), (micros(F.col(center)) + half).alias("__hi"))
    return bucketed_range_join(day, c, "__t", "__lo", "__hi", max(1, half)).groupBy(*by, center, *bin_cols).agg(F.sum("n").alias("n"))


def normalize(bins: DataFrame, by: Sequence[str], n: str = "n", out: str = "share") -> DataFrame:
    """Each count over its group's sum; 0 where the sum is 0 (A4)."""
    total = F.sum(n).over(Window.partitionBy(*by))
    return bins.withColumn(out, F.when(total != 0, F.col(n) / total).otherwise(0.0))


def hist_linear(bins: DataFrame, edges: Sequence[float], slope: Column, shift: Column, by: Sequence[str], index: str = "i_int", n: str = "n", new_edges: Sequence[float] | None = None) -> DataFrame:
    """Histograms whose bins moved to slope * edge + shift, shared out over the original (or new) even bins.

    Counts spread evenly within a bin; what leaves the range is lost. Each bin reaches only the bins that it overlaps.
    """
    new = list(edges if new_edges is None else new_edges)
    lo, hi, m = float(new[0]), float(new[-1]), len(new) - 1
    width, step = (float(edges[-1]) - float(edges[0])) / (len(edges) - 1), (hi - lo) / m
    a = slope * (F.lit(float(edges[0])) + F.col(index) * width) + shift
    b = a + slope * width
    moved = bins.withColumns({"__a": F.least(a, b), "__b": F.greatest(a, b)})
    first = F.greatest(F.floor((F.col("__a") - lo) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("__b") - lo) / step), F.lit(m - 1)).cast("int")
    moved = moved.withColumn("__j", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    left = F.lit(lo) + F.col("__j") * step
    shared = F.greatest(F.lit(0.0), F.least(F.col("__b"), left + step) - F.greatest(F.col("__a"), left))
    part = F.when(F.col("__b") > F.col("__a"), shared / (F.col("__b") - F.col("__a"))).otherwise(1.0)
    return moved.groupBy(*by, F.col("__j").alias(index)).agg(F.sum(part * F.col(n)).alias(n))


def hist_interp(bins: DataFrame, edges: Sequence[float], slope: Column, shift: Column, by: Sequence[str], index: str = "i_int", n: str = "n") -> DataFrame:
    """The same by linear interpolation between the moved bin centres, 0 beyond them (A7); slope is positive."""
    lo, m = float(edges[0]), len(edges) - 1
    step = (float(edges[-1]) - lo) / m
    centre = slope * (F.lit(lo) + (F.col(index) + 0.5) * step) + shift
    w = Window.partitionBy(*by).orderBy("__c")
    line = bins.withColumn("__c", centre).withColumns({"__d": F.lead("__c").over(w), "__m": F.lead(n).over(w)}).where("__d IS NOT NULL")
    first = F.greatest(F.ceil((F.col("__c") - lo) / step - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil((F.col("__d") - lo) / step - 0.5) - 1, F.lit(m - 1)).cast("int")
    line = line.withColumn("__j", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    at = F.lit(lo) + (F.col("__j") + 0.5) * step
    value = F.col(n) + (F.col("__m") - F.col(n)) * (at - F.col("__c")) / (F.col("__d") - F.col("__c"))
    got = line.select(*by, F.col("__j").alias(index), value.alias(n))
    return bins.select(*by, index).join(got, [*by, index], "left").withColumn(n, F.coalesce(n, F.lit(0.0)))


def score_candidates(bins: DataFrame, ref: DataFrame, cands: DataFrame, edges: Sequence[float], by: Sequence[str], ref_by: Sequence[str], index: str = "i_int", n: str = "n") -> DataFrame:
    """Per group and candidate (cand_id, slope, shift): sum of squared differences to the reference bins.

    A candidate that would move [2, 2.5] out of the range has the distance to it as its score. Candidates are a small
    table, kept by the caller; every group is scored against each.
    """
    bad = F.when(F.col("slope") < -F.col("shift") / 2, F.abs(F.col("slope") + F.col("shift") / 2)).when(F.col("slope") > (5 - F.col("shift")) / 2.5, F.abs((5 - F.col("shift")) / 2.5 - F.col("slope")))
    c = F.broadcast(cands.withColumn("__bad", bad))  # candidates are a parameter table
    groups = bins.select(*by).distinct().crossJoin(c)
    tried = bins.crossJoin(c.where("__bad IS NULL"))
    moved = hist_linear(tried, edges, F.col("slope"), F.col("shift"), [*by, "cand_id"], index, n)
    want = ref.select(*ref_by, index, F.col(n).alias("__ref"))
    full = groups.where("__bad IS NULL").select(*by, "cand_id").join(want, list(ref_by)) if ref_by else groups.where("__bad IS NULL").select(*by, "cand_id").crossJoin(F.broadcast(want))
    diff = full.join(moved, [*by, "cand_id", index], "left")
    sse = diff.groupBy(*by, "cand_id").agg(F.sum(F.pow(F.coalesce(n, F.lit(0.0)) - F.col("__ref"), 2)).alias("sse"))
    out = groups.join(sse, [*by, "cand_id"], "left")
    return out.select(*by, "cand_id", "slope", "shift", F.coalesce("__bad", "sse").alias("sse"))


def _search(bins: DataFrame, start: DataFrame, ref: DataFrame, edges: Sequence[float], by: Sequence[str], ref_by: Sequence[str], spread: tuple[float, float], within: float, index: str, n: str) -> DataFrame:
    """Slope and shift of the least squared distance to the reference: by, slope, shift, sse.

    start: by, ref_by, __c (where the group's peak is), __s0 (first slope), __p0 (where the peak should come); ref:
    ref_by, index, __ref. Each round tries 25 pairs of slope and peak place around the best one and shrinks them, until
    they stand closer than `within`. A group's histogram and its reference are arrays of one row, where candidates are
    scored, so they make no rows to shuffle. Bins outside the edges can't be moved.
    """
    m = len(edges) - 1
    inside = F.col(index).between(0, m - 1)

    def lists(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
        own = F.collect_list(F.when(inside & F.col(value).isNotNull(), F.struct(F.col(index).cast("int").alias("i"), F.col(value).cast("double").alias("v"))))
        rest = F.coalesce(F.sum(F.when(inside, 0.0).otherwise(F.pow(F.col(value), 2))), F.lit(0.0))
        got = df.groupBy(*keys).agg(own.alias("__l"), rest.alias(f"{name}_rest"), F.count("*").alias("__all")).where("__all > 0")
        return got.select(*keys, F.transform("__l", lambda x: x["i"]).alias(f"{name}_i"), F.transform("__l", lambda x: x["v"]).alias(f"{name}_v"), f"{name}_rest")

    want = lists(ref, ref_by, "__ref", "__want")
    rows = start.join(want, list(ref_by)) if ref_by else start.crossJoin(F.broadcast(want))  # without ref_by, one row
    rows = rows.join(lists(bins, by, n, "__own"), list(by), "left")
    values = [F.col(c).cast("double").alias(c) for c in ("__c", "__s0", "__p0", "__want_rest")]
    rows = rows.select(*by, *values, "__own_i", "__own_v", "__want_i", "__want_v")
    schema = StructType([*rows.select(*by).schema.fields, *(StructField(c, DoubleType()) for c in ("slope", "shift", "sse"))])
    bounds, keys = (float(edges[0]), float(edges[-1])), list(by)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = _best_moves(part, bounds, m, spread, within)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *(pa.array(x, from_pandas=True) for x in found)], names=[*keys, "slope", "shift", "sse"])

    return table(rows.mapInArrow(fit, schema), "fit")


def _best_moves(part: pa.RecordBatch, bounds: tuple[float, float], m: int, spread: tuple[float, float], within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, shift and squared distance of each row's best candidate (_search), as hist_linear would move its bins: what
    comes to a bin is the difference of the running sum at its edges, moved back."""
    def dense(name: str, empty: float) -> np.ndarray:
        i, v = part.column(f"{name}_i"), part.column(f"{name}_v")
        at = np.repeat(np.arange(part.num_rows), i.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), i.flatten().to_numpy(zero_copy_only=False)
        out = np.full((part.num_rows, m), empty)
        out[at] = 0.0
        np.add.at(out, at, v.flatten().to_numpy(zero_copy_only=False))
        return out

    c, s0, p0, rest = (part.column(name).to_numpy(zero_copy_only=False).astype(float) for name in ("__c", "__s0", "__p0", "__want_rest"))
    own, want = dense("__own", 0.0), dense("__want", np.nan)[:, None, :]
    upto = np.concatenate([np.zeros((len(own), 1)), np.cumsum(own, axis=1)], axis=1)
    lo, width = bounds[0], (bounds[1] - bounds[0]) / m
    edge = lo + np.arange(m + 1) * width
    u, v = np.arange(25) // 5 / 2 - 1, np.arange(25) % 5 / 2 - 1
    size, row = 1.0, np.arange(len(own))
    while size == 1.0 or max(spread) * size * 1.25 >= within:
        slope = np.maximum(s0[:, None] + u * spread[0] * size, 0.01)
        place = p0[:, None] + v * spread[1] * size
        back = ((edge - (place - slope * c[:, None])[:, :, None]) / slope[:, :, None] - lo) / width
        back = np.clip(np.nan_to_num(back), 0, m)
        bin_ = np.minimum(back.astype(int), m - 1)
        flat = bin_.reshape(len(own), -1)
        run = np.take_along_axis(upto, flat, 1) + (back.reshape(flat.shape) - flat) * np.take_along_axis(own, flat, 1)
        sse = np.nansum((np.diff(run.reshape(back.shape), axis=2) - want) ** 2, axis=2) + rest[:, None]
        best = np.argmin(np.round(sse, 15), axis=1)
        s0, p0, least = slope[row, best], place[row, best], sse[row, best]
        size *= 0.4
    return s0, p0 - s0 * c, least


def _peak(bins: DataFrame, by: Sequence[str], index: str, n: str, name: str) -> DataFrame:
    """Bin (name_i) and height (name_n) of each histogram's peak, the first of equals."""
    return bins.groupBy(*by).agg(F.max_by(index, F.struct(n, -F.col(index))).alias(f"{name}_i"), F.max(n).alias(f"{name}_n"))


def _start(edges: Sequence[float]) -> list[Column]:
    """From own and reference peaks: place, first slope (a histogram drawn wider by a slope is as much lower), target."""
    lo, step = float(edges[0]), (float(edges[-1]) - float(edges[0])) / (len(edges) - 1)
    ratio = F.when((F.col("__own_n") > 0) & (F.col("__to_n") > 0), F.col("__own_n") / F.col("__to_n"))
    s0 = F.coalesce(F.greatest(F.least(ratio, F.lit(4.0)), F.lit(0.25)), F.lit(1.0))
    centre = lambda i: F.lit(lo) + (F.col(i) + 0.5) * step
    return [centre("__own_i").alias("__c"), s0.alias("__s0"), centre("__to_i").alias("__p0")]


def fit_linear(bins: DataFrame, ref: DataFrame, edges: Sequence[float], by: Sequence[str], spread: tuple[float, float] = (0.4, 0.3), within: float = 1e-4, index: str = "i_int", n: str = "share") -> DataFrame:
    """Slope and shift that bring each group's histogram closest to the reference (A9): by, slope, shift, sse.

    The search starts at the ratio and the offset of the peaks and ends when candidates are less than `within` apart.
    """
    peaks = _peak(bins, by, index, n, "__own").crossJoin(F.broadcast(_peak(ref, [], index, n, "__to")))  # one row
    return _search(bins, peaks.select(*by, *_start(edges)), ref.select(index, F.col(n).alias("__ref")), edges, by, [], spread, within, index, n)


def solve_normal(df: DataFrame, by: Sequence[str], y: Column, xs: Sequence[Column]) -> DataFrame:
    """Least squares of y on xs per group by the normal equations, eliminated in columns: by, c0, c1, ....

    A singular system has null coefficients.
    """
    k = len(xs)
    sums = [F.sum(xs[i] * xs[j]).alias(f"__m{i}_{j}") for i in range(k) for j in range(k)] + [F.sum(xs[i] * y).alias(f"__m{i}_{k}") for i in range(k)]
    m = df.groupBy(*by).agg(*sums)
    for p in range(k):
        pivot = F.when(F.abs(F.col(f"__m{p}_{p}")) > 1e-14, F.col(f"__m{p}_{p}"))
        new = {f"__m{p}_{j}": F.col(f"__m{p}_{j}") / pivot for j in range(p + 1, k + 1)}
        for i in range(k):
            if i != p:
                new |= {f"__m{i}_{j}": F.col(f"__m{i}_{j}") - F.col(f"__m{i}_{p}") * F.col(f"__m{p}_{j}") / pivot for j in range(p + 1, k + 1)}
        m = m.withColumns(new)
    return m.select(*by, *[F.col(f"__m{i}_{k}").alias(f"c{i}") for i in range(k)])


def fit_limb_cubic(fits: DataFrame, by: Sequence[str], mu: str = "mu") -> DataFrame:
    """Cubic limb parameters a0..a2 (slopes) and b0..b2 (shifts) from per-mu fits, pinned at mu = 1 (A10)."""
    m = F.col(mu)
    xs = [m - 1, m * m - 1, m * m * m - 1]
    a = solve_normal(fits, by, F.col("slope") - 1, xs).toDF(*by, "a0", "a1", "a2")
    b = solve_normal(fits, by, F.col("shift"), xs).toDF(*by, "b0", "b1", "b2")
    return a.join(b, list(by))


def fit_limb(bins: DataFrame, ref: DataFrame, edges: Sequence[float], model: str, cands: DataFrame, by: Sequence[str], mu: str = "mu", index: str = "i_int", n: str = "share") -> DataFrame:
    """The candidate parameters (cand_id, p0, p1, ...) of a limb model with the least summed score over mu rows (A10)."""
    k = LIMB_MODELS[model][1]
    beta, y = limb_factors(model, [F.col(f"p{i}") for i in range(k)], F.col(mu))
    tried = bins.crossJoin(F.broadcast(cands)).withColumns({"slope": beta, "shift": y})  # candidates are a parameter table
    moved = hist_linear(tried, edges, F.col("slope"), F.col("shift"), [*by, mu, "cand_id"], index, n)
    want = bins.select(*by, mu).distinct().crossJoin(F.broadcast(cands.select("cand_id"))).crossJoin(F.broadcast(ref.select(index, F.col(n).alias("__ref"))))
    sse = want.join(moved, [*by, mu, "cand_id", index], "left").groupBy(*by, "cand_id").agg(F.sum(F.pow(F.coalesce(n, F.lit(0.0)) - F.col("__ref"), 2)).alias("sse"))
    best = sse.groupBy(*by).agg(F.min_by(F.struct("cand_id", "sse"), F.struct(F.round("sse", 12), "cand_id")).alias("b")).select(*by, "b.*")
    return best.join(cands, "cand_id")


def hist_moments(bins: DataFrame, by: Sequence[str], centre: Column, index: str = "i_int", n: str = "n") -> DataFrame:
    """Sum, mean, median, 15 and 85 % quantiles (first bin whose running share reaches them), width c70, and z, the
    mean's distance to the median of all means in widths (A11)."""
    w = Window.partitionBy(*by)
    run = F.sum(n).over(w.orderBy(index)) / F.when(F.sum(n).over(w) != 0, F.sum(n).over(w))
    line = bins.select(*by, centre.alias("__c"), F.col(n).alias("__n"), run.alias("__run"))
    q = [F.min(F.when(F.col("__run") >= p, F.col("__c"))).alias(name) for p, name in ((0.5, "median"), (0.15, "q15"), (0.85, "q85"))]
    got = line.groupBy(*by).agg(F.sum("__n").alias("hist_sum"), (F.sum(F.col("__c") * F.col("__n")) / F.when(F.sum("__n") != 0, F.sum("__n"))).alias("hist_mean"), *q)
    got = table(got, "moments")
    mid = exact_quantiles(got, "hist_mean", [0.5]).select(F.col("quantiles")[0].alias("__mid"))  # one row
    got = got.join(F.broadcast(mid), F.lit(True), "left").withColumn("c70", F.col("q85") - F.col("q15"))
    return got.withColumn("z", F.when(F.col("c70") != 0, (F.col("hist_mean") - F.col("__mid")) / F.col("c70"))).drop("__mid")


def window_moments(bins: DataFrame, centers: DataFrame, days: float, centre: Column, params: DataFrame | None = None, by: Sequence[str] = ("instrument",), date: str = "date_obs") -> DataFrame:
    """Mean and deviation of windowed histograms, mean after scaling (params: by, alpha, x) and its shift; 0 when
    empty (A32)."""
    sums = window_hist(bins, centers, days, date, by)
    got = sums.groupBy(*by, "center").agg(F.sum("n").alias("__n"), F.sum(centre * F.col("n")).alias("__s"), F.sum(centre * centre * F.col("n")).alias("__q"))
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).otherwise(0.0)
    std = F.when(F.col("__n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__n") - mean * mean))).otherwise(0.0)
    out = got.select(*by, "center", mean.alias("mean"), std.alias("std"))
    if params is None:
        return out
    scaled = F.coalesce(F.col("alpha") * F.col("mean") + F.col("x"), F.col("mean"))
    return out.join(params.select(*by, "alpha", "x"), list(by), "left").select(*by, "center", "mean", "std", scaled.alias("scaled_mean"), (scaled - F.col("mean")).alias("mean_shift"))


def first_window(bins: DataFrame, centers: DataFrame, reference: str, days: float, date: str = "date_obs") -> DataFrame:
    """One row, __first: the first centre within the dates whose window holds the reference."""
    half = F.expr(f"INTERVAL {round(days * 43200)} SECOND")
    own = bins.where((F.col("instrument") == reference) & (F.col("n") > 0)).agg(F.min(date).alias("__r"))
    ends = bins.agg(F.min(date).alias("__a"), F.max(date).alias("__z")).crossJoin(own)  # one row
    return centers.crossJoin(F.broadcast(ends)).where("center BETWEEN __a AND __z").where(F.col("center") + half >= F.col("__r")).agg(F.min("center").alias("__first"))


def fit_scaling(bins: DataFrame, centers: DataFrame, reference: str, edges: Sequence[float], days: float = 180, date: str = "date_obs", base: DataFrame | None = None, within: float = 1e-4, first: DataFrame | None = None) -> DataFrame:
    """alpha and x of every instrument and centre: (1, 0), or base's (center, alpha, x), for the reference; the others
    fitted to the reference's window, or to its first one where the centre comes before its first (A33, A34).

    With base, the reference's histograms are scaled by its own coefficients before others are fitted to them. first: the
    reference's first centre (first_window), where `centers` are not all.
    """
    by = ["instrument", "center"]
    asked = centers.select("center")
    first = first_window(bins, asked, reference, days, date) if first is None else first
    every = asked.unionByName(first.select(F.col("__first").alias("center")).where("center IS NOT NULL")).distinct()
    sums = window_hist(bins, every, days, date)
    if base is not None:
        own = sums.where(F.col("instrument") == reference).join(base.select("center", "alpha", "x"), "center")
        moved = hist_linear(own.withColumn("n", F.col("n").cast("double")), edges, F.col("alpha"), F.col("x"), by)
        sums = sums.where(F.col("instrument") != reference).withColumn("n", F.col("n").cast("double")).unionByName(moved.select(sums.columns))
    sums = table(normalize(sums, by), "windows")
    ref = sums.where(F.col("instrument") == reference).select(F.col("center").alias("__use"), "i_int", F.col("share").alias("__ref"))
    sums = sums.join(asked.distinct(), "center", "left_semi")
    others = sums.where(F.col("instrument") != reference)
    own = _peak(others, by, "i_int", "share", "__own").crossJoin(F.broadcast(first)).withColumn("__use", F.greatest("center", "__first"))
    start = own.join(_peak(ref, ["__use"], "i_int", "__ref", "__to"), "__use").select(*by, "__use", *_start(edges))
    best = _search(others.select(*by, "i_int", "share"), start, ref, edges, by, ["__use"], (0.4, 0.3), within, "i_int", "share")
    same = sums.where(F.col("instrument") == reference).select(*by).distinct()
    same = same.withColumns({"alpha": F.lit(1.0), "x": F.lit(0.0)}) if base is None else same.join(base.select("center", "alpha", "x"), "center").select(*by, "alpha", "x")
    return same.unionByName(best.select(*by, F.col("slope").alias("alpha"), F.col("shift").alias("x")))


def regress(df: DataFrame, y: str, x: str, by: Sequence[str], intercept: float | None = None) -> DataFrame:
    """Slope and intercept of y on x per group; a given intercept is pinned."""
    if intercept is None:
        return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    c = F.col(x)
    return df.groupBy(*by).agg((F.sum(c * (F.col(y) - intercept)) / F.sum(F.when(F.col(y).isNotNull(), c * c))).alias("slope"), F.lit(float(intercept)).alias("intercept"))


def regress_stacked(df: DataFrame, rows: Sequence[tuple[str, Sequence[str | None]]], by: Sequence[str]) -> DataFrame:
    """One least-squares fit to several kinds of rows at once, such as means and deviations (A28): by, c0, c1, ...

    rows: of each kind the dependent column and one column (or a number as text) for each coefficient; None: the kind
    does not bear on it. Rows with a null among them don't count.
    """
    k = len(rows[0][1])
    one = lambda x: F.lit(0.0) if x is None else F.expr(x).cast("double")
    kinds = F.array(*[F.struct(F.col(y).cast("double").alias("y"), *[one(x).alias(f"x{i}") for i, x in enumerate(xs)]) for y, xs in rows])
    each = df.select(*by, F.explode(kinds).alias("r")).select(*by, "r.*").dropna(subset=["y", *(f"x{i}" for i in range(k))])
    return solve_normal(each, by, F.col("y"), [F.col(f"x{i}") for i in range(k)])


def cadence_fits(images: DataFrame, bins: DataFrame, ref: DataFrame, edges: Sequence[float], ks: Sequence[int], by: Sequence[str], order: Sequence[str], key: str = "data_id", within: float = 1e-4) -> DataFrame:
    """by, cadence, slope, shift, sse: each group fitted anew from the histograms of every k-th image.

    images: key, by, order; bins: key, i_int, n; ref: i_int, share.
    """
    parts = [subsample_cadence(images, k, by, order).select(key, *by, F.lit(k).alias("cadence")) for k in ks]
    use = reduce(lambda a, b: a.unionByName(b), parts)
    sums = bins.join(use, key).groupBy(*by, "cadence", "i_int").agg(F.sum("n").alias("n"))
    group = [*by, "cadence"]
    return fit_linear(table(normalize(sums, group), "cadence"), ref, edges, group, within=within)


def subsample_cadence(df: DataFrame, k: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every k-th row of each group in order, from the first (A29), numbered by ranges of the order."""
    return row_numbers(df, order, "__r", by=by).where((F.col("__r") - 1) % k == 0).drop("__r")


def optimal_bins(px: DataFrame, col: str, n_from: int = 20, n_to: int = 700) -> DataFrame:
    """Freedman-Diaconis width, and the number of even bins with the least (2 mean - var) / width**2 of its counts, the
    first of equals (A31). One pass per value: it is counted in all binnings at once, pre-aggregated per task."""
    stats = px.where(F.col(col).isNotNull()).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("n"))
    q = F.col("quantiles")
    stats = stats.crossJoin(F.broadcast(exact_quantiles(px, col, [0.25, 0.75]).select((q[1] - q[0]).alias("iqr"))))  # one row
    v = px.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("k")).crossJoin(F.broadcast(stats))
    v = v.withColumn("bins", F.explode(F.sequence(F.lit(n_from), F.lit(n_to - 1))))
    i = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    counts = v.groupBy("bins", "lo", "hi", "n", "iqr", i.alias("i")).agg(F.sum("k").alias("k"))
    cost = counts.groupBy("bins", "lo", "hi", "n", "iqr").agg(F.sum(F.pow("k", 2)).alias("sq"))
    mean, width = F.col("n") / F.col("bins"), (F.col("hi") - F.col("lo")) / F.col("bins")
    cost = cost.withColumn("cost", (2 * mean - (F.col("sq") / F.col("bins") - mean * mean)) / (width * width))
    best = cost.groupBy("n", "iqr").agg(F.min_by("bins", F.struct("cost", "bins")).alias("bins"))
    return best.select((2 * F.col("iqr") / F.cbrt(F.col("n"))).alias("fd_width"), "bins")


def candidate_grid(spark: SparkSession, **ranges: tuple[float, float, int]) -> DataFrame:
    """All combinations of evenly spaced parameters, numbered: cand_id and one column a range."""
    total = reduce(lambda a, b: a * b, (r[2] for r in ranges.values()), 1)
    out, below = spark.range(total).select(F.col("id").alias("cand_id")), 1
    for name, (lo, hi, n) in ranges.items():
        out = out.withColumn(name, F.lit(float(lo)) + (F.floor(F.col("cand_id") / below) % n) * ((hi - lo) / max(1, n - 1)))
        below *= n
    return out

"""Histogram queries over lineitem: image = supplier, mu = discount, intensity = price."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hist, limb, quality, selection
from .base import query, read, rounded

X_EDGES = [-0.005 + 0.01 * k for k in range(12)]
Y_EDGES = [0.1 * k for k in range(61)]
T0, T1 = datetime(1995, 1, 1), datetime(2002, 1, 1)


def px(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("data_id"), F.col("l_returnflag").alias("instrument"), F.col("l_discount").alias("mu"), F.col("l_extendedprice").alias("data"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("date_obs"), F.col("l_tax").alias("lat")
    )


def bins(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    return hist.hist1d(px(spark, d), by, hist.log_intensity(F.col("data")), Y_EDGES).withColumnRenamed("i_y", "i_int")


PX = """hp AS (SELECT l_suppkey AS data_id, l_returnflag AS instrument, l_discount AS mu, l_extendedprice AS data, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date_obs, l_tax AS lat,
  CAST(least(floor(log10(l_extendedprice) / 6.0 * 60), 59) AS INTEGER) AS i_int FROM lineitem)"""


def _full(by: str) -> str:
    """Full bin table of a grouping."""
    join = " AND ".join(f"g.{c} = s.{c}" for c in by.split(", "))
    cols = ", ".join(f"g.{c}" for c in by.split(", "))
    return f"""hb AS (SELECT {cols}, g.i_int, coalesce(s.n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT {by} FROM hp), (SELECT CAST(unnest(range(60)) AS INTEGER) AS i_int)) g
  LEFT JOIN (SELECT {by}, i_int, count(*) AS n FROM hp GROUP BY ALL) s ON {join} AND g.i_int = s.i_int)"""


@query(f"""WITH {PX}, b AS (SELECT data_id, CAST(least(floor((mu + 0.005) / 0.11 * 11), 10) AS INTEGER) AS i_x, i_int AS i_y, count(*) AS n FROM hp WHERE lat BETWEEN 0.0 AND 0.04 GROUP BY ALL),
  g AS (SELECT data_id, CAST(unnest(range(11)) AS INTEGER) AS i_x FROM (SELECT DISTINCT data_id FROM hp WHERE lat BETWEEN 0.0 AND 0.04)), h AS (SELECT g.*, CAST(unnest(range(60)) AS INTEGER) AS i_y FROM g)
  SELECT h.*, coalesce(n, 0) AS n FROM h LEFT JOIN b USING (data_id, i_x, i_y)""")
def a1_hist2d(spark: SparkSession, d: str) -> DataFrame:
    inside = px(spark, d).where(F.col("lat").between(0.0, 0.04))
    return hist.hist2d(inside, ["data_id"], F.col("mu"), X_EDGES, hist.log_intensity(F.col("data")), Y_EDGES)


@query(f"WITH {PX}, {_full('data_id')} SELECT * FROM hb")
def a2_hist1d(spark: SparkSession, d: str) -> DataFrame:
    return bins(spark, d, ["data_id"])


@query(f"WITH {PX}, {_full('data_id')} SELECT data_id, 0 AS i_mu, i_int, n FROM hb")
def s2_hist_to_bins(spark: SparkSession, d: str) -> DataFrame:
    stored = bins(spark, d, ["data_id"]).groupBy("data_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i_int", "n"))), lambda x: x["n"]).alias("hist")).withColumn("n_intensity_bins", F.lit(60))
    return hist.hist_to_bins(stored, "data_id")


CENTERS = "ctr AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-02', TIMESTAMP '2001-12-31', INTERVAL 7 DAY)) AS TIMESTAMP) AS center)"
WINDOW = f"""{PX}, {CENTERS}, mm AS (SELECT min(date_obs) AS a, max(date_obs) AS z FROM hp), wh AS (SELECT instrument, center, i_int, count(*) AS n FROM ctr, mm, hp
  WHERE center BETWEEN a AND z AND date_obs BETWEEN center - INTERVAL 90 DAY AND center + INTERVAL 90 DAY GROUP BY ALL)"""


def _window(spark: SparkSession, d: str) -> DataFrame:
    daily = px(spark, d).groupBy("instrument", "date_obs", hist.bin_of(hist.log_intensity(F.col("data")), Y_EDGES).alias("i_int")).agg(F.count("*").alias("n"))
    return hist.window_hist(daily, selection.weekly_centers(spark, T0, T1), 180)


@query(f"WITH {WINDOW} SELECT * FROM wh")
def a3_window_hist(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d)


@query(f"WITH {WINDOW} SELECT instrument, center, i_int, round(n / sum(n) OVER (PARTITION BY instrument, center), 6)::DOUBLE AS share FROM wh")
def a4_normalize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hist.normalize(_window(spark, d), ["instrument", "center"]).drop("n"), 6, "share")


def _moved(slope: float, shift: float, m: int = 60) -> str:
    step = 6.0 / m
    return f"""mv AS (SELECT data_id, j AS i_int, sum(n * greatest(0, least({slope} * (i_int + 1) * 0.1 + {shift}, (j + 1) * {step}) - greatest({slope} * i_int * 0.1 + {shift}, j * {step})) / ({slope} * 0.1)) AS n
  FROM hb, (SELECT CAST(unnest(range({m})) AS INTEGER) AS j) GROUP BY 1, 2)"""


@query(f"WITH {PX}, {_full('data_id')}, {_moved(0.93, 0.171)} SELECT data_id, i_int, round(n, 5) AS n FROM mv WHERE n > 1e-4")
def a5_hist_linear(spark: SparkSession, d: str) -> DataFrame:
    got = hist.hist_linear(bins(spark, d, ["data_id"]), Y_EDGES, F.lit(0.93), F.lit(0.171), ["data_id"])
    return rounded(got.where("n > 1e-4"), 5, "n")


@query(f"WITH {PX}, {_full('data_id')}, {_moved(1.0, 0.0, 15)} SELECT data_id, i_int, round(n, 5) AS n FROM mv WHERE n > 1e-4")
def a6_rebin(spark: SparkSession, d: str) -> DataFrame:
    got = hist.hist_linear(bins(spark, d, ["data_id"]), Y_EDGES, F.lit(1.0), F.lit(0.0), ["data_id"], new_edges=[0.4 * k for k in range(16)])
    return rounded(got.where("n > 1e-4"), 5, "n")


@query(f"""WITH {PX}, {_full('data_id')}, c AS (SELECT *, 0.93 * (i_int + 0.5) * 0.1 + 0.171 AS c, lead(n) OVER (PARTITION BY data_id ORDER BY i_int) AS m FROM hb),
  v AS (SELECT g.data_id, g.i_int, (g.i_int + 0.5) * 0.1 AS x FROM hb g)
  SELECT v.data_id, v.i_int, round(coalesce(c.n + (c.m - c.n) * (x - c.c) / 0.093, 0), 5)::DOUBLE AS n FROM v LEFT JOIN c ON c.data_id = v.data_id AND c.m IS NOT NULL AND x >= c.c AND x < c.c + 0.093""")
def a7_hist_interp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hist.hist_interp(bins(spark, d, ["data_id"]), Y_EDGES, F.lit(0.93), F.lit(0.171), ["data_id"]).select("data_id", "i_int", F.col("n").cast("double").alias("n")), 5, "n")


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return hist.normalize(bins(spark, d, ["data_id"]), ["data_id"]).select("data_id", "i_int", "share")


def _reference(spark: SparkSession, d: str) -> DataFrame:
    return hist.normalize(bins(spark, d, ["instrument"]).groupBy("i_int").agg(F.sum("n").alias("n")), []).select("i_int", "share")


@query(f"""WITH {PX}, {_full('data_id')}, sh AS (SELECT data_id, i_int, n / sum(n) OVER (PARTITION BY data_id) AS share FROM hb),
  rf AS (SELECT i_int, sum(n) / sum(sum(n)) OVER () AS share FROM hb GROUP BY 1), cd AS (SELECT k AS cand_id, 0.9 + (k % 3) * 0.1 AS slope, -0.2 + CAST(floor(k / 3) AS INTEGER) * 0.2 AS shift FROM (SELECT unnest(range(9)) AS k)),
  mv AS (SELECT data_id, cand_id, j AS i_int, sum(share * greatest(0, least(slope * (i_int + 1) * 0.1 + shift, (j + 1) * 0.1) - greatest(slope * i_int * 0.1 + shift, j * 0.1)) / (slope * 0.1)) AS v
    FROM sh, cd, (SELECT CAST(unnest(range(60)) AS INTEGER) AS j) GROUP BY ALL)
  SELECT data_id, cand_id, round(slope, 6)::DOUBLE AS slope, round(shift, 6)::DOUBLE AS shift, round(sum(pow(v - rf.share, 2)), 8) AS sse FROM mv JOIN cd USING (cand_id) JOIN rf ON rf.i_int = mv.i_int GROUP BY ALL""")
def a8_score_candidates(spark: SparkSession, d: str) -> DataFrame:
    cands = hist.candidate_grid(spark, slope=(0.9, 1.1, 3), shift=(-0.2, 0.2, 3))
    got = hist.score_candidates(_shares(spark, d), _reference(spark, d), cands, Y_EDGES, ["data_id"], [], n="share")
    return rounded(rounded(got, 6, "slope", "shift"), 8, "sse")


@query()
def a9_fit_linear(spark: SparkSession, d: str) -> DataFrame:
    return hist.fit_linear(_shares(spark, d), _reference(spark, d), Y_EDGES, ["data_id"])


@query("""WITH m AS (SELECT l_returnflag AS instrument, 1 - l_discount AS mu, avg(l_tax) AS slope FROM lineitem GROUP BY 1, 2)
  SELECT instrument, round(regr_slope(slope, mu), 8) AS slope, round(regr_intercept(slope, mu), 8) AS intercept FROM m GROUP BY 1""")
def a28_regress(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("instrument"), (1 - F.col("l_discount")).alias("mu")).agg(F.avg("l_tax").alias("tax"))
    return rounded(hist.regress(m, "tax", "mu", ["instrument"]), 8, "slope", "intercept")


@query("""WITH m AS (SELECT l_returnflag AS instrument, date_trunc('month', l_shipdate) AS month, avg(l_quantity) AS xm, stddev_pop(l_quantity) AS xs, avg(l_extendedprice / 1000) AS ym, stddev_pop(l_extendedprice / 1000) AS ys FROM lineitem GROUP BY 1, 2),
  s AS (SELECT instrument, count(*) AS n, sum(xm) AS x, sum(ym) AS y, sum(xm * xm + xs * xs) AS xx, sum(xm * ym + xs * ys) AS xy FROM m GROUP BY 1), t AS (SELECT *, (xy - x * y / n) / (xx - x * x / n) AS c0 FROM s)
  SELECT instrument, round(c0, 6) AS c0, round((y - c0 * x) / n, 6) AS c1 FROM t""")
def a28_regress_stacked(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations of a month in one fit; the intercept is that of the means."""
    m = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("instrument"), F.date_trunc("month", "l_shipdate").alias("month"))
    m = m.agg(F.avg("l_quantity").alias("xm"), F.stddev_pop("l_quantity").alias("xs"), F.avg(F.col("l_extendedprice") / 1000).alias("ym"), F.stddev_pop(F.col("l_extendedprice") / 1000).alias("ys"))
    return rounded(hist.regress_stacked(m, [("ym", ["xm", "1"]), ("ys", ["xs", None])], ["instrument"]), 6, "c0", "c1")


@query()
def a29_cadence_fits(spark: SparkSession, d: str) -> DataFrame:
    """Fits of each instrument from every image, and from every second and fourth."""
    rows = px(spark, d)
    images = rows.groupBy("data_id", "instrument").agg(F.min("date_obs").alias("date_obs")).withColumn("key", F.concat_ws("-", "data_id", "instrument"))
    counts = bins(spark, d, ["data_id", "instrument"]).select(F.concat_ws("-", "data_id", "instrument").alias("key"), "i_int", "n")
    return hist.cadence_fits(images, counts, _reference(spark, d), Y_EDGES, [1, 2, 4], ["instrument"], ["date_obs", "data_id"], "key")


@query()
def a10_fit_limb(spark: SparkSession, d: str) -> DataFrame:
    """A constrained and a free limb model for each instrument and year."""
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("instrument"), F.year("l_shipdate").alias("year"), F.round(1.0 - 9 * F.col("l_discount"), 6).alias("mu"), hist.bin_of(hist.log_intensity(F.col("l_extendedprice")) - 2, LIMB_EDGES).alias("i_int"))
    counts = rows.where("i_int IS NOT NULL").groupBy("instrument", "year", "mu", "i_int").agg(F.count("*").alias("n"))
    shares = hist.normalize(counts, ["instrument", "year", "mu"])
    return limb.fit_limb_models(shares, LIMB_EDGES, ["instrument", "year"], max_rounds=25).drop("seconds")


LIMB_EDGES = [0.1 * k for k in range(51)]


@query("""WITH m AS (SELECT l_returnflag AS instrument, l_discount AS mu, l_tax AS y FROM lineitem), s AS (SELECT instrument, sum((y - 0.01) * mu) / sum(mu * mu) AS slope FROM m GROUP BY 1) SELECT instrument, round(slope, 8) AS slope, 0.01::DOUBLE AS intercept FROM s""")
def a28_regress_pinned(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("instrument"), F.col("l_discount").alias("mu"), F.col("l_tax").alias("y"))
    return rounded(hist.regress(m, "y", "mu", ["instrument"], 0.01), 8, "slope")


@query()
def a10_fit_limb_cubic(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("instrument"), (1 - F.col("l_discount")).alias("mu")).agg((1 + F.avg("l_tax")).alias("slope"), F.avg(F.col("l_quantity") / 100).alias("shift"))
    return rounded(hist.fit_limb_cubic(m, ["instrument"]), 6, "a0", "a1", "a2", "b0", "b1", "b2")


@query(f"""WITH {PX}, {_full('data_id')}, r AS (SELECT *, (i_int + 0.5) * 0.1 AS c, sum(n) OVER (PARTITION BY data_id ORDER BY i_int) / sum(n) OVER (PARTITION BY data_id) AS run FROM hb),
  g AS (SELECT data_id, sum(n) AS hist_sum, sum(c * n) / sum(n) AS hist_mean, min(CASE WHEN run >= 0.5 THEN c END) AS median, min(CASE WHEN run >= 0.15 THEN c END) AS q15, min(CASE WHEN run >= 0.85 THEN c END) AS q85 FROM r GROUP BY 1),
  m AS (SELECT quantile_cont(hist_mean, 0.5) AS mid FROM g)
  SELECT data_id, CAST(hist_sum AS BIGINT) AS hist_sum, round(hist_mean, 8)::DOUBLE AS hist_mean, round(median, 6)::DOUBLE AS median, round(q15, 6)::DOUBLE AS q15, round(q85, 6)::DOUBLE AS q85, round(q85 - q15, 6)::DOUBLE AS c70,
  round(CASE WHEN abs(q85 - q15) > 1e-9 THEN (hist_mean - mid) / (q85 - q15) END, 5)::DOUBLE AS z FROM g, m""")
def a11_hist_moments(spark: SparkSession, d: str) -> DataFrame:
    got = hist.hist_moments(bins(spark, d, ["data_id"]), ["data_id"], (F.col("i_int") + 0.5) * 0.1)
    return rounded(rounded(rounded(got, 8, "hist_mean"), 6, "median", "q15", "q85", "c70"), 5, "z")


@query(f"""WITH {PX}, {_full('data_id')}, g AS (SELECT data_id, sum(n) AS s, sum((i_int + 0.5) * 0.1 * n) / sum(n) AS m FROM hb GROUP BY 1)
  SELECT data_id, s < 580 OR m > 4.5 AS bad FROM g""")
def w8_flag_images(spark: SparkSession, d: str) -> DataFrame:
    got = hist.hist_moments(bins(spark, d, ["data_id"]), ["data_id"], (F.col("i_int") + 0.5) * 0.1)
    rules = spark.createDataFrame([("x", 580.0, 4.5, datetime(2030, 1, 1))], "instrument string, min_sum double, max_mean double, until timestamp_ntz")
    rows = got.withColumns({"instrument": F.lit("x"), "date_obs": F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz")})
    return quality.flag_images(rows, rules).select("data_id", "bad")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE (r - 1) % 6 = 0")
def a29_subsample_cadence(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return hist.subsample_cadence(rows, 6, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem),
  v AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1), c AS (SELECT bins, least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS i, sum(k) AS k FROM v, s, (SELECT unnest(range(20, 700)) AS bins) GROUP BY 1, 2),
  t AS (SELECT bins, sum(k * k)::DOUBLE AS sq FROM c GROUP BY 1), u AS (SELECT bins, (2 * n / bins::DOUBLE - (sq / bins - pow(n / bins::DOUBLE, 2))) / pow((hi - lo) / bins, 2) AS cost FROM t, s)
  SELECT round(2 * iqr / cbrt(n), 8) AS fd_width, CAST(arg_min(bins, (cost, bins)) AS INTEGER) AS bins FROM u, s GROUP BY 1""")
def a31_optimal_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hist.optimal_bins(read(spark, d, "lineitem"), "l_quantity"), 8, "fd_width")


@query("""WITH p AS (SELECT floor(l_extendedprice / 100) AS v FROM lineitem), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM p),
  c AS (SELECT bins, least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS i, count(*) AS k FROM p, s, (SELECT unnest(range(20, 700)) AS bins) GROUP BY 1, 2),
  t AS (SELECT bins, sum(k * k)::DOUBLE AS sq FROM c GROUP BY 1), u AS (SELECT bins, (2 * n / bins::DOUBLE - (sq / bins - pow(n / bins::DOUBLE, 2))) / pow((hi - lo) / bins, 2) AS cost FROM t, s)
  SELECT round(2 * iqr / cbrt(n), 8) AS fd_width, CAST(arg_min(bins, (cost, bins)) AS INTEGER) AS bins FROM u, s GROUP BY 1""")
def a31_optimal_bins_full(spark: SparkSession, d: str) -> DataFrame:
    """Prices in hundreds, which take more values than there are bins."""
    prices = read(spark, d, "lineitem").select(F.floor(F.col("l_extendedprice") / 100).cast("double").alias("price"))
    return rounded(hist.optimal_bins(prices, "price"), 8, "fd_width")


@query(f"""WITH {WINDOW}, m AS (SELECT instrument, center, sum(n * (i_int + 0.5) * 0.1) / sum(n) AS mean, sum(n * pow((i_int + 0.5) * 0.1, 2)) / sum(n) AS sq FROM wh GROUP BY 1, 2)
  SELECT instrument, center, round(mean, 6)::DOUBLE AS mean, round(sqrt(sq - mean * mean), 5)::DOUBLE AS std, round(CASE WHEN instrument = 'A' THEN 1.05 * mean + 0.1 ELSE mean END, 6)::DOUBLE AS scaled_mean,
  round(CASE WHEN instrument = 'A' THEN 0.05 * mean + 0.1 ELSE 0 END, 6)::DOUBLE AS mean_shift FROM m""")
def a32_window_moments(spark: SparkSession, d: str) -> DataFrame:
    daily = px(spark, d).groupBy("instrument", "date_obs", hist.bin_of(hist.log_intensity(F.col("data")), Y_EDGES).alias("i_int")).agg(F.count("*").alias("n"))
    params = spark.createDataFrame([("A", 1.05, 0.1)], "instrument string, alpha double, x double")
    got = hist.window_moments(daily, selection.weekly_centers(spark, T0, T1), 180, (F.col("i_int") + 0.5) * 0.1, params)
    return rounded(rounded(got, 6, "mean", "scaled_mean", "mean_shift"), 5, "std")


@query()
def a34_fit_scaling(spark: SparkSession, d: str) -> DataFrame:
    daily = px(spark, d).groupBy("instrument", "date_obs", hist.bin_of(hist.log_intensity(F.col("data")), Y_EDGES).alias("i_int")).agg(F.count("*").alias("n"))
    return hist.fit_scaling(daily, selection.weekly_centers(spark, T0, T1), "R", Y_EDGES)

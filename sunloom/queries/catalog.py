"""Catalog, registry, selection and as-of queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import quality as qual
from ..operators import query as q
from ..operators import registry as reg
from ..operators import selection as sel
from ..plans import asof
from .base import IMAGES, MEMBERS, MONTHLY, images, members, monthly, query, read, rounded

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 31)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Closest observation per instrument every two hours, then a summary of each target time's set."""
    cat = q.query_images(images(spark, d), T0, T1)
    grid = sel.time_grid(spark, T0, T1, 2)
    best = sel.choose_cadence(cat, grid, 59, by=["instrument"])
    out = q.summarize_sets(best.select("center", "data_id"), cat, "center")
    return out.select("center", "n_images", "date_min", "date_max", "date_mean", "instrument")


query(
    f"""WITH {IMAGES}, ctr AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 2 HOUR)) AS center),
    near AS (SELECT center, data_id, date_obs, instrument, row_number() OVER (PARTITION BY center, instrument
      ORDER BY abs(epoch_us(date_obs) - epoch_us(center)), date_obs, data_id) AS rn FROM cat JOIN ctr
      ON date_obs BETWEEN center - INTERVAL 59 MINUTE AND center + INTERVAL 59 MINUTE
      WHERE flag = 0 AND date_obs BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31')
    SELECT center, count(*) AS n_images, min(date_obs) AS date_min, max(date_obs) AS date_max,
      make_timestamp(CAST(sum(epoch_us(date_obs)) // count(*) AS BIGINT)) AS date_mean,
      CASE WHEN count(DISTINCT instrument) = 1 THEN min(instrument) ELSE 'MULTIPLE' END AS instrument
    FROM near WHERE rn = 1 GROUP BY center"""
)(flagship)


@query(f"WITH {IMAGES} SELECT * FROM cat WHERE date_obs BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND instrument IN ('click', 'view') AND wavelength = 193 AND flag = 0")
def f1_query_images(spark: SparkSession, d: str) -> DataFrame:
    return q.query_images(images(spark, d), datetime(2024, 1, 5), datetime(2024, 1, 20), ["click", "view"], [193])


@query(f"WITH {IMAGES} SELECT * FROM cat WHERE cr_rot BETWEEN 2100.5 AND 2101.5 AND flag = 0")
def f2_query_rotation_range(spark: SparkSession, d: str) -> DataFrame:
    return q.query_images_rotation(images(spark, d), 2100.5, 2101.5)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """orders as data files."""
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("data_id"), F.col("o_orderdate").alias("date_obs"), F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("type"),
        F.concat(F.lit("raw_"), (F.col("o_orderkey") % 9973).cast("string")).alias("fname_raw"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise("x.h5").alias("fname_hdf"), F.when(F.col("o_totalprice") > 300000, -1).otherwise(0).alias("flag"),
    )


FILES = """fil AS (SELECT o_orderkey AS data_id, o_orderdate AS date_obs, o_orderpriority AS provider, o_orderstatus AS type,
  'raw_' || CAST(o_orderkey % 9973 AS VARCHAR) AS fname_raw, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'x.h5' END AS fname_hdf,
  CASE WHEN o_totalprice > 300000 THEN -1 ELSE 0 END AS flag FROM orders)"""


@query(f"WITH {FILES} SELECT * FROM fil WHERE date_obs BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' AND type IN ('F', 'O') AND flag = 0")
def f3_query_files(spark: SparkSession, d: str) -> DataFrame:
    return q.query_files(_files(spark, d), datetime(1996, 1, 1), datetime(1997, 1, 1), ["F", "O"])


@query(f"WITH {FILES} SELECT * FROM fil WHERE fname_hdf = '' AND flag = 0 AND type = 'F'")
def f7_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return q.unprocessed(_files(spark, d), "F")


@query(f"WITH {IMAGES} SELECT instrument, max(date_obs) AS date_obs FROM cat WHERE flag = 0 GROUP BY 1")
def f6_high_water(spark: SparkSession, d: str) -> DataFrame:
    return q.high_water(images(spark, d).where("flag = 0"), "date_obs", ["instrument"])


@query(f"""WITH {IMAGES}, near AS (SELECT arg_min(cr_rot, (abs(epoch_us(date_obs) - epoch_us(TIMESTAMP '2024-01-15')), data_id)) AS c FROM cat
  WHERE abs(epoch_us(date_obs) - epoch_us(TIMESTAMP '2024-01-15')) <= 3600000000) SELECT cat.* FROM cat, near WHERE cr_rot BETWEEN c - 0.5 AND c + 0.5""")
def f8_rotation_around(spark: SparkSession, d: str) -> DataFrame:
    return q.query_rotation(images(spark, d), datetime(2024, 1, 15))


def _combos(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of orders as image sets, parts' catalog by ship date."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("combo_id"), F.col("l_shipdate").alias("date_obs"), F.col("l_returnflag").alias("instrument"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("data_id")).dropDuplicates(["combo_id", "data_id", "date_obs", "instrument"])
    return q.summarize_sets(li.select("combo_id", "data_id").distinct(), li.drop("combo_id"))


COMBOS = """com AS (SELECT l_orderkey AS combo_id, count(*) AS n_images, min(l_shipdate) AS date_min, max(l_shipdate) AS date_max,
  make_timestamp(CAST(sum(epoch_us(l_shipdate)) // count(*) AS BIGINT)) AS date_mean,
  CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'MULTIPLE' END AS instrument FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_returnflag FROM lineitem) GROUP BY 1)"""


@query(f"WITH {COMBOS} SELECT * FROM com")
def a22_summarize_sets(spark: SparkSession, d: str) -> DataFrame:
    return _combos(spark, d)


@query(f"WITH {COMBOS} SELECT * FROM com WHERE date_mean BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' AND instrument = 'R' AND combo_id % 2 = 1")
def f5_query_combos(spark: SparkSession, d: str) -> DataFrame:
    methods = spark.createDataFrame([(0, "LBCC"), (1, "IIT")], "meth_id long, meth_name string")
    got = q.query_combos(_combos(spark, d).withColumn("meth_id", F.col("combo_id") % 2), methods, "IIT", datetime(1996, 1, 1), datetime(1997, 1, 1), "R")
    return got.drop("meth_id")


@query(f"""WITH {MEMBERS}, {COMBOS}, inst AS (SELECT DISTINCT l_orderkey AS combo_id, l_returnflag AS m FROM lineitem),
  both_ AS (SELECT combo_id FROM inst WHERE m IN ('A', 'R') GROUP BY 1 HAVING count(*) = 2)
  SELECT o_orderkey AS map_id, combo_id, o_custkey % 10 AS meth_combo_id, date_mean, date_min, date_max, n_images FROM orders JOIN com ON o_orderkey = combo_id
  WHERE date_mean BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1998-01-01' AND combo_id IN (SELECT combo_id FROM both_)
  AND combo_id IN (SELECT l_orderkey FROM lineitem WHERE l_tax BETWEEN 0.02 AND 0.05) AND o_custkey % 10 IN (2, 3)""")
def j1_query_maps(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    maps = read(spark, d, "orders").select(F.col("o_orderkey").alias("map_id"), F.col("o_orderkey").alias("combo_id"), (F.col("o_custkey") % 10).alias("meth_combo_id"))
    mem = li.select(F.col("l_orderkey").alias("combo_id"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("data_id"))
    img = li.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("data_id"), F.col("l_returnflag").alias("wavelength"))
    methods = spark.createDataFrame([(0, "grid"), (1, "merge")], "meth_id long, meth_name string")
    sets = spark.createDataFrame([(2, 0), (2, 1), (3, 0), (3, 1), (4, 1)], "meth_combo_id long, meth_id long")
    values = li.select(F.col("l_orderkey").alias("map_id"), F.lit(0).cast("long").alias("meth_id"), F.lit(1).alias("var_id"), F.col("l_tax").alias("var_val"))
    names = spark.createDataFrame([(1, "tax")], "var_id int, var_name string")
    found = q.query_maps(maps, _combos(spark, d), mem, img, sets, methods, values, names, mean_range=(datetime(1995, 6, 1), datetime(1998, 1, 1)), wavelengths=["A", "R"], method_names=["grid", "merge"], var_ranges={"tax": (0.02, 0.05)})
    return found[0].select("map_id", "combo_id", "meth_combo_id", "date_mean", "date_min", "date_max", "n_images")


@query(f"""WITH {MEMBERS}, want AS (SELECT combo_id + 1000000 AS want_id, data_id FROM mem WHERE data_id % 7 <> 0),
  nw AS (SELECT want_id, count(*) AS n FROM want GROUP BY 1), nm AS (SELECT combo_id, count(*) AS n FROM mem GROUP BY 1),
  hit AS (SELECT want_id, combo_id, count(*) AS n FROM want JOIN mem USING (data_id) GROUP BY 1, 2),
  same AS (SELECT want_id, min(hit.combo_id) AS combo_id, count(*) AS k FROM hit JOIN nw USING (want_id) JOIN nm ON nm.combo_id = hit.combo_id
    WHERE hit.n = nw.n AND hit.n = nm.n GROUP BY 1)
  SELECT want_id, CASE WHEN k = 1 THEN combo_id END AS combo_id FROM nw LEFT JOIN same USING (want_id)""")
def j2_match_sets(spark: SparkSession, d: str) -> DataFrame:
    mem = members(spark, d)
    want = mem.where("data_id % 7 <> 0").select((F.col("combo_id") + 1000000).alias("want_id"), "data_id")
    return q.match_sets(want, mem, "want_id", "combo_id", "data_id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def j8_missing(spark: SparkSession, d: str) -> DataFrame:
    store = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return q.missing(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), store, "o_orderkey")


TARGETS = "tgt AS (SELECT o_orderkey, o_orderdate, o_custkey % 100 AS supp FROM orders)"
BOTH = f"""WITH {MONTHLY}, {TARGETS}, b AS (SELECT o_orderkey, o_orderdate, tgt.supp, max(CASE WHEN date_mean <= o_orderdate THEN date_mean END) AS t0,
  min(CASE WHEN date_mean >= o_orderdate THEN date_mean END) AS t1 FROM tgt LEFT JOIN par ON par.supp = tgt.supp GROUP BY 1, 2, 3)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 100).alias("supp"))


@query(BOTH + " SELECT o_orderkey, t0 AS before_time, t1 AS after_time FROM b")
def j4_asof_bracket(spark: SparkSession, d: str) -> DataFrame:
    got = asof.asof_bracket(_targets(spark, d), monthly(spark, d), "o_orderdate", "date_mean", ["q"], ["supp"])
    return got.select("o_orderkey", F.col("before.time").alias("before_time"), F.col("after.time").alias("after_time"))


@query(BOTH + """ SELECT o_orderkey, round(CASE WHEN t0 < t1 THEN a.q + (z.q - a.q) * (epoch_us(o_orderdate) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0))
  ELSE coalesce(a.q, z.q) END, 6) AS q, round(CASE WHEN t0 < t1 THEN a.d + (z.d - a.d) * (epoch_us(o_orderdate) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0))
  ELSE coalesce(a.d, z.d) END, 6) AS d FROM b LEFT JOIN par a ON a.supp = b.supp AND a.date_mean = t0 LEFT JOIN par z ON z.supp = b.supp AND z.date_mean = t1""")
def j5_interp_params(spark: SparkSession, d: str) -> DataFrame:
    got = asof.interp_params(_targets(spark, d), monthly(spark, d), "o_orderdate", "date_mean", ["q", "d"], ["supp"])
    return rounded(got.select("o_orderkey", "q", "d"), 6, "q", "d")


@query(f"""WITH {MONTHLY}, {TARGETS}, r AS (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY date_mean) AS u, row_number() OVER (PARTITION BY supp ORDER BY date_mean DESC) AS v FROM par),
  e AS (SELECT supp, max(CASE WHEN u = 1 THEN date_mean END) AS at0, max(CASE WHEN u = 1 THEN q END) AS aq, max(CASE WHEN u = 2 THEN date_mean END) AS bt, max(CASE WHEN u = 2 THEN q END) AS bq,
    max(CASE WHEN v = 1 THEN date_mean END) AS zt, max(CASE WHEN v = 1 THEN q END) AS zq, max(CASE WHEN v = 2 THEN date_mean END) AS yt, max(CASE WHEN v = 2 THEN q END) AS yq FROM r GROUP BY 1),
  b AS (SELECT o_orderkey, o_orderdate, tgt.supp, max(CASE WHEN date_mean <= o_orderdate THEN date_mean END) AS t0,
  min(CASE WHEN date_mean >= o_orderdate THEN date_mean END) AS t1 FROM tgt LEFT JOIN par ON par.supp = tgt.supp GROUP BY 1, 2, 3),
  n AS (SELECT b.*, a.q AS q0, z.q AS q1 FROM b LEFT JOIN par a ON a.supp = b.supp AND a.date_mean = t0 LEFT JOIN par z ON z.supp = b.supp AND z.date_mean = t1)
  SELECT o_orderkey, round(CASE WHEN o_orderdate < at0 THEN aq + coalesce((bq - aq) * (epoch_us(o_orderdate) - epoch_us(at0))::DOUBLE / (epoch_us(bt) - epoch_us(at0)), 0)
    WHEN o_orderdate > zt THEN zq + coalesce((yq - zq) * (epoch_us(o_orderdate) - epoch_us(zt))::DOUBLE / (epoch_us(yt) - epoch_us(zt)), 0)
    WHEN coalesce(epoch_us(o_orderdate) - epoch_us(t0) > 1728000000000, false) OR coalesce(epoch_us(t1) - epoch_us(o_orderdate) > 1728000000000, false) THEN NULL
    WHEN t0 < t1 THEN q0 + (q1 - q0) * (epoch_us(o_orderdate) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0)) ELSE coalesce(q0, q1) END, 6) AS q
  FROM n LEFT JOIN e ON e.supp = n.supp""")
def j6_windowed_params(spark: SparkSession, d: str) -> DataFrame:
    got = asof.extrapolate_params(_targets(spark, d), monthly(spark, d), "o_orderdate", "date_mean", ["q"], ["supp"], days=20)
    return rounded(got.select("o_orderkey", "q"), 6, "q")


@query(BOTH + """ SELECT o_orderkey, CASE WHEN t1 IS NULL OR epoch_us(o_orderdate) - epoch_us(t0) <= epoch_us(t1) - epoch_us(o_orderdate) THEN t0 ELSE t1 END AS nearest_time FROM b""")
def j7_asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    got = asof.asof_nearest(_targets(spark, d), monthly(spark, d), "o_orderdate", "date_mean", ["q"], ["supp"])
    return got.select("o_orderkey", F.col("nearest.time").alias("nearest_time"))


@query(f"""WITH {IMAGES}, ctr AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 6 HOUR)) AS center)
  SELECT center, instrument, arg_min(data_id, (abs(epoch_us(date_obs) - epoch_us(center)), date_obs, data_id)) AS data_id FROM cat JOIN ctr
  ON date_obs BETWEEN center - INTERVAL 60 MINUTE AND center + INTERVAL 60 MINUTE GROUP BY 1, 2""")
def j10_choose_cadence(spark: SparkSession, d: str) -> DataFrame:
    got = sel.choose_cadence(images(spark, d), sel.time_grid(spark, T0, T1, 6), 60, by=["instrument"])
    return got.select("center", "instrument", "data_id")


PICK = f"""WITH {IMAGES}, ctr AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 6 HOUR)) AS center),
  near AS (SELECT center, instrument, data_id, epoch_us(date_obs) AS t, epoch_us(center) AS c FROM cat JOIN ctr ON date_obs BETWEEN center - INTERVAL 40 MINUTE AND center + INTERVAL 40 MINUTE),
  a AS (SELECT center, data_id AS ia, t AS ta FROM near WHERE instrument = 'click'), b AS (SELECT center, data_id AS ib, t AS tb FROM near WHERE instrument = 'view'),
  p AS (SELECT ctr.center, ia, ta, ib, tb, epoch_us(ctr.center) AS c FROM ctr LEFT JOIN a ON a.center = ctr.center LEFT JOIN b ON b.center = ctr.center),
  s AS (SELECT *, coalesce(pow((ta - c) / 86400e6, 2), 0) + coalesce(pow((tb - c) / 86400e6, 2), 0) + coalesce(pow((ta - tb) / 86400e6, 2), 0) AS cost FROM p),
  best AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY round(cost, 15), ta, tb, ia, ib) AS rn FROM s),
  sel AS (SELECT center, 'click' AS instrument, ia AS data_id FROM best WHERE rn = 1 AND ia IS NOT NULL UNION ALL SELECT center, 'view', ib FROM best WHERE rn = 1 AND ib IS NOT NULL)"""


@query(PICK + " SELECT * FROM sel")
def j9_select_synchronic(spark: SparkSession, d: str) -> DataFrame:
    got = sel.select_synchronic(images(spark, d), sel.time_grid(spark, T0, T1, 6), ["click", "view"], 40)
    return got.select("center", "instrument", "data_id")


@query(PICK + """ , old AS (SELECT center, instrument, CASE WHEN data_id % 2 = 0 THEN data_id ELSE data_id + 1 END AS old FROM sel WHERE data_id % 3 <> 0)
  SELECT center, instrument, data_id, CASE WHEN data_id IS NULL THEN -1 WHEN old = data_id THEN 2 WHEN old IS NOT NULL THEN 3 ELSE 0 END AS result
  FROM (SELECT center, i AS instrument FROM ctr, (VALUES ('click'), ('view')) v(i)) g LEFT JOIN sel USING (center, instrument) LEFT JOIN old USING (center, instrument)""")
def j21_selection_log(spark: SparkSession, d: str) -> DataFrame:
    cat = images(spark, d).withColumn("url", F.lit("http://example/data"))
    grid = sel.time_grid(spark, T0, T1, 6)
    old = sel.select_synchronic(cat, grid, ["click", "view"], 40).where("data_id % 3 <> 0").select("center", "instrument", F.when(F.col("data_id") % 2 == 0, F.col("data_id")).otherwise(F.col("data_id") + 1).alias("data_id"))
    return sel.selection_log(grid, cat, old, ["click", "view"], 40)


@query("""WITH w AS (SELECT min(ts) AS a, max(ts) AS z FROM events) SELECT unnest(generate_series(a, z, INTERVAL 7 HOUR)) AS center FROM w""")
def w1_time_grid(spark: SparkSession, d: str) -> DataFrame:
    a, z = read(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    return sel.time_grid(spark, a, z, 7)


@query("""WITH w AS (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS z FROM lineitem), m AS (SELECT a + CAST((8 - isodow(a)) % 7 AS INTEGER) AS f, z FROM w)
  SELECT CAST(unnest(generate_series(CAST(f AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 7 DAY)) AS TIMESTAMP) AS center FROM m""")
def w2_weekly_centers(spark: SparkSession, d: str) -> DataFrame:
    a, z = read(spark, d, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return sel.weekly_centers(spark, a, z)


@query(f"""WITH {IMAGES} SELECT data_id, instrument, CAST(round((epoch_us(date_obs) - coalesce(lag(epoch_us(date_obs)) OVER (PARTITION BY instrument ORDER BY date_obs, data_id),
  epoch_us(TIMESTAMP '2024-01-01') - 3600000000))::DOUBLE / 3600000000 - 1) AS BIGINT) AS missing FROM cat""")
def w3_gaps(spark: SparkSession, d: str) -> DataFrame:
    return qual.gaps(images(spark, d), 1, T0, by=["instrument"]).select("data_id", "instrument", "missing")


@query("""WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_linenumber FROM lineitem JOIN s USING (l_returnflag) WHERE abs(l_extendedprice - m) > 1.6 * s""")
def w7_outliers(spark: SparkSession, d: str) -> DataFrame:
    return qual.outliers(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], 1.6).select("l_orderkey", "l_linenumber")


@query(f"""WITH {IMAGES} SELECT data_id, count(*) OVER (PARTITION BY instrument ORDER BY epoch_us(date_obs) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM cat""")
def w10_frames_in_window(spark: SparkSession, d: str) -> DataFrame:
    return qual.frames_in_window(images(spark, d), 24, "date_obs", ["instrument"]).select("data_id", "in_window")


@query(f"""WITH {FILES}, old AS (SELECT * FROM fil WHERE data_id % 5 < 3), new AS (SELECT * FROM fil WHERE data_id % 5 >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY date_obs, provider, type ORDER BY fname_raw, data_id) AS k, row_number() OVER (PARTITION BY fname_raw ORDER BY date_obs, provider, type, data_id) AS n FROM new)
  SELECT data_id, CASE WHEN k > 1 OR EXISTS (SELECT 1 FROM old o WHERE o.date_obs = r.date_obs AND o.provider = r.provider AND o.type = r.type) THEN 1
    WHEN n > 1 OR EXISTS (SELECT 1 FROM old o WHERE o.fname_raw = r.fname_raw) THEN 2 ELSE 0 END AS out_flag FROM r""")
def s5_register_files(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return reg.register_files(f.where("data_id % 5 < 3"), f.where("data_id % 5 >= 2")).select("data_id", "out_flag")


@query("""WITH s AS (SELECT l_suppkey AS image_id, l_linenumber AS meth_id, round(CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) * 10 / count(l_tax)) / 1000 + 0.01 AS lat_band, count(*) AS n FROM lineitem GROUP BY 1, 2),
  n AS (SELECT image_id, meth_id, lat_band * (CASE WHEN image_id % 2 = 0 THEN 1.00005 ELSE 1.0005 END) AS lat_band, n + 1000 AS n FROM s WHERE image_id % 3 <> 0)
  SELECT s.image_id, s.meth_id, round(s.lat_band, 8) AS lat_band, coalesce(n.n, s.n) AS n FROM s LEFT JOIN n ON s.image_id = n.image_id AND s.meth_id = n.meth_id AND abs(s.lat_band - n.lat_band) <= 1e-4 * abs(n.lat_band)
  UNION ALL SELECT image_id, meth_id, round(lat_band, 8), n FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.image_id = n.image_id AND s.meth_id = n.meth_id AND abs(s.lat_band - n.lat_band) <= 1e-4 * abs(n.lat_band))""")
def s6_upsert_hists(spark: SparkSession, d: str) -> DataFrame:
    """Bands are mean taxes in thousandths, of sums in whole hundredths: a mean halfway rounds up, whatever the order of rows."""
    mean = F.sum(F.round(F.col("l_tax") * 100).cast("long")) * 10 / F.count("l_tax")
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("meth_id")).agg((F.round(mean) / 1000 + 0.01).alias("lat_band"), F.array(F.count("*")).alias("hist"))
    s = s.withColumns({"n_mu_bins": F.lit(1), "n_intensity_bins": F.lit(1)})
    band = F.col("lat_band") * F.when(F.col("image_id") % 2 == 0, 1.00005).otherwise(1.0005)
    new = s.where("image_id % 3 <> 0").withColumns({"lat_band": band, "hist": F.transform("hist", lambda x: x + 1000)})
    return reg.upsert_hists(s, new, True).select("image_id", "meth_id", F.round("lat_band", 8).alias("lat_band"), F.get("hist", F.lit(0)).alias("n"))


@query("""WITH m AS (SELECT o_orderkey AS map_id, o_custkey AS combo_id, 1 AS meth FROM orders), v AS (SELECT l_orderkey AS map_id, l_linenumber AS var_id, l_discount AS val FROM lineitem),
  n AS (SELECT map_id + 10000000 AS map_id, combo_id, meth, map_id AS src FROM m WHERE map_id % 4 = 0), nv AS (SELECT n.map_id, var_id, val * (CASE WHEN src % 8 = 0 THEN 1 ELSE 1.001 END) AS val FROM n JOIN v ON v.map_id = n.src),
  w AS (SELECT map_id, count(*) AS k FROM nv GROUP BY 1),
  h AS (SELECT n.map_id, m.map_id AS old, count(v.var_id) AS k FROM n JOIN m ON m.combo_id = n.combo_id AND m.meth = n.meth LEFT JOIN nv ON nv.map_id = n.map_id
    LEFT JOIN v ON v.map_id = m.map_id AND v.var_id = nv.var_id AND abs(v.val - nv.val) <= 1e-6 * abs(nv.val) GROUP BY 1, 2)
  SELECT n.map_id, min(CASE WHEN h.k = coalesce(w.k, 0) THEN old END) AS existing FROM n LEFT JOIN h ON h.map_id = n.map_id LEFT JOIN w ON w.map_id = n.map_id GROUP BY 1""")
def s7_register_maps(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "orders").select(F.col("o_orderkey").alias("map_id"), F.col("o_custkey").alias("combo_id"), F.lit(1).alias("meth_combo_id"), F.lit(None).cast("string").alias("fname"))
    v = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("map_id"), F.col("l_linenumber").alias("var_id"), F.col("l_discount").alias("var_val"))
    new = m.where("map_id % 4 = 0").withColumn("map_id", F.col("map_id") + 10000000)
    new_v = v.where("map_id % 4 = 0").select((F.col("map_id") + 10000000).alias("map_id"), "var_id", (F.col("var_val") * F.when(F.col("map_id") % 8 == 0, 1.0).otherwise(1.001)).alias("var_val"))
    return reg.register_maps(m, v, new, new_v).select("map_id", "existing")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN -1 ELSE 0 END AS flag FROM orders")
def s8_update_column(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("flag"))
    return reg.update_column(o, F.col("o_totalprice") > 200000, "flag", F.lit(-1)).select("o_orderkey", "flag")


@query("""SELECT 'lineitem' AS "table", count(*) AS deleted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def s9_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    ids = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("data_id"))
    return reg.delete_cascade({"orders": (o, "o_orderkey"), "lineitem": (li, "l_orderkey")}, ids, "data_id")[1]


@query("""WITH dim AS (SELECT p_partkey AS var_id, p_name AS var_name FROM part WHERE p_size < 25), m AS (SELECT max(var_id) AS m FROM dim)
  SELECT * FROM dim UNION ALL SELECT m + row_number() OVER (ORDER BY var_name), var_name FROM (SELECT DISTINCT p_name AS var_name FROM part WHERE p_name NOT IN (SELECT var_name FROM dim)), m""")
def s10_upsert_dim(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    dim = p.where("p_size < 25").select(F.col("p_partkey").alias("var_id"), F.col("p_name").alias("var_name"))
    return reg.upsert_dim(dim, p.select(F.col("p_name").alias("var_name")), ["var_name"], "var_id")


@query("SELECT o_orderkey AS combo_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)")
def s11_orphan_combos(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumn("combo_id", F.col("l_orderkey"))
    return reg.orphan_combos(read(spark, d, "orders").select(F.col("o_orderkey").alias("combo_id")), li.where("l_quantity > 40"), li.where("l_discount > 0.08"))


@query("""WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08))
  SELECT 'sets' AS name, count(k) AS n_dropped, count(*) - count(k) AS n_kept FROM orders LEFT JOIN gone ON o_orderkey = k
  UNION ALL SELECT 'links', count(k), count(*) - count(k) FROM lineitem LEFT JOIN gone ON l_orderkey = k""")
def s11_drop_orphans(spark: SparkSession, d: str) -> DataFrame:
    sets, links = read(spark, d, "orders").select(F.col("o_orderkey").alias("combo_id")), read(spark, d, "lineitem").withColumn("combo_id", F.col("l_orderkey"))
    return reg.drop_combos(s11_orphan_combos(spark, d), {"sets": sets, "links": links})[1]


@query(f"""WITH {MONTHLY}, f AS (SELECT supp AS combo_id, round(avg(q), 6) AS q, round(avg(d), 6) AS d FROM par GROUP BY 1)
  SELECT combo_id, 1 AS meth_id, 1 AS var_id, q AS var_val FROM f UNION ALL SELECT combo_id, 1, 2, d FROM f UNION ALL SELECT combo_id, 1, 3, 0.5 FROM f WHERE combo_id % 2 = 0""")
def s12_store_params(spark: SparkSession, d: str) -> DataFrame:
    fits = rounded(monthly(spark, d).groupBy(F.col("supp").alias("combo_id")).agg(F.avg("q").alias("q"), F.avg("d").alias("d")), 6, "q", "d").withColumn("meth_id", F.lit(1))
    names = spark.createDataFrame([(1, 1, "q"), (2, 1, "d")], "var_id int, meth_id int, var_name string")
    old = fits.select("combo_id", "meth_id", F.lit(1).alias("var_id"), F.lit(0.0).alias("var_val")).unionByName(fits.where("combo_id % 2 = 0").select("combo_id", "meth_id", F.lit(3).alias("var_id"), F.lit(0.5).alias("var_val")))
    return reg.store_params(old, fits, names, ["q", "d"])


@query(f"""WITH {COMBOS}, e AS (SELECT l_returnflag AS instrument, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem GROUP BY 1)
  SELECT combo_id FROM com JOIN e USING (instrument) WHERE epoch_us(date_mean) < epoch_us(a) + 60 * 86400000000 OR epoch_us(date_mean) > epoch_us(z) - 60 * 86400000000""")
def s14_trim_params(spark: SparkSession, d: str) -> DataFrame:
    img = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("instrument"), F.col("l_shipdate").alias("date_obs"))
    return reg.trim_params(_combos(spark, d), img, 60)


@query(f"""WITH {COMBOS}, e AS (SELECT l_returnflag AS instrument, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem GROUP BY 1),
  gone AS (SELECT combo_id FROM com JOIN e USING (instrument) WHERE epoch_us(date_mean) < epoch_us(a) + 60 * 86400000000 OR epoch_us(date_mean) > epoch_us(z) - 60 * 86400000000)
  SELECT l_orderkey AS combo_id, l_linenumber AS var_id, l_tax AS var_val FROM lineitem WHERE l_orderkey NOT IN (SELECT combo_id FROM gone)""")
def s14_trim_values(spark: SparkSession, d: str) -> DataFrame:
    values = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("combo_id"), F.col("l_linenumber").alias("var_id"), F.col("l_tax").alias("var_val"))
    return reg.drop_combos(s14_trim_params(spark, d), {"values": values})[0]["values"]


@query("""WITH p AS (SELECT l_orderkey AS data_id, l_linenumber AS iy, min(l_returnflag) AS instrument, min(l_shipdate) AS ts, min(l_discount) AS v, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
  SELECT data_id, iy, instrument, ts, q > 40 AS mask, round(CASE instrument WHEN 'A' THEN 1.1 * v + 0.02 WHEN 'N' THEN 0.9 * v - 0.01 ELSE v END, 9) AS value FROM p WHERE q > 10""")
def s17_training_pixels(spark: SparkSession, d: str) -> DataFrame:
    px = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("data_id"), F.col("l_linenumber").alias("iy")).agg(F.min("l_returnflag").alias("instrument"), F.min("l_shipdate").alias("ts"), F.min("l_discount").alias("value"), F.max("l_quantity").alias("q"))
    masks = px.where("q > 10").select("data_id", "iy", F.expr("q > 40").alias("hole"))  # some pixels have no mask
    scaling = spark.createDataFrame([("A", 1.1, 0.02), ("N", 0.9, -0.01)], "instrument string, alpha double, x double")
    return rounded(reg.training_pixels(px, masks, scaling, ["data_id", "iy"]), 9, "value")


@query("""WITH a AS (SELECT l_suppkey AS k, round(avg(l_quantity), 6) AS v FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1), b AS (SELECT l_suppkey AS k, round(avg(CASE WHEN l_suppkey % 5 = 0 THEN l_tax ELSE l_quantity END), 6) AS v FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'differs' END AS difference FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def s15_diff_stores(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumn("k", F.col("l_suppkey"))
    a = li.where("k % 7 <> 0").groupBy("k").agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    b = li.where("k % 11 <> 0").groupBy("k").agg(F.round(F.avg(F.when(F.col("k") % 5 == 0, F.col("l_tax")).otherwise(F.col("l_quantity"))), 6).alias("v"))
    return qual.diff_stores(a, b, ["k"], ["v"])


@query("SELECT o_orderkey AS map_id, CASE WHEN o_custkey % 4 = 0 THEN 77 ELSE o_custkey % 10 END AS meth_combo_id FROM orders")
def s16_set_map_methods(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    maps = o.select(F.col("o_orderkey").alias("map_id"), (F.col("o_custkey") % 10).alias("meth_combo_id"), "o_custkey")
    none = spark.createDataFrame([], "map_id long, combo_id long, var_id int, var_val double")
    return reg.set_map_methods(maps, none, maps.where("o_custkey % 4 = 0"), 77, none)[0].select("map_id", "meth_combo_id")


@query("""SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) + to_hours(CAST(least(floor((epoch_us(ts) - epoch_us(date_trunc('day', ts)))::DOUBLE / 21600000000 + 0.5) * 6, 24) AS BIGINT)) AS near_6h,
  CAST(date_trunc('day', ts + INTERVAL 12 HOUR) AS TIMESTAMP) AS near_day, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0, 6)::DOUBLE AS hours, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 4)::DOUBLE AS jd FROM events""")
def m9_m11_times(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    return read(spark, d, "events").select("event_id", times.round_hours(t, 6).alias("near_6h"), times.round_day(t).alias("near_day"), F.round(times.hours_between(F.lit(T0), t), 6).alias("hours"), F.round(times.julian_date(t), 4).alias("jd"))

"""Scalar functions, calibration and small registry queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import photometry as phot
from ..functions import times
from ..operators import calibration
from ..operators import query as q
from ..operators import registry as reg
from .base import IMAGES, PIXELS, images, pixels, query, read, rounded


@query(f"WITH {IMAGES} SELECT cat.*, o_orderpriority AS provider FROM cat JOIN orders ON o_orderkey = data_id")
def s1_image_catalog(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "orders").select(F.col("o_orderkey").alias("data_id"), F.col("o_orderpriority").alias("provider"))
    return q.image_catalog(images(spark, d), files)


HISTS = """st AS (SELECT l_suppkey AS image_id, l_linenumber AS meth_id, CASE WHEN l_suppkey % 3 = 0 THEN 18 END AS n_mu_bins, 200 AS n_intensity_bins,
  0.04908 * (1 + (l_suppkey % 5) * 0.00004) AS lat_band, max(l_shipdate) AS date_obs, min(l_returnflag) AS instrument, 193 AS wavelength FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {HISTS} SELECT image_id, meth_id FROM st WHERE meth_id = 2 AND n_mu_bins = 18 AND n_intensity_bins = 200 AND abs(lat_band - 0.04908) <= 1e-4 * 0.04908 AND date_obs BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2002-01-01' AND instrument IN ('A', 'N')")
def f4_query_hists(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("meth_id")).agg(F.max("l_shipdate").alias("date_obs"), F.min("l_returnflag").alias("instrument"))
    s = s.withColumns({"n_mu_bins": F.when(F.col("image_id") % 3 == 0, 18), "n_intensity_bins": F.lit(200), "lat_band": 0.04908 * (1 + (F.col("image_id") % 5) * 0.00004), "wavelength": F.lit(193)})
    return q.query_hists(s, 2, 18, 200, 0.04908, datetime(1996, 1, 1), datetime(2002, 1, 1), ["A", "N"]).select("image_id", "meth_id")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS set_id, o_orderstatus AS meth FROM orders), w AS (SELECT * FROM (VALUES (1, 'F'), (1, 'O'), (2, 'P'), (3, 'F'), (3, 'O'), (3, 'P'), (4, 'X')) v(want_id, meth)),
  nm AS (SELECT set_id, count(*) AS n FROM m GROUP BY 1), nw AS (SELECT want_id, count(*) AS n FROM w GROUP BY 1), h AS (SELECT want_id, set_id, count(*) AS n FROM w JOIN m USING (meth) GROUP BY 1, 2),
  s AS (SELECT want_id, min(h.set_id) AS set_id, count(*) AS k FROM h JOIN nm ON nm.set_id = h.set_id JOIN nw USING (want_id) WHERE h.n = nm.n AND h.n = nw.n GROUP BY 1)
  SELECT want_id, CASE WHEN k = 1 THEN set_id END AS set_id FROM nw LEFT JOIN s USING (want_id)""")
def j3_match_method_sets(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderstatus").alias("meth"))
    w = spark.createDataFrame([(1, "F"), (1, "O"), (2, "P"), (3, "F"), (3, "O"), (3, "P"), (4, "X")], "want_id int, meth string")
    return q.match_sets(w, m, "want_id", "set_id", "meth")


@query(f"""WITH {IMAGES}, t AS (SELECT * FROM (VALUES (193, TIMESTAMP '2024-01-05', 0.9), (193, TIMESTAMP '2024-01-15', 0.7), (193, TIMESTAMP '2024-01-20', 0.65)) v(w, ts, f)),
  b AS (SELECT data_id, date_obs, wavelength, max(CASE WHEN ts <= date_obs THEN ts END) AS t0, min(CASE WHEN ts >= date_obs THEN ts END) AS t1 FROM cat LEFT JOIN t ON w = wavelength GROUP BY 1, 2, 3)
  SELECT data_id, round(CASE WHEN wavelength <> 193 THEN NULL WHEN t0 IS NULL THEN 1 WHEN t1 IS NULL OR t0 = t1 THEN a.f ELSE a.f + (z.f - a.f) * (epoch_us(date_obs) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0)) END, 6)::DOUBLE AS factor
  FROM b LEFT JOIN t a ON a.ts = t0 AND a.w = wavelength LEFT JOIN t z ON z.ts = t1 AND z.w = wavelength""")
def m8_degradation(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([(193, datetime(2024, 1, 5), 0.9), (193, datetime(2024, 1, 15), 0.7), (193, datetime(2024, 1, 20), 0.65)], "wavelength int, ts timestamp_ntz, factor double")
    return rounded(calibration.degradation_factor(images(spark, d), table).select("data_id", "factor"), 6, "factor")


@query(f"""WITH {IMAGES}, a AS (SELECT data_id, cr_rot, floor(cr_rot) + k - (value - floor(value / 360) * 360) / 360 AS near FROM cat, (VALUES (-1), (0), (1), (2)) v(k))
  SELECT data_id, round(arg_min(near, abs(near - cr_rot)), 8) AS rotation FROM a GROUP BY data_id""")
def m10_rotation_relative(spark: SparkSession, d: str) -> DataFrame:
    lon = F.pmod("value", F.lit(360.0))
    return rounded(images(spark, d).select("data_id", times.rotation_relative(F.col("cr_rot"), lon).alias("rotation")), 8, "rotation")


@query(f"""WITH {PIXELS} SELECT map_id, iy, ix, round(data / greatest(mu - 0.95, 0.01), 3) AS br, round(sin((iy + 0.5) * pi() / 20) * (pi() / 20) * (2 * pi() / 40), 10) AS da,
  round(exp(-pow((ix * 9 - 180) / (10 / 2.3548200450309493), 2) / 2) / (10 / 2.3548200450309493 * sqrt(2 * pi())), 10) AS weight,
  round(greatest(0, least(ix + 1, 20.5) - greatest(ix, 10.25)), 6)::DOUBLE AS shared, round(1 / (1 - mu / 215), 10) AS wide, round(0.99998914 / (1 - mu * 0.00466), 10) AS apparent FROM px""")
def m5_m12_pixel_functions(spark: SparkSession, d: str) -> DataFrame:
    from math import pi

    iy, ix, mu = F.col("iy"), F.col("ix"), F.col("mu")
    return pixels(spark, d).select(
        "map_id", "iy", "ix", F.round(geo.radial_field(F.col("data"), mu - 0.95), 3).alias("br"), F.round(geo.cell_area((iy + 0.5) * (pi / 20), F.lit(pi / 20), F.lit(2 * pi / 40)), 10).alias("da"),
        F.round(geo.gauss_longitude(ix * 9, F.lit(180)), 10).alias("weight"), F.round(geo.overlap(ix, ix + 1, F.lit(10.25), F.lit(20.5)), 6).alias("shared"),
        F.round(geo.perspective_scale(mu, 1.0, 215.0), 10).alias("wide"), F.round(geo.apparent_radius_scale(mu), 10).alias("apparent"),
    )


@query(f"""WITH {PIXELS}, a AS (SELECT map_id, iy, ix, (ix + 0.5) * 2 * pi() / 40 - radians(map_id * 40) AS t, (iy + 0.5) / 10 - 1 AS s, radians(5) AS b, radians(12) AS r FROM px),
  c AS (SELECT *, sqrt(1 - s * s) * sin(t) AS e, s * cos(b) - sqrt(1 - s * s) * cos(t) * sin(b) AS y0, s * sin(b) + sqrt(1 - s * s) * cos(t) * cos(b) AS z FROM a)
  SELECT map_id, iy, ix, round(e * cos(r) + y0 * sin(r), 8) AS x, round(y0 * cos(r) - e * sin(r), 8) AS y, round(z, 8) AS z FROM c""")
def m3_map_to_image(spark: SparkSession, d: str) -> DataFrame:
    from math import pi

    xyz = geo.map_to_image((F.col("ix") + 0.5) * (2 * pi / 40), (F.col("iy") + 0.5) / 10 - 1, F.col("map_id") * 40, F.lit(5), F.lit(12))
    return pixels(spark, d).select("map_id", "iy", "ix", *[F.round(c, 8).alias(n) for c, n in zip(xyz, "xyz", strict=True)])


@query("SELECT event_id, replace(replace(replace(strftime(ts, '%Y-%m-%dT%H:%M'), '-', ''), ':', ''), 'T', '_') AS path FROM events")
def m17_path_of_time(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", times.path_of_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("path"))


@query(f"WITH {PIXELS} SELECT map_id, iy, ix, data > 30000 AND mu - 0.93 > 0 AS usable, mu - 0.93 > 0 AS detectable FROM px")
def f10_use_mask(spark: SparkSession, d: str) -> DataFrame:
    mu = F.col("mu") - 0.93
    return pixels(spark, d).select("map_id", "iy", "ix", phot.usable(mu, F.col("data"), 30000.0).alias("usable"), phot.detectable(mu, F.col("data")).alias("detectable"))


@query("SELECT o_orderkey AS data_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x.h5' END AS fname_hdf FROM orders")
def s9_delete_processed(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "orders").select(F.col("o_orderkey").alias("data_id"), F.lit("x.h5").alias("fname_hdf"))
    return reg.delete_images(files, files.where("data_id % 3 = 0"))

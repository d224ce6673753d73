"""Merging, resampling and region queries over lineitem as pixel maps, and sphere functions over embeddings."""

from __future__ import annotations

import uuid
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import photometry as phot
from ..operators import grid, merge, regions
from ..plans.graph import components
from ..plans.tables import shared_dir
from ..sources import rasters, store
from .base import PIXELS, pixels, query, read, rounded

VALID = "(data >= 0 AND mu >= 0.92)"


@query(f"""WITH {PIXELS}, g AS (SELECT *, max(CASE WHEN mu >= 0.92 THEN mu END) OVER (PARTITION BY iy, ix) AS top FROM px),
  r AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY {VALID} DESC, coalesce(mu > top - 0.03, false) DESC, data, map_id) AS k FROM g)
  SELECT iy, ix, CASE WHEN {VALID} THEN data END AS data, CASE WHEN {VALID} THEN mu END AS mu, CASE WHEN {VALID} THEN chd END AS chd, CASE WHEN {VALID} THEN origin_image END AS origin_image FROM r WHERE k = 1""")
def a12_merge_min(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_min(pixels(spark, d), del_mu=0.03, mu_cutoff=0.92)


@query(f"""WITH {PIXELS}, r AS (SELECT *, sum(CASE WHEN {VALID} THEN 1 ELSE 0 END) OVER (PARTITION BY iy, ix) AS n FROM px), s AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY {VALID} DESC, (n < 2 OR mu >= 0.96) DESC, data, map_id) AS k FROM r)
  SELECT iy, ix, CASE WHEN {VALID} THEN data END AS data FROM s WHERE k = 1""")
def a12_merge_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_min(pixels(spark, d), mu_cutoff=0.92, mu_merge_cutoff=0.96).select("iy", "ix", "data")


LOW = f"{PIXELS}, lo AS (SELECT * EXCLUDE (data), CASE WHEN data >= 20000 THEN data END AS data FROM px)"


def _low(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.query import mask_low

    return mask_low(pixels(spark, d), least=20000.0)


def _logged(df: DataFrame) -> DataFrame:
    """df with the logarithm of its data: means of decimals, which may end in a 5, are not rounded themselves."""
    return rounded(df.withColumn("log_data", F.log10("data")).drop("data"), 9, "log_data")


@query(f"""WITH {PIXELS} SELECT g.map_id, CAST(y AS INTEGER) AS iy, CAST(x AS INTEGER) AS ix, x::DOUBLE AS x, y * 0.5::DOUBLE AS y, px.data FROM (SELECT DISTINCT map_id FROM px) g CROSS JOIN range(20) a(y) CROSS JOIN range(40) b(x) LEFT JOIN px ON px.map_id = g.map_id AND px.iy = y AND px.ix = x""")
def s3_raster_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Maps as rasters with axes, and back to pixels."""
    px = pixels(spark, d).select("map_id", "iy", "ix", "data")
    full = px.select("map_id").distinct().withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(39)))).join(px, ["map_id", "iy", "ix"], "left")
    axis = lambda n, step: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * F.lit(step))
    return rasters.raster_to_pixels(rasters.pixels_to_raster(full).withColumns({"x": axis(40, 1.0), "y": axis(20, 0.5)}))


@query(f"WITH {PIXELS} SELECT map_id, iy, ix, CASE WHEN map_id % 2 = 1 THEN 2 * data ELSE data END AS data, CAST(TIMESTAMP '2020-01-01' + to_days(CAST(map_id % 20 AS INTEGER)) AS DATE) AS map_date FROM px")
def s4_map_store(spark: SparkSession, d: str) -> DataFrame:
    """All maps in one commit, then those of odd number anew; read as of the last."""
    px = pixels(spark, d).select("map_id", "iy", "ix", "data")
    info = px.select("map_id").distinct().withColumn("date_mean", F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(cast(map_id % 20 as int))"))
    path = f"{shared_dir(spark)}/maps-{uuid.uuid4().hex}"
    store.write_maps(px, info, path)
    store.write_maps(px.where("map_id % 2 = 1").withColumn("data", 2 * F.col("data")), info.where("map_id % 2 = 1"), path)
    return store.read_maps(spark, path)[0]


@query(f"WITH {LOW} SELECT map_id, iy, ix, data FROM lo")
def f9_mask_low(spark: SparkSession, d: str) -> DataFrame:
    return _low(spark, d).select("map_id", "iy", "ix", "data")


@query(f"WITH {LOW} SELECT iy, ix, min(data) AS data, round(avg(CASE WHEN data IS NOT NULL THEN chd END), 8) AS chd, CAST(count(data) AS BIGINT) AS n_maps FROM lo GROUP BY 1, 2")
def a13_merge_synoptic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(merge.merge_synoptic(_low(spark, d)), 8, "chd")


@query(f"WITH {LOW} SELECT iy, ix, min(data) AS data, round(avg(CASE WHEN data IS NOT NULL THEN chd * greatest(mu, 0.01) END), 8) AS chd, CAST(count(data) AS BIGINT) AS n_maps FROM lo GROUP BY 1, 2")
def a14_merge_mu_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(merge.merge_synoptic(_low(spark, d), weight="mu"), 8, "chd")


@query(f"""WITH {LOW}, w AS (SELECT map_id, CASE WHEN map_id % 10 = 1 THEN 0.4 ELSE 0.1 END AS weight FROM (SELECT DISTINCT map_id FROM px))
  SELECT iy, ix, round(log10(sum(weight * data) / sum(CASE WHEN data IS NOT NULL THEN weight END)), 9)::DOUBLE AS log_data, round(sum(weight * mu) / sum(weight), 8)::DOUBLE AS mu, round(sum(weight * chd) / sum(weight), 8)::DOUBLE AS chd FROM lo JOIN w USING (map_id) GROUP BY 1, 2""")
def a15_merge_weighted(spark: SparkSession, d: str) -> DataFrame:
    w = pixels(spark, d).select("map_id").distinct().withColumn("weight", F.when(F.col("map_id") % 10 == 1, 0.4).otherwise(0.1))
    w = w.crossJoin(w.agg(F.sum("weight").alias("total"))).select("map_id", (F.col("weight") / F.col("total")).alias("weight"))  # total: one row
    return rounded(_logged(merge.merge_weighted(_low(spark, d), w)), 8, "mu", "chd")


GAUSS = "gw AS (SELECT map_id, exp(-pow((0.5 + (rn - 1) / n::DOUBLE - 1) / 0.15, 2) / 2) AS g FROM (SELECT map_id, row_number() OVER (ORDER BY map_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT map_id FROM px)))"


@query(f"""WITH {LOW}, {GAUSS}, w AS (SELECT map_id, g / max(g) OVER () AS weight FROM gw)
  SELECT iy, ix, round(sum(weight * data) / sum(weight), 4) AS data, round(sum(weight * chd) / sum(weight), 8) AS chd FROM lo JOIN w USING (map_id) GROUP BY 1, 2""")
def a16_merge_gauss(spark: SparkSession, d: str) -> DataFrame:
    px = _low(spark, d)
    w = merge.gauss_weights(px.select("map_id").distinct(), order_by=["map_id"])
    return rounded(rounded(merge.merge_weighted(px, w, values=["data", "chd"], missing="zero"), 4, "data"), 8, "chd")


@query(f"WITH {PIXELS}, {GAUSS} SELECT map_id, round(g / max(g) OVER (), 8) AS weight FROM gw")
def w6_gauss_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(merge.gauss_weights(pixels(spark, d).select("map_id").distinct(), order_by=["map_id"]), 8, "weight")


@query(f"WITH {PIXELS}, t AS (SELECT map_id % 2 AS product_id, map_id FROM (SELECT DISTINCT map_id FROM px)) SELECT DISTINCT product_id, o_orderpriority AS method FROM t JOIN px USING (map_id) JOIN orders ON o_orderkey = origin_image")
def o8_provenance(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    src = px.join(read(spark, d, "orders"), F.col("origin_image") == F.col("o_orderkey")).select("map_id", F.col("o_orderpriority").alias("method"))
    return merge.provenance(px.select((F.col("map_id") % 2).alias("product_id"), "map_id").distinct(), src)


@query(f"""WITH {PIXELS} SELECT px.map_id, iy, ix, CASE WHEN chd >= 0.5 THEN o_orderpriority END AS instrument, CASE WHEN chd >= 0.5 AND o_orderpriority IS NOT NULL THEN round(mu, 6) END AS mu FROM px LEFT JOIN orders ON o_orderkey = origin_image""")
def j13_quality_map(spark: SparkSession, d: str) -> DataFrame:
    img = read(spark, d, "orders").select(F.col("o_orderkey").alias("data_id"), F.col("o_orderpriority").alias("instrument"))
    return rounded(grid.quality_map(pixels(spark, d), img, holes_only=True), 6, "mu")


OV = """oy AS (SELECT i AS iy, k AS ny, greatest(0, least(i + 1, (k + 1) * 20.0 / 6) - greatest(i, k * 20.0 / 6)) / (20.0 / 6) AS w FROM (SELECT unnest(range(20)) AS i), (SELECT unnest(range(6)) AS k)),
  ox AS (SELECT i AS ix, k AS nx, greatest(0, least(i + 1, (k + 1) * 40.0 / 15) - greatest(i, k * 40.0 / 15)) / (40.0 / 15) AS w FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(range(15)) AS k))"""


@query(f"""WITH {LOW}, {OV}, s AS (SELECT map_id, CAST(ny AS INTEGER) AS iy, CAST(nx AS INTEGER) AS ix, sum(oy.w * ox.w * data) AS s, sum(CASE WHEN data IS NOT NULL THEN oy.w * ox.w END) AS a FROM lo JOIN oy USING (iy) JOIN ox USING (ix) WHERE oy.w > 0 AND ox.w > 0 GROUP BY 1, 2, 3)
  SELECT map_id, iy, ix, round(CASE WHEN a >= 0.4999 THEN log10(s / a) END, 9)::DOUBLE AS log_data FROM s""")
def j12_resample(spark: SparkSession, d: str) -> DataFrame:
    edges = [[float(k) for k in range(41)], [float(k) for k in range(21)], [k * 40 / 15 for k in range(16)], [k * 20 / 6 for k in range(7)]]
    return _logged(grid.resample(_low(spark, d), *edges, least_area=0.4999))


@query(f"""WITH {PIXELS}, m AS (SELECT map_id, iy, avg(data) AS m FROM px WHERE iy IN (0, 19) GROUP BY 1, 2) SELECT map_id, iy, ix, round(log10(coalesce(m, data)), 9) AS log_data FROM px LEFT JOIN m USING (map_id, iy)""")
def m15_average_poles(spark: SparkSession, d: str) -> DataFrame:
    return _logged(grid.average_poles(pixels(spark, d), 19).select("map_id", "iy", "ix", "data"))


@query(f"""WITH {LOW}, m AS (SELECT map_id, iy, sum(data * (CASE WHEN ix = 0 THEN 1.0 ELSE 3.0 END)) / sum(CASE WHEN data IS NOT NULL THEN CASE WHEN ix = 0 THEN 1.0 ELSE 3.0 END END) AS m FROM lo WHERE ix IN (0, 39) GROUP BY 1, 2)
  SELECT map_id, iy, ix, round(CASE WHEN ix IN (0, 39) THEN m ELSE data END, 4)::DOUBLE AS data FROM lo LEFT JOIN m USING (map_id, iy)""")
def m16_average_seam(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grid.average_seam(_low(spark, d), 39, 1.0, 3.0).select("map_id", "iy", "ix", "data"), 4, "data")


@query("""WITH a AS (SELECT 'x' AS axis, CAST(s_suppkey AS INTEGER) AS i, s_suppkey * 0.05 + s_suppkey * s_suppkey * 0.0001 AS coord FROM supplier), e AS (SELECT *, lead(coord) OVER (ORDER BY i) AS nx, lag(coord) OVER (ORDER BY i) AS pv FROM a)
  SELECT i, round(coord, 8)::DOUBLE AS coord, round((coord + nx) / 2, 8)::DOUBLE AS half, round(coalesce((coord + pv) / 2, coord), 8)::DOUBLE AS lower, round(coalesce((coord + nx) / 2, coord), 8)::DOUBLE AS upper,
  round(coalesce((coord + nx) / 2, coord) - coalesce((coord + pv) / 2, coord), 8)::DOUBLE AS width FROM e""")
def w4_mesh_axis(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    axis = read(spark, d, "supplier").select(F.lit("x").alias("axis"), k.cast("int").alias("i"), (k * 0.05 + k * k * 0.0001).alias("coord"))
    return rounded(grid.mesh_axis(axis).drop("axis"), 8, "coord", "half", "lower", "upper", "width")


DA = "sin((iy + 0.5) * pi() / 20) * (pi() / 20) * (2 * pi() / 40)"


def _with_area(px: DataFrame) -> DataFrame:
    theta = (F.col("iy") + 0.5) * (pi / 20)
    return px.withColumns({"theta": theta, "phi": (F.col("ix") + 0.5) * (2 * pi / 40), "sinlat": F.cos(theta), "da": geo.cell_area(theta, F.lit(pi / 20), F.lit(2 * pi / 40)), "br": (F.col("data") - 50000) / 1000})


@query(f"WITH {PIXELS} SELECT map_id, round(sum(chd * (data - 50000) / 1000 * {DA}), 5) AS flux FROM px GROUP BY 1")
def a19_map_flux(spark: SparkSession, d: str) -> DataFrame:
    px = _with_area(pixels(spark, d))
    return rounded(regions.map_flux(px.drop("br"), px), 5, "flux")


@query(f"WITH {PIXELS}, f AS (SELECT map_id, (data - 50000) / 1000 AS f FROM px), s AS (SELECT map_id, sum(CASE WHEN f > 0 THEN f ELSE 0 END) AS p, sum(CASE WHEN f < 0 THEN f ELSE 0 END) AS n FROM f GROUP BY 1) SELECT map_id, round(p, 5) AS positive, round(n, 5) AS negative, round(2 * (p + n) / (p - n), 8) AS imbalance FROM s")
def a20_flux_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(regions.flux_balance(_with_area(pixels(spark, d)), "br", ["map_id"]), 5, "positive", "negative"), 8, "imbalance")


@query(f"WITH {PIXELS}, f AS (SELECT (data - 50000) / 1000 AS f, map_id, iy, ix FROM px), s AS (SELECT sqrt(abs(sum(CASE WHEN f > 0 THEN f END) / sum(CASE WHEN f < 0 THEN f END))) AS r FROM f) SELECT map_id, iy, ix, round(CASE WHEN f > 0 THEN f / r ELSE f * r END, 6) AS flux FROM f, s")
def a20_balance_points(spark: SparkSession, d: str) -> DataFrame:
    px = _with_area(pixels(spark, d)).select("map_id", "iy", "ix", F.col("br").alias("flux"))
    return rounded(regions.balance_points(px), 6, "flux")


@query(f"""WITH {PIXELS}, f AS (SELECT map_id, (data - 50000) / 1000 AS f, {DA} AS da, degrees(asin(cos((iy + 0.5) * pi() / 20))) AS lat FROM px)
  SELECT map_id, round(sum(CASE WHEN lat >= 60 THEN f * da END) / sum(CASE WHEN lat >= 60 THEN da END), 6) AS north, round(sum(CASE WHEN lat <= -60 THEN f * da END) / sum(CASE WHEN lat <= -60 THEN da END), 6) AS south FROM f GROUP BY 1""")
def a21_polar_field(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regions.polar_field(_with_area(pixels(spark, d))), 6, "north", "south")


GROWN = f"{PIXELS}, fr AS (SELECT map_id AS frame, iy, ix, value FROM px)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select(F.col("map_id").alias("frame"), "iy", "ix", "value", F.lit(True).alias("valid"))


RING_SQL = ", ".join(f"max(CASE WHEN b.iy = a.iy + ({dy}) AND b.ix = a.ix + ({dx}) THEN 1 ELSE 0 END) AS r{k}" for k, (dy, dx) in enumerate(regions.RING))


@query(f"""WITH {GROWN}, e AS (SELECT frame, min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1 FROM fr GROUP BY 1),
  c AS (SELECT fr.* FROM fr JOIN e USING (frame) WHERE iy > y0 AND iy < y1 AND ix > x0 AND ix < x1), s AS (SELECT * FROM c WHERE value <= 10),
  r AS (SELECT a.frame, a.iy, a.ix, {RING_SQL} FROM c a JOIN s b ON a.frame = b.frame AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1 WHERE a.value > 10 AND a.value <= 25 GROUP BY 1, 2, 3),
  g AS (SELECT frame, iy, ix FROM r WHERE {" OR ".join(f"(r{k} + r{(k + 1) % 8} + r{(k + 2) % 8} = 3)" for k in range(8))})
  SELECT fr.frame, fr.iy, fr.ix, CASE WHEN s.iy IS NOT NULL OR g.iy IS NOT NULL THEN 1 ELSE 0 END AS hole FROM fr LEFT JOIN s USING (frame, iy, ix) LEFT JOIN g USING (frame, iy, ix)""")
def i1_grow_one_round(spark: SparkSession, d: str) -> DataFrame:
    return regions.grow_regions(_frames(spark, d), 10.0, 25.0, 3, 1).select("frame", "iy", "ix", "hole")


def _growth_sql(pairs: str, select: str, nc: int = 3) -> str:
    """SQL of growth until nothing changes, for each pair (draw, t1, t2): a cell keeps which of its ring are holes, and is
    looked at again when one of them turns."""
    table = ", ".join("true" if ok else "false" for ok in regions._runs(nc))
    ring = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(regions.RING))
    return f"""WITH RECURSIVE {GROWN}, pair(draw, t1, t2) AS (VALUES {pairs}), ring(k, dy, dx) AS (VALUES {ring}), e AS (SELECT frame, min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1 FROM fr GROUP BY 1),
  c AS (SELECT frame, iy, ix, draw, value <= t1 AS seed FROM fr JOIN e USING (frame), pair WHERE iy > y0 AND iy < y1 AND ix > x0 AND ix < x1 AND (value <= t1 OR value <= t2)),
  w(frame, iy, ix, draw, mask, hole) USING KEY (frame, iy, ix, draw) AS (SELECT frame, iy, ix, draw, 0, seed FROM c
    UNION SELECT n.frame, n.iy, n.ix, n.draw, n.mask | bit_or(1 << k), [{table}][(n.mask | bit_or(1 << k)) + 1] FROM w JOIN ring ON w.hole JOIN recurring.w AS n ON n.frame = w.frame AND n.draw = w.draw AND n.iy = w.iy - dy AND n.ix = w.ix - dx WHERE NOT n.hole GROUP BY n.frame, n.iy, n.ix, n.draw, n.mask HAVING (n.mask | bit_or(1 << k)) <> n.mask)
  {select}"""


_HOLES = "SELECT fr.frame, fr.iy, fr.ix, CASE WHEN w.hole THEN 1 ELSE 0 END AS hole FROM fr LEFT JOIN w USING (frame, iy, ix)"


@query(_growth_sql("(0, 10.0, 30.0)", _HOLES))
def i1_grow_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Growth tile by tile; equals i1_grow_regions."""
    return regions.grow_tiles(_frames(spark, d), 10.0, 30.0, size=8).select("frame", "iy", "ix", "hole")


@query(_growth_sql("(0, 10.0, 30.0)", _HOLES))
def i1_grow_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.grow_regions(_frames(spark, d), 10.0, 30.0).select("frame", "iy", "ix", "hole")


LABEL = f"""{GROWN}, m AS (SELECT frame, iy, ix FROM fr WHERE value <= 8), walk(frame, iy, ix, ry, rx) AS (SELECT frame, iy, ix, iy, ix FROM m
  UNION SELECT m.frame, m.iy, m.ix, w.ry, w.rx FROM walk w JOIN m ON m.frame = w.frame AND abs(m.iy - w.iy) <= 1 AND abs(m.ix - w.ix) <= 1),
  lab AS (SELECT frame, iy, ix, min((ry, rx)) AS r FROM walk GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {LABEL}, n AS (SELECT frame, r, count(*) AS n FROM lab GROUP BY 1, 2) SELECT frame, CAST(n AS BIGINT) AS n_px, count(*) AS n_regions FROM n GROUP BY 1, 2")
def i2_region_sizes(spark: SparkSession, d: str) -> DataFrame:
    got = regions.label_regions(_frames(spark, d).where("value <= 8"))
    return got.groupBy("frame", "region").agg(F.count("*").alias("n_px")).groupBy("frame", "n_px").agg(F.count("*").alias("n_regions"))


@query(f"WITH RECURSIVE {LABEL} SELECT frame, iy, ix, r[1] AS ry, r[2] AS rx FROM lab".replace("r[1]", "struct_extract(r, 1)").replace("r[2]", "struct_extract(r, 2)"))
def i2_label_regions(spark: SparkSession, d: str) -> DataFrame:
    got = regions.label_regions(_frames(spark, d).where("value <= 8"))
    return got.select("frame", "iy", "ix", F.col("region.iy").alias("ry"), F.col("region.ix").alias("rx"))


def _region_px(spark: SparkSession, d: str) -> DataFrame:
    got = regions.label_regions(_frames(spark, d).where("value <= 8"))
    return _with_area(got.withColumn("data", F.lit(0.0))).withColumn("region", F.col("region.iy") * 40 + F.col("region.ix")).drop("data", "br")


@query(f"""WITH RECURSIVE {LABEL}, p AS (SELECT frame, struct_extract(r, 1) * 40 + struct_extract(r, 2) AS region, iy, ix, {DA} AS da, (iy + 0.5) * pi() / 20 AS theta, (ix + 0.5) * 2 * pi() / 40 AS phi FROM lab)
  SELECT frame, region, round(sum(da), 8) AS area, count(*) AS n_px, min(iy) AS iy_min, max(iy) AS iy_max, min(ix) AS ix_min, max(ix) AS ix_max,
  round(acos(sum(cos(theta) * da) / sqrt(pow(sum(sin(theta) * cos(phi) * da), 2) + pow(sum(sin(theta) * sin(phi) * da), 2) + pow(sum(cos(theta) * da), 2))), 6) AS c_theta FROM p GROUP BY 1, 2""")
def a23_region_features(spark: SparkSession, d: str) -> DataFrame:
    got = regions.region_features(_region_px(spark, d)).select("frame", "region", "area", "n_px", "iy_min", "iy_max", "ix_min", "ix_max", "c_theta")
    return rounded(rounded(got, 8, "area"), 6, "c_theta")


@query(f"""WITH RECURSIVE {LABEL}, p AS (SELECT frame, struct_extract(r, 1) * 40 + struct_extract(r, 2) AS region, iy, ix, {DA} AS da FROM lab)
  SELECT p.frame, region, round(sum((data - 50000) / 1000 * da), 6) AS net_flux, round(sum(abs((data - 50000) / 1000 * da)), 6) AS abs_flux FROM p JOIN px ON px.map_id = p.frame AND px.iy = p.iy AND px.ix = p.ix GROUP BY 1, 2""")
def a18_region_flux(spark: SparkSession, d: str) -> DataFrame:
    br = _with_area(pixels(spark, d)).withColumnRenamed("map_id", "frame")
    return rounded(regions.region_flux(_region_px(spark, d), br), 6, "net_flux", "abs_flux")


SEAM = f"""{LABEL}, p AS (SELECT frame, struct_extract(r, 1) * 40 + struct_extract(r, 2) AS region, iy, ix, {DA} AS da, (iy + 0.5) * pi() / 20 AS theta, (ix + 0.5) * 2 * pi() / 40 AS phi FROM lab),
  side AS (SELECT frame, region, ix, min(iy) AS lo, max(iy) AS hi FROM p WHERE ix IN (0, 39) GROUP BY 1, 2, 3), se AS (SELECT a.frame, a.region AS u, b.region AS v FROM side a JOIN side b ON a.frame = b.frame AND a.ix = 0 AND b.ix = 39 AND a.lo <= b.hi AND b.lo <= a.hi),
  nb AS (SELECT frame, u, v FROM se UNION SELECT frame, v, u FROM se), hop(frame, node, root) AS (SELECT DISTINCT frame, u, u FROM nb UNION SELECT hop.frame, nb.v, hop.root FROM hop JOIN nb ON nb.frame = hop.frame AND nb.u = hop.node),
  root AS (SELECT frame, node, min(root) AS root FROM hop GROUP BY 1, 2), sp2 AS (SELECT p.* EXCLUDE (region), p.region AS part, coalesce(root.root, p.region) AS region FROM p LEFT JOIN root ON root.frame = p.frame AND root.node = p.region)"""


@query(f"WITH RECURSIVE {SEAM} SELECT frame, region, iy, ix, da FROM sp2")
def i3_merge_seam(spark: SparkSession, d: str) -> DataFrame:
    return regions.merge_seam(_region_px(spark, d).select("frame", "region", "iy", "ix", "da"), 39)


@query(f"""WITH RECURSIVE {SEAM}, f AS (SELECT s.*, (px.data - 50000) / 1000 AS br FROM sp2 s JOIN px ON px.map_id = s.frame AND px.iy = s.iy AND px.ix = s.ix),
  g AS (SELECT frame, region, sum(da) AS area, count(*) AS n_px, sum(br * da) AS net_flux, sum(abs(br * da)) AS abs_flux, sum(sin(theta) * cos(phi) * da) AS x, sum(sin(theta) * sin(phi) * da) AS y, sum(cos(theta) * da) AS z, count(DISTINCT part) AS n_parts FROM f GROUP BY 1, 2),
  c AS (SELECT *, acos(z / sqrt(x * x + y * y + z * z)) AS ct, atan2(y, x) AS cp FROM g), q AS (SELECT f.frame, f.region, f.da, f.theta - c.ct AS v, (f.phi - c.cp + pi() - 2 * pi() * floor((f.phi - c.cp + pi()) / (2 * pi())) - pi()) * sin(f.theta) AS u FROM f JOIN c USING (frame, region)),
  k AS (SELECT frame, region, sum(u * u * da) / sum(da) AS a, sum(u * v * da) / sum(da) AS b, sum(v * v * da) / sum(da) AS d FROM q GROUP BY 1, 2)
  SELECT frame, region, round(area, 8) AS area, n_px, round(net_flux, 6) AS net_flux, round(abs_flux, 6) AS abs_flux, round(ct, 6) AS c_theta, n_parts, round((a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b), 7) AS main_axis FROM c JOIN k USING (frame, region)""")
def i3_seam_features(spark: SparkSession, d: str) -> DataFrame:
    """Regions joined over the seam by their moments alone; main_axis is the larger eigenvalue of the covariance."""
    br = _with_area(pixels(spark, d)).select(F.col("map_id").alias("frame"), "iy", "ix", "br")
    px = _region_px(spark, d).join(br, ["frame", "iy", "ix"])
    merged = regions.merge_moments(regions.region_moments(px, 39, br="br"))
    whole = regions.merge_seam(px.select("frame", "region", "iy", "ix", "theta", "phi", "da"), 39)
    got = regions.features_of_moments(merged, pixels=whole.drop("iy", "ix")).join(merged.select("frame", "region", "n_parts"), ["frame", "region"])
    got = got.select("frame", "region", "area", "n_px", "net_flux", "abs_flux", "c_theta", "n_parts", "main_axis")
    return rounded(rounded(rounded(got, 8, "area"), 6, "net_flux", "abs_flux", "c_theta"), 7, "main_axis")


@query(f"""WITH RECURSIVE {GROWN}, cell AS (SELECT frame, CAST(y AS INTEGER) AS iy, CAST(x AS INTEGER) AS ix FROM (SELECT DISTINCT frame FROM fr WHERE value <= 40), range(20) r(y), range(40) c(x)), m AS (SELECT frame, iy, ix FROM fr WHERE value <= 40),
  bg AS (SELECT * FROM cell ANTI JOIN m USING (frame, iy, ix)), out(frame, iy, ix) AS (SELECT * FROM bg WHERE iy IN (0, 19) OR ix IN (0, 39) UNION SELECT bg.* FROM out o JOIN bg ON bg.frame = o.frame AND abs(bg.iy - o.iy) + abs(bg.ix - o.ix) = 1)
  SELECT frame, iy, ix, false AS filled FROM m UNION ALL SELECT frame, iy, ix, true FROM bg ANTI JOIN out USING (frame, iy, ix)""")
def i2_fill_holes(spark: SparkSession, d: str) -> DataFrame:
    return regions.fill_holes(_frames(spark, d).where("value <= 40"), 20, 40)


@query(f"WITH RECURSIVE {LABEL}, n AS (SELECT frame, struct_extract(r, 1) * 40 + struct_extract(r, 2) AS region, sum({DA}) AS area FROM lab GROUP BY 1, 2) SELECT frame, region, round(area, 8) AS area FROM n WHERE area >= 0.1")
def i4_prune_regions(spark: SparkSession, d: str) -> DataFrame:
    got = regions.prune_regions(_region_px(spark, d).groupBy("frame", "region").agg(F.sum("da").alias("area")), 0.1)
    return rounded(got, 8, "area")


@query(f"""WITH {GROWN}, n AS (SELECT *, max(ix) OVER (PARTITION BY frame, iy) + 1 AS n, iy * pi() / 19 AS th FROM fr), w AS (SELECT *, CASE WHEN th <= asin(2.0 / n) OR th >= pi() - asin(2.0 / n) THEN 100 ELSE CAST(floor(2.0 / sin(th)) AS INTEGER) END AS w FROM n),
  f AS (SELECT a.frame, a.iy, a.ix, max(CASE WHEN b.ix BETWEEN a.ix - (CASE WHEN a.w = 100 THEN 100 ELSE a.w // 2 END) AND a.ix + (CASE WHEN a.w = 100 THEN 100 ELSE a.w - 1 - a.w // 2 END) THEN 1 ELSE 0 END) AS d FROM w a LEFT JOIN fr b ON a.frame = b.frame AND a.iy = b.iy AND b.value >= 48 GROUP BY 1, 2, 3)
  SELECT frame, iy, ix, max(d) OVER (PARTITION BY frame, ix ORDER BY iy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dilated FROM f""")
def w5_dilate(spark: SparkSession, d: str) -> DataFrame:
    return regions.dilate(_frames(spark, d), 2.0, 3, 20, seed_threshold=48.0).select("frame", "iy", "ix", "dilated")


@query(f"""WITH {GROWN}, m AS (SELECT frame, iy, ix, value <= 25 AS k FROM fr), e AS (SELECT *, lead(k) OVER (PARTITION BY frame, iy ORDER BY ix) AS r, lead(k) OVER (PARTITION BY frame, ix ORDER BY iy) AS b FROM m)
  SELECT frame, ix + 1 AS x0, iy AS y0, ix + 1 AS x1, iy + 1 AS y1 FROM e WHERE r <> k UNION ALL SELECT frame, ix, iy + 1, ix + 1, iy + 1 FROM e WHERE b <> k""")
def w11_mask_outline(spark: SparkSession, d: str) -> DataFrame:
    return regions.mask_outline(_frames(spark, d).withColumn("mask", F.col("value") <= 25))


@query()
def a17_detect_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return regions.detect_ensemble(_frames(spark, d), regions.random_thresholds(spark, 3, 10.0, 20.0, 2.0, 1))


@query(f"""WITH {GROWN}, e AS (SELECT frame, min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1 FROM fr GROUP BY 1), c AS (SELECT fr.* FROM fr JOIN e USING (frame) WHERE iy > y0 AND iy < y1 AND ix > x0 AND ix < x1)
  SELECT frame, draw, CAST(sum(CASE WHEN value <= draw * 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_holes FROM c, (SELECT unnest([1, 2]) AS draw) GROUP BY 1, 2""")
def a30_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([(1, 10.0, 10.0), (2, 20.0, 20.0)], "draw int, t1 double, t2 double")
    return regions.threshold_sweep(_frames(spark, d), pairs).select("frame", "draw", "n_holes")


@query(_growth_sql(", ".join(f"({k}, {t1}, {t2})" for k, (t1, t2) in enumerate((a, b) for a in (5.0, 10.0, 15.0) for b in (20.0, 30.0, 40.0))), """, n AS (SELECT frame, draw, count(*) FILTER (hole) AS n FROM w GROUP BY 1, 2)
  SELECT f.frame, p.draw, p.t1::DOUBLE AS t1, p.t2::DOUBLE AS t2, CAST(coalesce(n.n, 0) AS BIGINT) AS n_holes FROM (SELECT DISTINCT frame FROM fr) f CROSS JOIN pair p LEFT JOIN n ON n.frame = f.frame AND n.draw = p.draw"""))
def a30_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Growth until nothing changes for each pair of a grid; a30_threshold_sweep, which has SQL, has seeds only."""
    pairs = [(k, t1, t2) for k, (t1, t2) in enumerate((a, b) for a in (5.0, 10.0, 15.0) for b in (20.0, 30.0, 40.0))]
    return regions.threshold_sweep(_frames(spark, d), spark.createDataFrame(pairs, "draw int, t1 double, t2 double"))


@query(f"WITH {GROWN} SELECT frame, CAST(sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS area_a, CAST(sum(CASE WHEN value <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS area_b FROM fr GROUP BY 1")
def a35_compare_detections(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d)
    a, b = (f.withColumn("hole", (F.col("value") <= t).cast("int")) for t in (10, 12))
    return regions.compare_detections(a, b)


@query()
def i10_cluster_regions(spark: SparkSession, d: str) -> DataFrame:
    got = regions.cluster_regions(_frames(spark, d), k=6, least=5)
    return got.select("frame", "kind", F.col("region.iy").alias("ry"), F.col("region.ix").alias("rx"), "n_px")


def _sphere(spark: SparkSession, d: str) -> DataFrame:
    """The first three components of each embedding as a direction."""
    x, y, z = (F.col("embedding")[k].cast("double") for k in range(3))
    r, theta, phi = geo.to_spherical(x, y, z)
    return read(spark, d, "embeddings").select("vec_id", "label", r.alias("r"), theta.alias("theta"), phi.alias("phi"))


SPHERE = """sp AS (SELECT vec_id, label, sqrt(x * x + y * y + z * z) AS r, acos(z / sqrt(x * x + y * y + z * z)) AS theta, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS phi
  FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings))"""


@query(f"WITH {SPHERE} SELECT vec_id, round(r, 8) AS r, round(theta, 8) AS theta, round(phi, 8) AS phi FROM sp")
def m1_to_spherical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sphere(spark, d).drop("label"), 8, "r", "theta", "phi")


@query(f"WITH {SPHERE} SELECT vec_id, round(2 * asin(sqrt(least(1, pow(sin((theta - 1) / 2), 2) + sin(theta) * sin(1) * pow(sin((phi - 2) / 2), 2)))), 6) AS arc FROM sp")
def m2_haversine(spark: SparkSession, d: str) -> DataFrame:
    s = _sphere(spark, d)
    return rounded(s.select("vec_id", geo.haversine(F.col("theta"), F.col("phi"), F.lit(1.0), F.lit(2.0)).alias("arc")), 6, "arc")


@query(f"""WITH {SPHERE}, k AS (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY pow(sin(a.theta) * cos(a.phi) - sin(b.theta) * cos(b.phi), 2) + pow(sin(a.theta) * sin(a.phi) - sin(b.theta) * sin(b.phi), 2) + pow(cos(a.theta) - cos(b.theta), 2), b.vec_id) AS n,
  sqrt(pow(sin(a.theta) * cos(a.phi) - sin(b.theta) * cos(b.phi), 2) + pow(sin(a.theta) * sin(a.phi) - sin(b.theta) * sin(b.phi), 2) + pow(cos(a.theta) - cos(b.theta), 2)) AS dist FROM sp a JOIN sp b ON a.vec_id <> b.vec_id)
  SELECT vec_id, round(2 * asin(least(1, dist / 2)), 6) AS distance FROM k WHERE n = 3""")
def j16_kth_neighbor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grid.kth_neighbor(_sphere(spark, d), 3, 0.2, "vec_id"), 6, "distance")


@query(f"WITH {PIXELS} SELECT map_id, iy, ix, round(pow(10, 1.1 * log10(data) - 0.2), 3) AS scaled, mu > 0.95 AND data > 30000 AS usable FROM px")
def m7_scale_log(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    return px.select("map_id", "iy", "ix", F.round(phot.scale_log(F.col("data"), F.lit(1.1), F.lit(-0.2)), 3).alias("scaled"), (phot.usable(F.col("mu") - 0.95, F.col("data"), 30000.0)).alias("usable"))


@query(f"""WITH {PIXELS}, m AS (SELECT map_id, iy, ix, mu - 1 AS a, mu * mu - 1 AS b, mu * mu * mu - 1 AS c FROM px) SELECT map_id, iy, ix, round(1 + 0.4 * a - 0.2 * b + 0.1 * c, 8) AS beta, round(0.5 * a + 0.3 * b - 0.6 * c, 8) AS y FROM m""")
def m6_limb_cubic(spark: SparkSession, d: str) -> DataFrame:
    beta, y = phot.limb_factors("cubic", [F.lit(v) for v in (0.4, -0.2, 0.1, 0.5, 0.3, -0.6)], F.col("mu"))
    return rounded(pixels(spark, d).select("map_id", "iy", "ix", beta.alias("beta"), y.alias("y")), 8, "beta", "y")


@query(f"""WITH {PIXELS}, m AS (SELECT map_id, iy, ix, greatest(mu - 0.9, 0.1) AS u FROM px), f AS (SELECT *, -0.05 * (u - 1) - 0.3 * log10(u) AS f1, -0.01 * (u - 1) + 0.4 * log10(u) AS f0 FROM m)
  SELECT map_id, iy, ix, round(-1 / (f1 - 1), 8) AS beta, round((-6 * f1 - f0) * (-1 / (f1 - 1)), 8) AS y FROM f""")
def m6_limb_theoretic(spark: SparkSession, d: str) -> DataFrame:
    """At the disk's rim, where mu counts as 0.1 at least."""
    beta, y = phot.limb_factors("theoretic", [F.lit(v) for v in (-0.05, -0.3, -0.01, 0.4, -1.0, 6.0)], F.col("mu") - 0.9)
    return rounded(pixels(spark, d).select("map_id", "iy", "ix", beta.alias("beta"), y.alias("y")), 8, "beta", "y")


@query(f"""WITH {PIXELS} SELECT map_id, iy, ix, round(1 - 0.3 + 0.3 * pow(mu, 2), 8) AS beta, round(0.1 * log10(mu), 8) AS y FROM px""")
def m6_limb_factors(spark: SparkSession, d: str) -> DataFrame:
    beta, y = phot.limb_factors("power_log", [F.lit(0.3), F.lit(2.0), F.lit(0.1)], F.col("mu"))
    return rounded(pixels(spark, d).select("map_id", "iy", "ix", beta.alias("beta"), y.alias("y")), 8, "beta", "y")


@query(f"""WITH {PIXELS}, cell AS (SELECT DISTINCT iy, ix, (ix + 0.5) * 2 * pi() / 40 AS phi, (iy + 0.5) / 10 - 1 AS s FROM px), v AS (SELECT DISTINCT map_id AS data_id, radians(map_id * 40.0) AS lon, radians(5.0) AS b FROM px),
  g AS (SELECT data_id, iy, ix, sqrt(1 - s * s) * sin(phi - lon) AS x, s * cos(b) - sqrt(1 - s * s) * cos(phi - lon) * sin(b) AS y, s * sin(b) + sqrt(1 - s * s) * cos(phi - lon) * cos(b) AS z FROM cell, v),
  f AS (SELECT data_id, iy, ix, z AS mu, (x + 1) * 39 / 2 AS fx, (y + 1) * 19 / 2 AS fy FROM g WHERE z > 0), q AS (SELECT *, CAST(floor(fx) AS INTEGER) AS jx, CAST(floor(fy) AS INTEGER) AS jy FROM f),
  a AS (SELECT data_id, iy, ix, mu, jy + b AS py, jx + a AS px_, (CASE WHEN a = 1 THEN fx - jx ELSE 1 - (fx - jx) END) * (CASE WHEN b = 1 THEN fy - jy ELSE 1 - (fy - jy) END) AS w FROM q, range(2) t(a), range(2) u(b)),
  r AS (SELECT a.data_id, a.iy, a.ix, a.mu, sum(w * p.data) AS s, bool_and(p.data IS NOT NULL) AS ok FROM a LEFT JOIN px p ON p.map_id = a.data_id AND p.iy = a.py AND p.ix = a.px_ WHERE w > 0 GROUP BY 1, 2, 3, 4)
  SELECT data_id, iy, ix, round(CASE WHEN ok THEN s END, 3) AS data, round(mu, 6) AS mu, CASE WHEN ok THEN data_id END AS origin_image FROM r""")
def j11_project_image(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d).select(F.col("map_id").alias("data_id"), "iy", "ix", "data")
    cells = pixels(spark, d).select("iy", "ix").distinct().select("iy", "ix", ((F.col("ix") + 0.5) * (2 * pi / 40)).alias("phi"), ((F.col("iy") + 0.5) / 10 - 1).alias("sinlat"))
    seen = px.select("data_id").distinct().select("data_id", (F.col("data_id") * 40.0).alias("cr_lon"), F.lit(5.0).alias("cr_lat"), F.lit(0.0).alias("crota2"))
    return rounded(rounded(grid.project_image(px, cells, seen, -1.0, 2 / 39, -1.0, 2 / 19), 3, "data"), 6, "mu")


@query(f"""WITH {PIXELS}, g AS (SELECT map_id, CAST(y AS INTEGER) AS iy, CAST(x AS INTEGER) AS ix, (y + 0.5) * pi() / 20 AS t, (x + 0.5) * 2 * pi() / 40 AS p FROM (SELECT DISTINCT map_id FROM px), range(20) a(y), range(40) b(x)),
  s AS (SELECT *, acos(greatest(-1, least(1, sin(t) * sin(p)))) AS t2, atan2(-cos(t), sin(t) * cos(p)) AS p2 FROM g),
  k AS (SELECT map_id, iy, ix, CAST(least(floor(round(t2 / (pi() / 20), 9)), 19) AS INTEGER) AS ky, CAST(floor(round((CASE WHEN p2 < 0 THEN p2 + 2 * pi() ELSE p2 END) / (2 * pi() / 40), 9)) AS INTEGER) % 40 AS kx FROM s)
  SELECT k.map_id, k.iy, k.ix, px.data FROM k LEFT JOIN px ON px.map_id = k.map_id AND px.iy = ky AND px.ix = kx""")
def j14_reproject_polar(spark: SparkSession, d: str) -> DataFrame:
    return grid.reproject_polar(pixels(spark, d), 20, 40)


def _spread_sql(sigma: str) -> str:
    """SQL of points spread over the mesh with a sigma; reach is four of it."""
    return f"""WITH {PIXELS}, {SPHERE}, mesh AS (SELECT iy, ix, (iy + 0.5) * pi() / 20 AS theta, (ix + 0.5) * 2 * pi() / 40 AS phi, {DA} AS da FROM (SELECT DISTINCT iy, ix FROM px)),
  x AS (SELECT vec_id, theta, phi, label - 4.5 AS flux, {sigma} AS sigma FROM sp), g AS (SELECT vec_id, flux, iy, ix, da, sigma, 2 * asin(sqrt(least(1, pow(sin((m.theta - x.theta) / 2), 2) + sin(x.theta) * sin(m.theta) * pow(sin((m.phi - x.phi) / 2), 2)))) AS arc FROM x, mesh m),
  e AS (SELECT *, exp(-pow(arc / sigma, 2) / 2) AS w FROM g WHERE arc <= 4 * sigma), t AS (SELECT vec_id, sum(w * da) AS total FROM e GROUP BY 1) SELECT iy, ix, round(sum(flux * w / total), 6) AS br FROM e JOIN t USING (vec_id) GROUP BY 1, 2"""


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pts = _sphere(spark, d).select(F.col("vec_id").alias("point_id"), "theta", "phi", (F.col("label") - 4.5).alias("flux"))
    return pts, _with_area(pixels(spark, d)).select("iy", "ix", "theta", "phi", "da").distinct()


def _axes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = lambda n, f: grid.mesh_axis(spark.range(n).select(F.lit("a").alias("axis"), F.col("id").alias("i"), f(F.col("id")).alias("coord")))
    return rows(20, lambda i: (i + 0.5) * (pi / 20)), rows(40, lambda i: (i + 0.5) * (2 * pi / 40))


@query(_spread_sql("0.2::DOUBLE"))
def j15_project_points(spark: SparkSession, d: str) -> DataFrame:
    pts, mesh = _points(spark, d)
    return rounded(grid.project_points(pts, mesh, 0.2), 6, "br")


@query(_spread_sql(f"((0.5 - 0.3) * pow(cos(theta), 2) + 0.3) / {grid.FWHM}::DOUBLE"))
def j15_project_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Widths that change smoothly with latitude."""
    pts, mesh = _points(spark, d)
    return rounded(grid.project_points(grid.point_widths(pts, "smooth", pole=0.5, equator=0.3), mesh), 6, "br")


_CELL = """(CASE WHEN {c} <= 0.5 * {w} THEN 0.5 + greatest(0, {c} / {w} - 0.5) / 2 WHEN {c} >= ({n} - 0.5) * {w} THEN 0.5
  WHEN {c} < 1.5 * {w} THEN 0.5 + 0.5 * ({c} / {w} - 0.5) WHEN {c} > ({n} - 1.5) * {w} THEN 0.5 + 0.5 * ({n} - 0.5 - {c} / {w}) ELSE 1 END * {w})"""
_DT, _DP = _CELL.format(c="theta", w="(pi() / 20)", n=20), _CELL.format(c="phi", w="(2 * pi() / 40)", n=40)


@query(_spread_sql(f"2 * sqrt(pow({_DT}, 2) + sin(theta) * pow({_DP}, 2)) / {grid.FWHM}::DOUBLE"))
def j15_project_local(spark: SparkSession, d: str) -> DataFrame:
    """Widths from the mesh cell at each point; end cells are half cells."""
    pts, mesh = _points(spark, d)
    return rounded(grid.project_points(grid.point_widths(pts, "local", *_axes(spark)), mesh), 6, "br")


@query(_spread_sql(f"""greatest(2 * sqrt(pow({_DT}, 2) + sin(theta) * pow({_DP}, 2)), 2 * (SELECT 2 * asin(least(1, dd / 2)) FROM (SELECT sqrt(pow(sin(sp.theta) * cos(sp.phi) - sin(o.theta) * cos(o.phi), 2) + pow(sin(sp.theta) * sin(sp.phi) - sin(o.theta) * sin(o.phi), 2) + pow(cos(sp.theta) - cos(o.theta), 2)) AS dd
  FROM sp o WHERE o.vec_id <> sp.vec_id ORDER BY 1 LIMIT 1 OFFSET 9))) / {grid.FWHM}::DOUBLE"""))
def j15_project_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Widths from the mesh and the tenth nearest point."""
    pts, mesh = _points(spark, d)
    return rounded(grid.project_points(grid.point_widths(pts, "adaptive", *_axes(spark)), mesh), 6, "br")


def _least_reached(edges: str) -> str:
    """SQL of components: every node keeps the least node that reached it, and hands it on whenever it falls."""
    return f"""WITH RECURSIVE e AS ({edges}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  w(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, min(w.component) FROM w JOIN b ON b.u = w.node JOIN recurring.w AS now ON now.node = b.v WHERE w.component < now.component GROUP BY b.v)
  SELECT node, component FROM w"""


@query(_least_reached("SELECT o_custkey AS u, o_orderkey % 1000 + 1000000 AS v FROM orders"))
def i7_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers and the last three digits of their orders' numbers."""
    return components(read(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000 + 1000000).alias("dst")))


@query(_least_reached("SELECT l_orderkey AS u, l_suppkey * 1000003 + l_partkey + 1000000000 AS v FROM lineitem"))
def i7_components_all(spark: SparkSession, d: str) -> DataFrame:
    """Orders tied by what they hold of the same supplier: many components, and a row of lineitem is an edge."""
    return components(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") * 1000003 + F.col("l_partkey") + 1000000000).alias("dst")))

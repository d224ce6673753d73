"""Tracking and graph queries: regions of lineitem maps, embeddings on a sphere, and users' chains of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import regions, tracks
from ..plans.graph import cheapest_paths
from ..plans.tables import table
from .base import PIXELS, pixels, query, read, rounded
from .grids import DA, LABEL, SPHERE, _region_px, _sphere


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """events as nodes, each tied to its user's next event."""
    e = read(spark, d, "events").withColumn("v", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    nodes = e.select(F.col("event_id").cast("string").alias("node"), F.dayofmonth("ts").alias("frame"), F.col("event_type").alias("id"), F.col("value").alias("area"), (F.col("value") - 250).alias("net_flux"), F.abs(F.col("value") - 250).alias("abs_flux"), "user_id")
    edges = e.where("v IS NOT NULL").select(F.col("event_id").cast("string").alias("u"), F.col("v").cast("string").alias("v"), (F.col("value") / 500).alias("weight"))
    return nodes, edges


GRAPH = """ev AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
  nod AS (SELECT CAST(event_id AS VARCHAR) AS node, CAST(day(ts) AS INTEGER) AS frame, event_type AS id, value AS area, value - 250 AS net_flux, abs(value - 250) AS abs_flux, user_id FROM ev),
  edg AS (SELECT CAST(event_id AS VARCHAR) AS u, CAST(nx AS VARCHAR) AS v, value / 500 AS weight FROM ev WHERE nx IS NOT NULL)"""


@query(f"""WITH RECURSIVE {LABEL}, p AS (SELECT frame, struct_extract(r, 1) * 40 + struct_extract(r, 2) AS region, iy, ix, {DA} AS da FROM lab), z AS (SELECT frame, region, sum(da) AS a FROM p GROUP BY 1, 2),
  s AS (SELECT p.frame AS fa, p.region AS ra, q.frame AS fb, q.region AS rb, sum(p.da) AS s FROM p JOIN p q ON q.iy = p.iy AND q.ix = p.ix AND q.frame = p.frame + 1 GROUP BY 1, 2, 3, 4)
  SELECT fa AS frame_a, ra AS region_a, fb AS frame_b, rb AS region_b, round(s, 8) AS shared, round(s / x.a, 8) AS share_a, round(s / y.a, 8) AS share_b FROM s JOIN z x ON x.frame = fa AND x.region = ra JOIN z y ON y.frame = fb AND y.region = rb""")
def j17_region_overlap(spark: SparkSession, d: str) -> DataFrame:
    px = _region_px(spark, d)
    a = px.select(F.col("frame").alias("frame_a"), F.col("region").alias("region_a"), "iy", "ix", "da")
    b = px.select(F.col("frame").alias("frame_b"), F.col("region").alias("region_b"), "iy", "ix", "da")
    got = tracks.region_overlap(a.withColumn("later", F.col("frame_a") + 1), b.withColumn("later", F.col("frame_b")), by=["later"])
    return rounded(got, 8, "shared", "share_a", "share_b")


@query(f"""WITH {SPHERE}, p AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, CAST(b.label AS INTEGER) AS label, sqrt(pow(sin(a.theta) * cos(a.phi) - sin(b.theta) * cos(b.phi), 2) + pow(sin(a.theta) * sin(a.phi) - sin(b.theta) * sin(b.phi), 2) + pow(cos(a.theta) - cos(b.theta), 2)) AS d
  FROM sp a JOIN sp b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(d, 12), train_id) AS k FROM p), w AS (SELECT test_id, label, sum(1 / d) AS w FROM n WHERE k <= 10 GROUP BY 1, 2)
  SELECT test_id, label, round(w / sum(w) OVER (PARTITION BY test_id), 6) AS prob FROM w""")
def j18_knn_label_probs(spark: SparkSession, d: str) -> DataFrame:
    s = _sphere(spark, d)
    test = s.where("vec_id % 5 = 0").select(F.col("vec_id").alias("test_id"), "theta", "phi")
    train = s.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("train_id"), "theta", "phi", "label")
    return rounded(tracks.knn_label_probs(test, train), 6, "prob")


@query("""WITH o AS (SELECT l_orderkey AS region, l_returnflag AS label, CAST(l_linenumber AS DOUBLE) AS hours, l_discount * 10 AS sn, l_tax * 10 AS so FROM lineitem),
  s AS (SELECT region, label, sum((sn + so) / 2 / (1 + hours)) / sum(1 / (1 + hours)) AS score FROM o GROUP BY 1, 2), b AS (SELECT region, arg_min(label, (-round(score, 12), label)) AS label, max(score) AS score FROM s GROUP BY 1) SELECT region, CASE WHEN score > 0.5003 THEN label END AS label, round(score, 6) AS score FROM b""")
def j20_match_regions(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("region"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").cast("double").alias("hours"), (F.col("l_discount") * 10).alias("share_new"), (F.col("l_tax") * 10).alias("share_old"))
    got = tracks.match_regions(o, 0.5003)
    return got.select("region", "label", F.round("score", 6).alias("score"))


@query(f"""WITH {PIXELS}, m AS (SELECT map_id, lead(map_id) OVER (ORDER BY map_id) AS nx FROM (SELECT DISTINCT map_id FROM px)),
  u AS (SELECT map_id AS target_id, map_id, CASE WHEN nx - map_id <= 3 THEN 1 - 0.25::DOUBLE / (nx - map_id) ELSE 1 END AS w FROM m UNION ALL SELECT map_id, nx, 0.25::DOUBLE / (nx - map_id) FROM m WHERE nx - map_id <= 3)
  SELECT target_id, iy, ix, round(sum(w * data), 4) AS br FROM u JOIN px USING (map_id) GROUP BY 1, 2, 3""")
def j19_interp_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps four hours a number apart; a target an hour after each."""
    px = pixels(spark, d)
    hour = lambda c: F.timestamp_micros((c * 14_400_000_000).cast("long")).cast("timestamp_ntz")
    maps = px.select("map_id").distinct().select("map_id", hour(F.col("map_id")).alias("ts"))
    targets = maps.select(F.col("map_id").alias("target_id"), hour(F.col("map_id") + 0.25).alias("ts"))
    return rounded(tracks.interp_maps(targets, maps, px.select("map_id", "iy", "ix", F.col("data").alias("br"))), 4, "br")


def _located(px: DataFrame) -> DataFrame:
    """The regions with time and centroid."""
    return regions.region_centroids(px).select(F.floor(F.col("frame") / 10).alias("run"), "frame", "region", F.timestamp_micros(F.col("frame").cast("long") * 7_200_000_000).cast("timestamp_ntz").alias("ts"), F.col("c_theta").alias("theta"), F.col("c_phi").alias("phi"))


def _tracked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = _region_px(spark, d).withColumn("run", F.floor(F.col("frame") / 10))  # a series of maps is a run
    reg = table(_located(px), "located")
    return tracks.track(reg, px.select("run", "frame", "region", "iy", "ix", "da"), 0.1, k=10, near_thr=0.1), px


@query(f"""WITH RECURSIVE {LABEL}, p AS (SELECT frame, struct_extract(r, 1) * 40 + struct_extract(r, 2) AS region, {DA} AS da, (iy + 0.5) * pi() / 20 AS theta, (ix + 0.5) * 2 * pi() / 40 AS phi FROM lab),
  c AS (SELECT frame // 10 AS run, frame, region, sum(sin(theta) * cos(phi) * da) AS x, sum(sin(theta) * sin(phi) * da) AS y, sum(cos(theta) * da) AS z FROM p GROUP BY 1, 2, 3), u AS (SELECT run, frame, region, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM c)),
  pr AS (SELECT a.run, a.frame, a.region, b.frame AS old_frame, b.region AS old_region, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 9) AS d FROM u a JOIN u b ON a.run = b.run AND b.frame < a.frame AND a.frame - b.frame <= 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY frame, region ORDER BY d) AS n FROM pr) SELECT run, frame, region, round(d, 3) AS d FROM k WHERE n <= 5""")
def j18_nearest_before(spark: SparkSession, d: str) -> DataFrame:
    """Distances to the five nearest regions of the three frames before."""
    px = _region_px(spark, d)
    return rounded(tracks.nearest_before(_located(px), 5, 6.0), 3, "d").select("run", "frame", "region", "d")


@query()
def i5_track(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d)[0]


@query()
def i6_connect(spark: SparkSession, d: str) -> DataFrame:
    t, px = _tracked(spark, d)
    return tracks.connect(t, px.select("frame", "region", "iy", "ix", "da"), 0.05, by=["run"])


@query(f"""WITH {GRAPH} SELECT min(node) AS component, round(sum(area) / count(DISTINCT frame), 5) AS mean_area, count(*) AS n_nodes FROM nod GROUP BY user_id""")
def a24_rank_tracks(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return rounded(tracks.rank_tracks(nodes, edges), 5, "mean_area")


@query(f"""WITH {GRAPH} SELECT min(node) AS component, round(sum(area) / count(DISTINCT frame), 5) AS mean_area, count(*) AS n_nodes FROM nod GROUP BY user_id ORDER BY sum(area) / count(DISTINCT frame) DESC, 1 LIMIT 10""")
def o4_top_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The ten tracks of the largest mean area."""
    nodes, edges = _graph(spark, d)
    return rounded(tracks.rank_tracks(nodes, edges, 10), 5, "mean_area")


@query(f"WITH {GRAPH} SELECT id, frame, round(sum(area), 4) AS area, round(sum(net_flux), 4) AS net_flux, round(sum(abs_flux), 4) AS abs_flux, count(*) AS n_nodes FROM nod GROUP BY 1, 2")
def a25_track_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracks.track_series(_graph(spark, d)[0]), 4, "area", "net_flux", "abs_flux")


@query(f"""WITH {GRAPH} SELECT a.id = b.id AS same_id, count(*) AS n, round(avg(weight), 8) AS mean, round(stddev_pop(weight), 8) AS std, round(quantile_cont(weight, 0.5), 8) AS median, min(weight) AS least, max(weight) AS greatest
  FROM edg JOIN nod a ON a.node = u JOIN nod b ON b.node = v GROUP BY 1""")
def a26_edge_stats(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return rounded(tracks.edge_stats(edges, nodes), 8, "mean", "std", "median")


@query(f"""WITH {GRAPH} SELECT CAST(b AS INTEGER) AS bin, count(u) AS n FROM (SELECT unnest(range(25)) AS b) LEFT JOIN edg ON weight BETWEEN 0 AND 1 AND least(floor(weight * 25), 24) = b GROUP BY 1""")
def a26_weight_hist(spark: SparkSession, d: str) -> DataFrame:
    return tracks.weight_hist(_graph(spark, d)[1])


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each user the first and the last event, which lie furthest apart."""
    first = nodes.join(edges.select(F.col("v").alias("node")), "node", "left_anti").select(F.col("user_id").alias("pair"), F.col("node").alias("src"))
    last = nodes.join(edges.select(F.col("u").alias("node")), "node", "left_anti").select(F.col("user_id").alias("pair"), F.col("node").alias("dst"))
    return first.join(last, "pair")


@query(f"""WITH {GRAPH}, w AS (SELECT e.event_id, e.user_id, row_number() OVER o - 1 AS step, lag(event_type) OVER o AS before, event_type, lag(value) OVER o AS weight FROM events e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id AS pair, CAST(step AS INTEGER) AS step, CAST(event_id AS VARCHAR) AS node, round(sum(CASE WHEN before IS NULL OR before = event_type THEN 0 ELSE round((1 - weight / 500) * 1000000) END) OVER (PARTITION BY user_id ORDER BY step) / 1000000, 6) AS cost FROM w""")
def i8_cheapest_path(spark: SparkSession, d: str) -> DataFrame:
    """The paths from each user's first event to the last."""
    nodes, edges = _graph(spark, d)
    return rounded(cheapest_paths(edges, nodes, _ends(nodes, edges)), 6, "cost")


@query(f"""WITH {GRAPH}, p AS (SELECT node FROM nod WHERE area >= 300), n AS (SELECT v AS node FROM edg WHERE weight >= 0.6 AND u IN (SELECT node FROM p) UNION SELECT u FROM edg WHERE weight >= 0.6 AND v IN (SELECT node FROM p) UNION SELECT node FROM p),
  wide AS (SELECT node FROM nod WHERE id IN (SELECT id FROM nod WHERE node IN (SELECT node FROM n)))
  SELECT node AS u, NULL::VARCHAR AS v, NULL::DOUBLE AS weight FROM wide UNION ALL SELECT u, v, weight FROM edg WHERE u IN (SELECT node FROM wide) AND v IN (SELECT node FROM wide)""")
def i9_expand_path(spark: SparkSession, d: str) -> DataFrame:
    """Nodes (v and weight null) and edges around the largest nodes."""
    nodes, edges = _graph(spark, d)
    return _nodes_and_edges(*tracks.expand_path(nodes.where("area >= 300"), edges, nodes, 0.6))


@query(f"""WITH {GRAPH}, p AS (SELECT node FROM nod WHERE user_id = (SELECT min(user_id) FROM nod)), n AS (SELECT v AS node FROM edg WHERE weight >= 0.9 AND u IN (SELECT node FROM p) UNION SELECT u FROM edg WHERE weight >= 0.9 AND v IN (SELECT node FROM p) UNION SELECT node FROM p),
  wide AS (SELECT node FROM nod WHERE id IN (SELECT id FROM nod WHERE node IN (SELECT node FROM n)))
  SELECT node AS u, NULL::VARCHAR AS v, NULL::DOUBLE AS weight FROM wide UNION ALL SELECT u, v, weight FROM edg WHERE u IN (SELECT node FROM wide) AND v IN (SELECT node FROM wide)""")
def i9_expand_cheapest_path(spark: SparkSession, d: str) -> DataFrame:
    """Nodes (v and weight null) and edges around the path of i8 for the first user."""
    nodes, edges = _graph(spark, d)
    first = nodes.agg(F.min("user_id").alias("pair"))
    path = cheapest_paths(edges, nodes, _ends(nodes, edges).join(F.broadcast(first), "pair"))
    return _nodes_and_edges(*tracks.expand_path(path, edges, nodes, 0.9))


def _nodes_and_edges(wide: DataFrame, inside: DataFrame) -> DataFrame:
    return wide.select(F.col("node").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("double").alias("weight")).unionByName(inside.select("u", "v", "weight"))

"""Range-ordered work, quantiles, holes, moments, tiles, stores, widths: against plain versions."""

import math
import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import grid, regions
from sunloom.plans import asof
from sunloom.plans.order import exact_quantiles, row_numbers
from sunloom.sources import store

START = datetime(2001, 1, 1)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_as_of_without_groups_in_any_ranges(spark, parts):
    rng = random.Random(parts)
    left = [(k, START + timedelta(hours=rng.choice([5, 5, 5, rng.randrange(500)]))) for k in range(300)] + [(900, None)]
    right = [(START + timedelta(hours=rng.randrange(100, 400)), k) for k in range(60)] + [(None, 7)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        a, b = spark.createDataFrame(left, "k long, t timestamp_ntz"), spark.createDataFrame(right, "t timestamp_ntz, v long")
        df = asof.asof_bracket(a, b, "t", "t", ["v"])
        assert "SinglePartition" not in df._jdf.queryExecution().toString() or parts == 1
        got = {r.k: (r.before and tuple(r.before), r.after and tuple(r.after)) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    known = sorted((t, v) for t, v in right if t is not None)
    for k, t in left:
        earlier, later = [x for x in known if t and x[0] <= t], [x for x in known if t and x[0] >= t]
        last = min((x for x in earlier if x[0] == earlier[-1][0]), default=None) if earlier else None
        assert got[k] == (last, later[0] if later else None)
    assert asof.asof_bracket(a.where("k < 0"), b, "t", "t", ["v"]).count() == 0
    assert [r.before for r in asof.asof_bracket(a.where("k = 900"), b.where("v < 0"), "t", "t", ["v"]).collect()] == [None]


def test_numbers_by_ranges(spark):
    rows = [(f"n{(7919 * k) % 1000:04d}", k) for k in range(1000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "name string, k int").repartition(5)
    got = {r.name: r.number for r in row_numbers(df, ["name"], parts=13).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted((n for n, _ in rows), key=lambda n: n or ""))}


@pytest.mark.parametrize("bins", [2, 8, 1024])
def test_exact_quantiles(spark, bins):
    rng = random.Random(bins)
    groups = {"ties": [1.0] * 50 + [2.0] * 50, "one": [3.5], "two": [1.0, 2.0], "wide": [rng.lognormvariate(0, 8) for _ in range(999)], "near": [1e15 + k for k in range(40)], None: [rng.gauss(0, 1) for _ in range(128)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("one", float("nan")), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.15, 0.5, 0.85, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, "v", qs, ["g"], bins).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, qs), rtol=1e-12)
    assert np.allclose(exact_quantiles(df, "v", [0.5]).first().quantiles, np.quantile([v for vs in groups.values() for v in vs], 0.5))
    assert exact_quantiles(df.where("g = 'gone'"), "v", [0.5]).count() == 0


def flood(cells, rows, cols):
    out, todo = set(), deque((y, x) for y in range(rows) for x in range(cols) if (y in (0, rows - 1) or x in (0, cols - 1)) and (y, x) not in cells)
    while todo:
        y, x = todo.popleft()
        if (y, x) in out:
            continue
        out.add((y, x))
        todo += [(y + a, x + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= y + a < rows and 0 <= x + b < cols and (y + a, x + b) not in cells]
    return {(y, x) for y in range(rows) for x in range(cols)} - out - cells


def ring(y0, x0, y1, x1):
    return {(y, x) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1) if y in (y0, y1) or x in (x0, x1)}


def test_holes_in_holes_are_filled(spark):
    rng = random.Random(2)
    nested = ring(1, 1, 11, 17) | ring(3, 3, 9, 9) | {(6, 6)} | ring(4, 12, 7, 15)
    open_ = nested - {(1, 5)}
    diagonal = {(2, 3), (3, 2), (3, 4), (4, 3)}  # 8-connected, so it holds (3, 3) in
    noise = {(y, x) for y in range(13) for x in range(19) if rng.random() < 0.55}
    frames = [nested, open_, diagonal, noise, {(0, 0)}]
    df = spark.createDataFrame([(f, y, x) for f, cells in enumerate(frames) for y, x in cells], "frame int, iy int, ix int")
    got = {(r.frame, r.iy, r.ix) for r in regions.fill_holes(df, 13, 19).where("filled").collect()}
    assert got == {(f, *c) for f, cells in enumerate(frames) for c in flood(cells, 13, 19)}
    assert regions.fill_holes(df.where("frame < 0"), 13, 19).count() == 0
    labels = regions.label_regions(df.where("frame = 0"), fill=(13, 19))
    assert labels.count() == len(nested) and labels.select("region").distinct().count() == 1
    assert regions.label_regions(df.where("frame = 0")).select("region").distinct().count() == 4


def test_moments_give_the_features_of_merged_pixels(spark):
    rng, rows = random.Random(3), []
    blobs = {1: (4, 0, 3), 2: (5, 22, 2), 3: (7, 10, 4), 4: (2, 23, 1), 5: (10, 0, 1)}
    for frame in (0, 1):
        for r, (y, x, n) in blobs.items():
            for i in range(n):
                for j in range(n):
                    if rng.random() < 0.85 or (i, j) == (0, 0):
                        a, b = min(11, y + i), (x + j) if x + j < 24 else None
                        if b is not None:
                            theta, phi = (a + 0.5) * math.pi / 12, (b + 0.5) * math.pi / 12
                            rows.append((frame, r, a, b, theta, phi, math.sin(theta) * (math.pi / 12) ** 2, rng.gauss(0, 5)))
    rows += [(2, 6, 0, x, 0.5 * math.pi / 12, (x + 0.5) * math.pi / 12, 0.01, 1.0) for x in range(24)]  # all around the pole
    df = spark.createDataFrame(rows, "frame int, region int, iy int, ix int, theta double, phi double, da double, br double")
    merged = regions.merge_moments(regions.region_moments(df, 23, br="br"))
    whole = regions.merge_seam(df, 23)
    got = {(r.frame, r.region): r for r in regions.features_of_moments(merged, pixels=whole.drop("iy", "ix", "br")).collect()}
    want = {(r.frame, r.region): r for r in regions.region_features(whole).collect()}
    flux = {(r.frame, r.region): r for r in regions.region_flux(whole.drop("br"), df.select("frame", "iy", "ix", "br")).collect()}
    assert got.keys() == want.keys() and len(got) < len({(r[0], r[1]) for r in rows})
    for k, w in want.items():
        g = got[k]
        assert np.allclose([g.area, g.n_px, g.c_theta, math.cos(g.c_phi), g.main_axis], [w.area, w.n_px, w.c_theta, math.cos(w.c_phi), w.main_axis], atol=1e-9), k
        assert np.allclose([g.net_flux, g.abs_flux], [flux[k].net_flux, flux[k].abs_flux])
        if w.main_axis > 1e-9 and w.significance < 1e6 and w.significance > 1.001:
            assert math.isclose(math.cos(math.radians(2 * g.tilt)), math.cos(math.radians(2 * w.tilt)), abs_tol=1e-6)


@pytest.mark.parametrize("size", [5, 100])
def test_growth_by_tiles_equals_growth_by_rounds(spark, size):
    rng, rows = random.Random(9), []
    for frame in range(3):
        for y in range(22):
            for x in range(31):
                v = 0.2 if rng.random() < 0.03 or (9 <= y <= 11 and 9 <= x <= 11) else rng.choice([0.7, 0.7, 0.7, 0.7, 2.0]) if frame else 0.7
                rows.append((frame, y - 4, x, v if rng.random() < 0.98 else None, rng.random() < 0.98))
    df = spark.createDataFrame(rows, "frame int, iy int, ix int, value double, valid boolean")
    got = {(r.frame, r.iy, r.ix): r.hole for r in regions.grow_tiles(df, 0.5, 1.0, 3, size).collect()}
    assert got == {(r.frame, r.iy, r.ix): r.hole for r in regions.grow_regions(df, 0.5, 1.0, 3).collect()}
    assert sum(v or 0 for v in got.values()) > 500


def test_a_failed_write_leaves_the_store(spark, tmp_path):
    path = str(tmp_path / "maps")
    with pytest.raises(ValueError):
        store.read_maps(spark, path)
    px = lambda v, *ids: spark.createDataFrame([(i, 0, x, float(v + x)) for i in ids for x in range(3)], "map_id int, iy int, ix int, data double")
    info = lambda *ids: spark.createDataFrame([(i, datetime(2020, i, 3)) for i in ids], "map_id int, date_mean timestamp_ntz")
    assert store.write_maps(px(0, 1, 2, 9), info(1, 2), path) == 1
    assert store.write_maps(px(10, 2, 3), info(2, 3), path) == 2
    broken = px(5, 1).withColumn("data", F.when(F.col("ix") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        store.write_maps(broken, info(1), path)
    values = lambda df: {(r.map_id, r.ix): r.data for r in df.collect()}
    now = {(i, x): float(v + x) for i, v in ((1, 0), (2, 10), (3, 10)) for x in range(3)}
    got, maps = store.read_maps(spark, path)
    assert values(got) == now and sorted(r.map_id for r in maps.collect()) == [1, 2, 3]
    assert values(store.read_maps(spark, path, upto=1)[0]) == {(i, x): float(x) for i in (1, 2) for x in range(3)}
    part, _ = store.read_maps(spark, path, datetime(2020, 2, 1).date(), datetime(2020, 2, 28).date())
    assert values(part) == {k: v for k, v in now.items() if k[0] == 2}


@pytest.mark.parametrize("style", ["fixed", "smooth", "local", "adaptive"])
def test_points_of_all_widths_keep_their_flux(spark, style):
    rng = random.Random(4)
    pts = [(k, math.acos(rng.uniform(-1, 1)), rng.uniform(0, 2 * math.pi), rng.choice([0.0, rng.gauss(0, 3)])) for k in range(25)] + [(90, 0.01, 1.0, 2.0), (91, 1.5, 2 * math.pi - 0.001, -3.0)]
    cells = [(i, j, (i + 0.5) * math.pi / 30, (j + 0.5) * math.pi / 30, math.sin((i + 0.5) * math.pi / 30) * (math.pi / 30) ** 2) for i in range(30) for j in range(60)]
    mesh = spark.createDataFrame(cells, "iy int, ix int, theta double, phi double, da double")
    axis = lambda n: grid.mesh_axis(spark.range(n).select(F.lit("a").alias("axis"), F.col("id").alias("i"), ((F.col("id") + 0.5) * (math.pi / 30)).alias("coord")))
    df = grid.point_widths(spark.createDataFrame(pts, "point_id int, theta double, phi double, flux double"), style, axis(30), axis(60), neighbors=3, fixed=0.2, pole=0.4, equator=0.2)
    wide = {r.point_id: r.sigma for r in df.collect()}
    assert len(wide) == len(pts) and (style == "fixed" or len(set(wide.values())) > 5)
    br = np.zeros((30, 60))
    kept = 0.0
    for k, t, p, flux in pts:
        w = {}
        for i, j, t2, p2, da in cells:
            a = math.sin((t2 - t) / 2) ** 2 + math.sin(t) * math.sin(t2) * math.sin((p2 - p) / 2) ** 2
            arc = 2 * math.asin(math.sqrt(min(1, a)))
            if arc <= 4 * wide[k]:
                w[i, j] = (math.exp(-((arc / wide[k]) ** 2) / 2), da)
        total = sum(g * da for g, da in w.values())
        kept += flux if w else 0.0
        for (i, j), (g, _) in w.items():
            br[i, j] += flux * g / total
    got = np.zeros((30, 60))
    for r in grid.project_points(df, mesh).collect():
        got[r.iy, r.ix] = r.br
    assert np.allclose(got, br, atol=1e-9)
    assert math.isclose(sum(got[i, j] * da for i, j, _, _, da in cells), kept, abs_tol=1e-9)


def test_neighbors_of_crowded_points(spark):
    """The search widens until it has found enough, however small it began."""
    pts = [(k, 1.0 + 1e-7 * k, 2.0) for k in range(6)] + [(9, 2.9, 5.0)]
    got = {r.point_id: r.distance for r in grid.kth_neighbor(spark.createDataFrame(pts, "point_id int, theta double, phi double"), 3, 1e-6).collect()}
    assert all(v is not None for v in got.values()) and got[9] > 1 and got[0] < 1e-6


def test_neighbors_meet_in_pairs_as_many_as_places(spark, tmp_path, monkeypatch):
    """Copies, and clumps in which a fixed cube would hold all points: the cubes follow the places."""
    rng = np.random.default_rng(4)
    base = [(1.0 + 0.01 * float(a), 2.0 + 0.01 * float(b)) for a, b in rng.random((1500, 2))] + [(float(np.arccos(rng.uniform(-1, 1))), float(rng.uniform(0, 6.28))) for _ in range(100)]
    pts = [(i, *p) for i, p in enumerate(base)] + [(2000 + i, *base[i % 10]) for i in range(3000)] + [(9000, None, 1.0)]
    seen = spark.sparkContext.accumulator(0)
    chord = grid.chord

    @F.udf("double")
    def counted(d):
        seen.add(1)
        return d

    monkeypatch.setattr(grid, "chord", lambda a, b: counted(chord(a, b)))
    got = {r.point_id: r.distance for r in grid.kth_neighbor(spark.createDataFrame(pts, "point_id int, theta double, phi double"), 3, 0.25).collect()}
    xyz = np.array([[np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)] for _, t, p in pts[:-1]])
    for at in range(0, len(xyz), 500):
        d = np.sort(np.sqrt(((xyz[at : at + 500, None] - xyz[None]) ** 2).sum(axis=2)), axis=1)[:, 3]
        for (i, _, _), v in zip(pts[at : at + 500], d, strict=False):
            assert abs(got[i] - 2 * math.asin(v / 2)) < 1e-9
    assert got[9000] is None and 0 < seen.value < 400_000

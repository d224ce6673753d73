"""Tracks with candidates by distance, against a plain loop over frames."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunloom.operators import tracks

START = datetime(2001, 1, 1)


def scene(seed, frames=14):
    """Blobs that drift, jump, split and vanish on a 12 x 24 grid."""
    rng, regions, pixels = random.Random(seed), [], []
    blobs = [[rng.randrange(2, 9), rng.randrange(2, 20)] for _ in range(4)]
    for f in range(frames):
        seen = set()
        for k, b in enumerate(blobs):
            if rng.random() < 0.15:
                continue
            b[0] = min(9, max(1, b[0] + rng.choice([-1, 0, 0, 1, 3])))
            b[1] = (b[1] + rng.choice([0, 1, 1, 2, 4])) % 23
            cells = {(b[0] + i, b[1] + j) for i in (0, 1) for j in (0, 1)} - seen
            if not cells:
                continue
            seen |= cells
            theta = sum((i + 0.5) * math.pi / 12 for i, _ in cells) / len(cells)
            phi = sum((j + 0.5) * math.pi / 12 for _, j in cells) / len(cells)
            regions.append((seed, f, START + timedelta(hours=6 * f), k, theta, phi))
            pixels += [(seed, f, k, i, j, 1.0 + 0.1 * i) for i, j in cells]
    return regions, pixels


def plain(regions, pixels, thr, window, weight, k, near_thr, keep):
    px = {}
    for _, f, r, i, j, da in pixels:
        px.setdefault((f, r), {})[i, j] = da
    point = lambda t, p: (math.sin(t) * math.cos(p), math.sin(t) * math.sin(p), math.cos(t))
    at = {(f, r): (ts, point(t, p)) for _, f, ts, r, t, p in regions}
    ids, last, out = {}, 0, {}
    for f in sorted({f for f, _ in at}):
        new, used = {}, {}
        for g in sorted(x for x in at if x[0] == f):
            ts, here = at[g]
            old = [x for x in ids if 0 < (ts - at[x][0]).total_seconds() <= window * 3600]
            age = {x: (ts - at[x][0]).total_seconds() / 3600 for x in old}
            w = {x: age[x] if weight == "age" else 1 / (1 + age[x]) for x in old}
            cands, chance = {ids[x] for x in old}, {}
            if k is not None:
                near = sorted((round(math.dist(here, at[x][1]), 12), x) for x in old)[:k]
                zero = any(d == 0 for d, _ in near)
                for d, x in near:
                    chance[ids[x]] = chance.get(ids[x], 0) + ((d == 0) if zero else 1 / d)
                total = sum(chance.values())
                chance = {i: v / total for i, v in chance.items()}
                cands = {i for i, v in chance.items() if v > near_thr}
            best = (0.0, 0)
            for i in cands:
                mine = [x for x in old if ids[x] == i]
                total = sum(w[x] for x in mine)
                if total:
                    s = 0.0
                    for x in mine:
                        both = sum(px[g][c] for c in px[g] if c in px[x])
                        s += w[x] * (both / sum(px[g].values()) + both / sum(px[x].values())) / 2
                    best = max(best, (round(s / total, 12), -i))
            likely = max(((round(v, 12), -i) for i, v in chance.items()), default=(0.0, 0))
            if best[0] > thr:
                new[g] = -best[1]
            elif keep is not None and likely[0] >= keep:
                new[g] = -likely[1]
            else:
                last += 1
                new[g] = last
        for g, i in new.items():
            out[g] = (i, used.get(i, 0))
            used[i] = used.get(i, 0) + 1
        ids |= new
    return out


OPTIONS = [(0.1, 30, "proximity", None, 0.0, None), (0.1, 30, "age", 3, 0.2, None), (0.05, 60, "proximity", 4, 0.1, 0.6), (0.0, 20, "proximity", 100, 0.0, 0.3)]


@pytest.mark.parametrize("thr,window,weight,k,near_thr,keep", OPTIONS)
def test_tracks_by_a_plain_loop(spark, thr, window, weight, k, near_thr, keep):
    scenes = [scene(s) for s in (1, 2, 3)]
    reg = spark.createDataFrame([r for a, _ in scenes for r in a], "run long, frame long, ts timestamp_ntz, region long, theta double, phi double")
    px = spark.createDataFrame([p for _, b in scenes for p in b], "run long, frame long, region long, iy int, ix int, da double")
    got = {(r.run, r.frame, r.region): (r.id, r["count"]) for r in tracks.track(reg, px, thr, window, weight, k, near_thr, keep).collect()}
    want = {(s + 1, *g): v for s, (a, b) in enumerate(scenes) for g, v in plain(a, b, thr, window, weight, k, near_thr, keep).items()}
    assert got == want


def test_a_region_that_left_its_pixels_keeps_its_id(spark):
    reg = [(1, f, START + timedelta(hours=f), 0, 1.0, 1.0 + 0.3 * f) for f in range(3)] + [(1, f, START + timedelta(hours=f), 1, 2.2, 4.0) for f in range(3)]
    px = [(1, f, 0, 5, 5 + 2 * f, 1.0) for f in range(3)] + [(1, f, 1, 9, 20, 1.0) for f in range(3)]
    reg = spark.createDataFrame(reg, "run long, frame long, ts timestamp_ntz, region long, theta double, phi double")
    px = spark.createDataFrame(px, "run long, frame long, region long, iy int, ix int, da double")
    ids = lambda **o: {(r.frame, r.region): r.id for r in tracks.track(reg, px, 0.1, 10, k=5, **o).collect()}
    kept, lost = ids(keep=0.5), ids()
    assert [kept[f, 0] for f in range(3)] == [1, 1, 1] and [kept[f, 1] for f in range(3)] == [2, 2, 2]
    assert [lost[f, 0] for f in range(3)] == [1, 3, 4] and lost[2, 1] == 2


def test_nearest_before_by_all_pairs(spark):
    rng, rows = random.Random(6), []
    for f in range(30):
        for r in range(rng.choice([0, 1, 5])):
            rows.append((f // 15, f, r, START + timedelta(hours=3 * f), math.acos(rng.uniform(-1, 1)), rng.uniform(0, 2 * math.pi)))
    rows.append((1, 29, 9, START + timedelta(hours=87), rows[-1][4], rows[-1][5]))
    df = spark.createDataFrame(rows, "run long, frame long, region long, ts timestamp_ntz, theta double, phi double")
    point = lambda t, p: (math.sin(t) * math.cos(p), math.sin(t) * math.sin(p), math.cos(t))
    want = set()
    for run, f, r, ts, t, p in rows:
        old = [(round(math.dist(point(t, p), point(t2, p2)), 9), f2, r2) for run2, f2, r2, ts2, t2, p2 in rows if run2 == run and timedelta(0) < ts - ts2 <= timedelta(hours=12)]
        want |= {(run, f, r, f2, r2) for _, f2, r2 in sorted(old)[:4]}
    got = {(x.run, x.frame, x.region, x.old_frame, x.old_region) for x in tracks.nearest_before(df, 4, 12).collect()}
    assert got == want
    assert tracks.nearest_before(df.where(F.lit(False)), 4, 12).count() == 0


@pytest.mark.parametrize("cell", [None, 0.05, 0.4])
def test_nearest_before_whole_and_by_cubes(spark, cell):
    """Windows over the ends of stretches, equal places in several frames, a region without a place, frames without news."""
    rng, rows = random.Random(8), []
    spots = [(math.acos(rng.uniform(-1, 1)), rng.uniform(0, 2 * math.pi)) for _ in range(6)]
    for run in range(2):
        for f in range(60):
            for r in range(rng.choice([0, 2, 7])):
                t, p = rng.choice(spots) if rng.random() < 0.3 else (math.acos(rng.uniform(-1, 1)), rng.uniform(0, 2 * math.pi))
                rows.append((run, 100 * run + f, r, START + timedelta(hours=run + 3 * f), t, p))
    rows.append((2, 300, 1, START, 1.0, 1.0))  # a run of one frame
    df = spark.createDataFrame([*rows, (0, 20, 9, START + timedelta(hours=60), None, 1.0)], "run long, frame long, region int, ts timestamp_ntz, theta double, phi double")
    point = lambda t, p: (math.sin(t) * math.cos(p), math.sin(t) * math.sin(p), math.cos(t))
    want = {}
    for run, f, r, ts, t, p in rows:
        old = [(round(math.dist(point(t, p), point(t2, p2)), 12), f2, r2) for run2, f2, r2, ts2, t2, p2 in rows if run2 == run and timedelta(0) < ts - ts2 <= timedelta(hours=12)]
        want |= {(run, f, r, f2, r2): d for d, f2, r2 in sorted(old)[:4]}
    found = tracks.nearest_before(df, 4, 12, cell)
    assert found.schema["region"].dataType == df.schema["region"].dataType == found.schema["old_region"].dataType
    got = {(x.run, x.frame, x.region, x.old_frame, x.old_region): x.d for x in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 2e-12 for g in want)
    reg = df.where("theta IS NOT NULL")
    px = reg.select("run", "frame", "region", F.col("region").alias("iy"), F.lit(0).alias("ix"), F.lit(1.0).alias("da"))
    assert tracks.track(reg, px, 0.1, 12, k=4).where("run = 2").collect() == [(2, 300, 1, 1, 0)]


def test_nearest_rows_in_parts(monkeypatch):
    """A few distances at a time give the lists of all at once."""
    rng = np.random.default_rng(2)
    xyz = rng.normal(size=(90, 3)).round(1)
    df = pd.DataFrame({"run": 1, "frame": np.arange(90) // 5, "region": np.arange(90) % 5, "__t": np.arange(90) // 5 * 10, "__ask": True}).assign(**dict(zip(("__x", "__y", "__z"), xyz.T, strict=True)))
    whole = tracks._nearest_rows(3, 40, 2.0)(df)
    monkeypatch.setattr(tracks, "_AT_ONCE", 50)
    parts = tracks._nearest_rows(3, 40, 2.0)(df.sample(frac=1, random_state=1))
    assert len(whole) == 85 and whole.map(np.ravel).map(list).equals(parts.map(np.ravel).map(list))


def moved(spark, df):
    """Records that the stages of a run of df, and of the tables that come before it, write for shuffles."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    bus.waitUntilEmpty()
    known = {(s.stageId(), s.attemptId()) for s in map(stages().apply, range(stages().size()))}
    df().write.format("noop").mode("overwrite").save()
    bus.waitUntilEmpty()
    now = stages()
    return sum(s.shuffleWriteRecords() for s in map(now.apply, range(now.size())) if (s.stageId(), s.attemptId()) not in known)


def test_edges_and_neighbours_move_no_pairs(spark):
    """What is shuffled follows the regions and pixels, not the pairs of regions of two frames or the cubes around each."""
    n = 300
    rows = [(1, f, r, START + timedelta(hours=2 * f), math.acos(1 - 2 * (r + 0.5) / n), 2.4 * r + 0.01 * f) for f in range(4) for r in range(n)]
    reg = spark.createDataFrame(rows, "run long, frame long, region int, ts timestamp_ntz, theta double, phi double").localCheckpoint()
    px = reg.select("run", "frame", "region", (F.col("region") / 20).cast("int").alias("iy"), (F.col("region") % 20).alias("ix"), F.lit(1.0).alias("da")).localCheckpoint()
    tracked = reg.select("run", "frame", F.col("region").cast("long").alias("region"), (F.col("region") + 1).cast("long").alias("id"), F.lit(0).alias("count")).localCheckpoint()
    assert moved(spark, lambda: tracks.connect(tracked, px, 0.05, ["run"])) < 15 * len(rows)
    assert moved(spark, lambda: tracks.nearest_before(reg, 10, 168.0)) < 5 * len(rows)
    assert tracks.connect(tracked, px, 0.05, ["run"]).count() == 3 * n


def test_fold_over_pages_is_the_whole_fold():
    """The state of a page carries all that the next needs."""
    regions, _ = scene(5)
    df = pd.DataFrame([(r, f, t, k) for r, f, t, k, _, _ in regions], columns=["run", "frame", "ts", "region"])
    df["ts"] = pd.to_datetime(df["ts"])
    over = pd.DataFrame([(f, k, f - 1, k, 0.4, 0.6) for _, f, _, k, _, _ in regions if f], columns=["frame", "region", "old_frame", "old_region", "share_new", "share_old"])
    near = pd.DataFrame([(f, k, f - b, k, 0.1 * b) for _, f, _, k, _, _ in regions for b in (1, 2) if f >= b], columns=["frame", "region", "old_frame", "old_region", "d"])
    whole = tracks.fold_tracks(df, over, 0.1, 24, "proximity", None, near, 0.1, 0.5)
    state, parts = {}, []
    for a, b in ((0, 4), (4, 9), (9, 99)):
        cut = lambda x, a=a, b=b: x[(x["frame"] >= a) & (x["frame"] < b)]
        parts.append(tracks.fold_tracks(cut(df), cut(over), 0.1, 24, "proximity", state, cut(near), 0.1, 0.5))
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole)


def test_edges_by_a_plain_loop(spark):
    """Edges go to the frame before, and to the latest earlier regions of the id; over no run."""
    scenes = [scene(s) for s in (4, 7)]
    reg = spark.createDataFrame([(r[0], r[1] + 100 * r[0], *r[2:]) for a, _ in scenes for r in a], "run long, frame long, ts timestamp_ntz, region long, theta double, phi double")
    px = spark.createDataFrame([(p[0], p[1] + 100 * p[0], *p[2:]) for _, b in scenes for p in b], "run long, frame long, region long, iy int, ix int, da double")
    tracked = tracks.track(reg, px, 0.1, 30).collect()
    got = {(r.u, r.v): r.weight for r in tracks.connect(spark.createDataFrame(tracked), px.drop("run"), 0.05, ["run"]).collect()}
    cells, name = {}, {}
    for p in px.collect():
        cells.setdefault((p.frame, p.region), {})[p.iy, p.ix] = p.da
    for t in tracked:
        name[t.frame, t.region] = f"{t.frame}_{t.id}_{t['count']}"
    want = {}
    for t in tracked:
        mine = [o for o in tracked if o.run == t.run and o.frame < t.frame]
        if not mine:
            continue
        before = max(o.frame for o in mine)
        same = max((o.frame for o in mine if o.id == t.id), default=None)
        for o in mine:
            if o.frame == before or (o.id == t.id and o.frame == same):
                a, b = cells[t.frame, t.region], cells[o.frame, o.region]
                both = sum(v for c, v in a.items() if c in b)
                mean = (both / sum(a.values()) + both / sum(b.values())) / 2
                if mean > 0.05:
                    want[name[o.frame, o.region], name[t.frame, t.region]] = round(mean, 3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-3 for k in want) and len(want) > 10


def test_clusters_of_intensity(spark):
    """Three far intensities: the darkest two are holes, the brightest active; small regions are dropped."""
    from sunloom.operators import regions

    level = lambda y, x: 1e8 if y < 6 and x < 7 else 1e1 if y > 13 and x < 8 else 1e2 if y > 13 and x > 30 else 1e5 if (y, x) != (9, 20) else 1e8
    df = spark.createDataFrame([(0, y, x, float(level(y, x))) for y in range(20) for x in range(40)] + [(0, 30, 30, None)], "frame int, iy int, ix int, value double")
    got = {(r.kind, r.region.iy, r.region.ix): r.n_px for r in regions.cluster_regions(df, k=4, weight=0.001, least=5).collect()}
    assert got == {("hole", 14, 0): 48, ("hole", 14, 31): 54, ("active", 0, 0): 42}


def test_fits_of_every_kth_image(spark):
    from sunloom.operators import hist

    edges, rows, images = [0.1 * k for k in range(51)], [], []
    for k in range(12):
        at = 2.0 + (0.3 if k % 2 else 0.0)
        images.append((k, "a", k))
        rows += [(k, i, int(1000 * math.exp(-(((0.1 * i + 0.05 - at) / 0.3) ** 2) / 2))) for i in range(50)]
    img, bins = spark.createDataFrame(images, "data_id int, instrument string, t int"), spark.createDataFrame(rows, "data_id int, i_int int, n long")
    ref = bins.where("data_id = 0").crossJoin(bins.where("data_id = 0").agg(F.sum("n").alias("t"))).select("i_int", (F.col("n") / F.col("t")).alias("share"))
    got = {r.cadence: r for r in hist.cadence_fits(img, bins, ref, edges, [1, 2], ["instrument"], ["t"]).collect()}
    assert abs(got[2].slope - 1) < 1e-3 and abs(got[2].shift) < 3e-3 and got[2].sse < 1e-8 < got[1].sse

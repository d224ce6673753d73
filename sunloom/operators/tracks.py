"""Following regions through time: overlaps, matching, tracks and the graph of them."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import chord, to_cartesian
from ..functions.times import HOUR, micros
from ..plans.asof import asof_bracket
from ..plans.graph import components
from ..plans.order import exact_quantiles
from ..plans.tables import table


def region_overlap(px_a: DataFrame, px_b: DataFrame, key_a: Sequence[str] = ("frame_a", "region_a"), key_b: Sequence[str] = ("frame_b", "region_b"), by: Sequence[str] = ()) -> DataFrame:
    """Shared area of each pair of regions that share pixels, and its share of either.

    px_a, px_b: keys, iy, ix, da, and the columns of `by`, which both must share (such as the number of the later
    frame). Pairs come from an equi-join on those and the pixel, so regions apart never meet.
    """
    size_a, size_b = px_a.groupBy(*key_a).agg(F.sum("da").alias("__a")), px_b.groupBy(*key_b).agg(F.sum("da").alias("__b"))
    shared = px_a.select(*key_a, *by, "iy", "ix", "da").join(px_b.select(*key_b, *by, "iy", "ix"), [*by, "iy", "ix"]).groupBy(*key_a, *key_b).agg(F.sum("da").alias("shared"))
    out = shared.join(size_a, list(key_a)).join(size_b, list(key_b))
    return out.select(*key_a, *key_b, "shared", (F.col("shared") / F.col("__a")).alias("share_a"), (F.col("shared") / F.col("__b")).alias("share_b"))


def nearest_points(test: DataFrame, train: DataFrame, k: int, by: Sequence[str] = (), cell: float | None = None) -> DataFrame:
    """(test_id, train_id, label, d): the k nearest training points of each test point (all, if they are fewer), by chord
    rounded to 12 digits, then train_id. Points without a place are left out.

    Points meet through cubes of the unit ball, within the columns of `by`. The first cubes are as wide as k / 4 points of
    the largest group would need if spread evenly (cell: another width). What has k points within a cube's width is
    done; the rest, less in every round, asks again with twice the width, and last among all of its group.
    """
    if cell is None:
        most = train.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
        cell = min(2.0, max(1e-4, (k / most) ** 0.5))
    x, y, z = to_cartesian(F.col("theta"), F.col("phi"))
    place = {"__x": x, "__y": y, "__z": z}
    todo = table(test.select(*by, "test_id", "theta", "phi").withColumns(place).where("__x IS NOT NULL AND __y IS NOT NULL AND __z IS NOT NULL"), "knn_test")
    have = table(train.select(*by, "train_id", "label", F.col("theta").alias("__u"), F.col("phi").alias("__v"), x.alias("__x"), y.alias("__y"), z.alias("__z")), "knn_train")
    d = F.round(chord((F.col("theta"), F.col("phi")), (F.col("__u"), F.col("__v"))), 12)
    done = None
    while True:
        cube = {f"__c{c}": F.floor(F.col(f"__{c}") / cell).cast("int") for c in "xyz"}
        around = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", (a, b, c), strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
        ask = todo.withColumns(cube).withColumn("__o", F.explode(around))
        ask = ask.select(*by, "test_id", "theta", "phi", *[(F.col(f"__c{c}") + F.col(f"__o.{o}")).alias(f"__c{c}") for c, o in zip("xyz", "abc", strict=True)])
        met = ask.join(have.withColumns(cube).drop("__x", "__y", "__z"), [*by, "__cx", "__cy", "__cz"]).withColumn("d", d)
        met = met if cell >= 2 else met.where(F.col("d") <= cell * (1 - 1e-9) - 1e-12)
        near = met.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "test_id").orderBy("d", "train_id"))).where(F.col("__n") <= k)
        if cell < 2:
            near = near.withColumn("__k", F.count("*").over(Window.partitionBy(*by, "test_id"))).where(F.col("__k") == k)
        got = table(near.select(*by, "test_id", "train_id", "label", "d"), "knn_found")
        done = got if done is None else done.unionByName(got)
        if cell >= 2:
            break
        todo = table(todo.join(got.select(*by, "test_id").distinct(), [*by, "test_id"], "left_anti"), "knn_todo")
        if todo.isEmpty():
            break
        cell = 2.0 if cell > 0.5 else 2 * cell
    return done.select("test_id", "train_id", "label", "d")


def knn_label_probs(test: DataFrame, train: DataFrame, k: int = 10, thr: float = 0.0, by: Sequence[str] = (), cell: float | None = None) -> DataFrame:
    """(test_id, label, prob): shares of inverse chord distance of the labels of the k nearest training points.

    test: test_id, theta, phi; train: train_id, theta, phi, label; by: columns that both must share, such as a time
    window. Points at distance 0 take all the weight. Labels of at most thr are dropped. cell: see nearest_points.
    """
    near = nearest_points(test, train, k, by, cell)
    exact = F.min("d").over(Window.partitionBy("test_id")) == 0
    w = F.when(F.col("__exact"), F.when(F.col("d") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.col("d"))
    got = near.withColumn("__exact", exact).withColumn("w", w).groupBy("test_id", "label").agg(F.sum("w").alias("w"))
    got = got.withColumn("prob", F.col("w") / F.sum("w").over(Window.partitionBy("test_id")))
    return got.where(F.col("prob") > thr).select("test_id", "label", "prob")


def interp_maps(targets: DataFrame, maps: DataFrame, px: DataFrame, half_hours: float = 12.0, time: str = "ts") -> DataFrame:
    """Map pixels at target times, linear between the maps before and after within half_hours; one side alone counts
    as it is (J19). targets: target_id, ts; maps: map_id, ts; px: map_id, iy, ix, br."""
    both = asof_bracket(targets, maps, time, time, ["map_id"])
    t, t0, t1 = (micros(F.col(c)) for c in (time, "before.time", "after.time"))
    near0, near1 = F.coalesce(t - t0 <= half_hours * HOUR, F.lit(False)), F.coalesce(t1 - t <= half_hours * HOUR, F.lit(False))
    w1 = F.when(near0 & near1, F.when(t1 > t0, (t - t0) / (t1 - t0)).otherwise(0.0)).when(near1, 1.0).otherwise(0.0)
    w0 = F.when(near0 & near1, 1 - w1).when(near0, 1.0).otherwise(0.0)
    parts = F.array(F.struct(F.col("before.map_id").alias("map_id"), w0.alias("w")), F.struct(F.col("after.map_id").alias("map_id"), w1.alias("w")))
    use = both.select("target_id", F.explode(parts).alias("s")).select("target_id", "s.map_id", "s.w").where("w > 0")
    return use.join(px, "map_id").groupBy("target_id", "iy", "ix").agg(F.sum(F.col("w") * F.col("br")).alias("br"))


def match_regions(overlaps: DataFrame, thr: float = 0.0, weight: str = "proximity") -> DataFrame:
    """The label of most mean overlap for each new region, or null if none is over thr.

    overlaps: region, label, hours (age of the old frame), share_new, share_old. weight: "age" counts an overlap by its
    age, "proximity" by 1 / (1 + age). The least label wins ties.
    """
    w = F.col("hours") if weight == "age" else 1 / (1 + F.col("hours"))
    mean = (F.col("share_new") + F.col("share_old")) / 2
    score = overlaps.groupBy("region", "label").agg((F.sum(w * mean) / F.when(F.sum(w) > 0, F.sum(w))).alias("score"))
    best = score.groupBy("region").agg(F.min_by(F.struct("label", "score"), F.struct(-F.round("score", 12), F.col("label"))).alias("b"))
    over = F.coalesce(F.col("b.score") > thr, F.lit(False))
    return best.select("region", F.when(over, F.col("b.label")).alias("label"), F.col("b.score").alias("score"))


TRACKED = "run long, frame long, region long, id long, count int"


def fold_tracks(regions: pd.DataFrame, overlaps: pd.DataFrame, thr: float, window_hours: float, weight: str, state: dict | None = None, near: pd.DataFrame | None = None, near_thr: float = 0.0, keep: float | None = None) -> pd.DataFrame:
    """Ids of the regions of one run, frame by frame; state carries labels, times and the last id over calls.

    A candidate's score is the mean overlap with all regions of the window that have its label, weighted by age or
    proximity; one that does not overlap counts as 0. near: the nearest earlier regions, whose distances give candidates
    their probabilities (J18); without it, labels that overlap are candidates.
    """
    state = {} if state is None else state
    labels: dict = state.setdefault("labels", {})
    recent: deque = state.setdefault("recent", deque())
    state.setdefault("last", 0)
    links, close, held = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in overlaps.itertuples(index=False):
        links[r.frame, r.region].append((r.old_frame, r.old_region, (r.share_new + r.share_old) / 2))
    for r in near.itertuples(index=False) if near is not None else ():
        close[r.frame, r.region].append((r.d, r.old_frame, r.old_region))
    for f, t, rs in recent:
        for r in rs:
            held[labels[f, r]].append(t)
    out = []
    for (frame, ts), rows in regions.sort_values(["frame", "region"]).groupby(["frame", "ts"], sort=True):
        while recent and (ts - recent[0][1]).total_seconds() > window_hours * 3600:
            old = recent.popleft()
            for region in old[2]:
                held[labels.pop((old[0], region))].remove(old[1])
        times = {f: t for f, t, _ in recent}
        weigh = {t: (a if weight == "age" else 1 / (1 + a)) for t in times.values() for a in [(ts - t).total_seconds() / 3600]}
        named, used = {}, defaultdict(int)
        for region in rows["region"].tolist():
            over = defaultdict(float)
            for f, r, share in links[frame, region]:
                if (f, r) in labels and f in times:
                    over[labels[f, r]] += weigh[times[f]] * share
            chance: dict = {}
            if near is not None:
                seen = [(d, labels[f, r]) for d, f, r in close[frame, region] if (f, r) in labels]
                exact = any(d == 0 for d, _ in seen)
                for d, i in seen:
                    chance[i] = chance.get(i, 0.0) + (float(d == 0) if exact else 1 / d)
                total = sum(chance.values())
                chance = {i: w / total for i, w in chance.items()}
            score = {}
            for i in [i for i, p in chance.items() if p > near_thr] if near is not None else over:
                w = sum(weigh[t] for t in held[i])
                if w > 0:
                    score[i] = over.get(i, 0.0) / w
            best = max(((round(s, 12), -i) for i, s in score.items()), default=(0.0, 0))
            likely = max(((round(p, 12), -i) for i, p in chance.items()), default=(0.0, 0))
            if best[0] > thr:
                named[region] = -best[1]
            elif keep is not None and likely[0] >= keep:
                named[region] = -likely[1]
            else:
                state["last"] += 1
                named[region] = state["last"]
        run = int(rows["run"].iloc[0])
        for region, i in named.items():
            labels[frame, region] = i
            held[i].append(ts)
            out.append((run, int(frame), int(region), int(i), used[i]))
            used[i] += 1
        recent.append((frame, ts, list(named)))
    return pd.DataFrame(out, columns=["run", "frame", "region", "id", "count"])


def window_overlaps(regions: DataFrame, region_px: DataFrame, window_hours: float) -> DataFrame:
    """Shares of pixels with the regions of earlier frames within a window: run, frame, region, old_frame, old_region,
    share_new, share_old.

    regions: run, frame, ts; region_px: run, frame, region, iy, ix, da. Pixels meet by place and by stretches of time as
    long as the window, so a pixel meets what lies at most two windows before, however long the run.
    """
    width = max(1, round(window_hours * HOUR))
    times = regions.select("run", "frame", micros(F.col("ts")).alias("__t")).distinct().withColumn("__b", F.floor(F.col("__t") / width))
    times = times.withColumn("__last", F.max("__b").over(Window.partitionBy("run")))  # one row a frame
    px = region_px.join(times, ["run", "frame"])
    size = region_px.groupBy("run", "frame", "region").agg(F.sum("da").alias("size"))
    new = px.select("run", "iy", "ix", "__b", "frame", "region", "da", "__t")
    old = px.select("run", "iy", "ix", F.explode(F.sequence("__b", F.least(F.col("__b") + 1, "__last"))).alias("__b"), F.col("frame").alias("old_frame"), F.col("region").alias("old_region"), F.col("__t").alias("__o"))
    met = new.join(old, ["run", "iy", "ix", "__b"]).where((F.col("__o") < F.col("__t")) & (F.col("__t") - F.col("__o") <= width))
    shared = met.groupBy("run", "frame", "region", "old_frame", "old_region").agg(F.sum("da").alias("shared"))
    o = shared.join(size, ["run", "frame", "region"]).withColumnRenamed("size", "__n").join(size.toDF("run", "old_frame", "old_region", "__m"), ["run", "old_frame", "old_region"])
    return o.select("run", "frame", "region", "old_frame", "old_region", (F.col("shared") / F.col("__n")).alias("share_new"), (F.col("shared") / F.col("__m")).alias("share_old"))


#: Entries of a matrix of distances at a time.
_AT_ONCE = 1 << 19

#: Regions of two windows up to which nearest_lists compares a window as a whole.
_WHOLE = 4096


def _nearest_rows(k: int, width: int, near: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One row (run, frame, region, old_frames, old_regions, ds) for each asking region of a cube that has its k nearest,
    or all in its window, at most `near` away; by matrices of distances between a few regions and those of their windows.
    """

    def rows(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["frame", "region"], ignore_index=True).rename_axis("name").reset_index()
        df = df.sort_values(["__t", "name"], ignore_index=True)
        t, name, frame, region, run = *(df[c].to_numpy() for c in ("__t", "name", "frame", "region")), df["run"].iat[0]
        at, ask = [df[f"__{c}"].to_numpy() for c in "xyz"], np.flatnonzero(df["__ask"].to_numpy())
        lo, hi = np.searchsorted(t, t[ask] - width), np.searchsorted(t, t[ask])  # where the window begins and ends
        reach = near * (1 - 1e-9) - 1e-12 if near < 2 else np.inf
        out, begin = [], 0
        while begin < len(ask):
            end = begin + 1
            while end < len(ask) and (end + 1 - begin) * (hi[end] - lo[begin]) <= _AT_ONCE:
                end += 1
            mine, old = ask[begin:end], np.arange(lo[begin], hi[end - 1])
            old = old[np.argsort(name[old])]  # equal distances count in this order
            d = np.round(np.sqrt(sum((v[mine, None] - v[None, old]) ** 2 for v in at)), 12)
            d[(old < lo[begin:end, None]) | (old >= hi[begin:end, None]) | ~(d <= reach)] = np.inf
            most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(old) > k else np.full(len(mine), np.inf)
            r, c = np.nonzero((d <= most[:, None]) & np.isfinite(d))
            by = np.lexsort((c, d[r, c], r))
            by = by[np.arange(len(r)) - np.searchsorted(r, r) < k]  # r is in order before and after
            r, c = r[by], c[by]
            cut = np.searchsorted(r, np.arange(len(mine) + 1))
            have = np.diff(cut)
            full = have == np.minimum(k, df["__want"].to_numpy()[mine]) if near < 2 else have > 0
            for i in np.flatnonzero(full):
                j = old[c[cut[i] : cut[i + 1]]]
                out.append((run, frame[mine[i]], region[mine[i]], frame[j], region[j], d[i, c[cut[i] : cut[i + 1]]]))
            begin = end
        return pd.DataFrame(out, columns=["run", "frame", "region", "old_frames", "old_regions", "ds"])

    return rows


def nearest_lists(regions: DataFrame, k: int, window_hours: float, cell: float | None = None) -> DataFrame:
    """nearest_before with one row a region: run, frame, region, old_frames, old_regions, ds (arrays, nearest first).

    A task compares the regions of a run that lie in one cube of the unit ball and in a stretch of four windows. Where no
    two windows on end hold more than 4096 regions, the ball is one cube, so each region is moved about once. Else a cube
    is four times as wide as the k nearest are looked for, and holds the earlier regions that near its sides as well:
    what has its k nearest is done, and the rest, less in every round, asks again at twice the distance, and last among
    all in the window. cell: another distance to begin with.
    """
    width = max(1, round(window_hours * HOUR))
    span = 4 * width
    x, y, z = to_cartesian(F.col("theta"), F.col("phi"))
    pts = regions.select("run", "frame", "region", micros(F.col("ts")).alias("__t"), x.alias("__x"), y.alias("__y"), z.alias("__z"), F.lit(True).alias("__ask"))
    pts = table(pts.where("__t IS NOT NULL AND __x IS NOT NULL AND __y IS NOT NULL AND __z IS NOT NULL"), "near_points")
    near = cell
    if near is None:
        before = Window.partitionBy("run").orderBy("__b").rangeBetween(-1, 0)
        held = pts.groupBy("run", F.floor(F.col("__t") / width).alias("__b")).count()
        most = held.select(F.sum("count").over(before).alias("n")).agg(F.max("n")).first()[0] or 0
        near = 2.0 if most <= _WHOLE else max(1e-3, 2 * (2 * k / most) ** 0.5)
    if near < 2:
        earlier = Window.partitionBy("run").orderBy("__t").rangeBetween(-width, -1)
        pts = table(pts.withColumn("__want", F.count("*").over(earlier)).withColumn("__ask", F.col("__want") > 0), "near_wanted")
    kind = {f.name: f.dataType.simpleString() for f in pts.schema}
    shape = f"run {kind['run']}, frame {kind['frame']}, region {kind['region']}, old_frames array<{kind['frame']}>, old_regions array<{kind['region']}>, ds array<double>"
    key, done = ["run", "frame", "region"], None
    while True:
        b = F.floor(F.col("__t") / span)
        late = (b + 1) * span - F.col("__t") <= width  # may lie in windows of the next stretch
        rows = pts.withColumn("__b", F.explode(F.when(late, F.array(b, b + 1)).otherwise(F.array(b)))).withColumn("__ask", F.col("__ask") & (F.col("__b") == b))
        cube = ["__cx", "__cy", "__cz"] if near < 2 else []
        for c, v in zip(cube, (F.col("__x"), F.col("__y"), F.col("__z")), strict=False):
            own = F.floor(v / (4 * near))
            sides = F.array_distinct(F.array(F.floor((v - near) / (4 * near)), own, F.floor((v + near) / (4 * near))))
            rows = rows.withColumn(c, F.explode(sides)).withColumn("__ask", F.col("__ask") & (F.col(c) == own))
        got = rows.groupBy("run", "__b", *cube).applyInPandas(_nearest_rows(k, width, near), shape)
        if near >= 2:
            return got if done is None else done.unionByName(got)
        got = table(got, "near_found")
        done = got if done is None else done.unionByName(got)
        pts = table(pts.join(got.select(*key, F.lit(True).alias("__done")), key, "left").withColumn("__ask", F.col("__ask") & F.col("__done").isNull()).drop("__done"), "near_todo")
        if pts.where("__ask").isEmpty():
            return done
        near = 2.0 if near > 0.5 else 2 * near


def nearest_before(regions: DataFrame, k: int, window_hours: float, cell: float | None = None) -> DataFrame:
    """The k nearest regions of earlier frames within a window (all, if they are fewer): run, frame, region, old_frame,
    old_region, d (chord). regions: run, frame, region, ts, theta, phi (J18's neighbours in I5).

    Of equal distances the least frame and region counts. Regions without a place or time are left out. How regions
    meet, and cell: see nearest_lists.
    """
    one = F.explode(F.arrays_zip("old_frames", "old_regions", "ds")).alias("o")
    got = nearest_lists(regions, k, window_hours, cell).select("run", "frame", "region", one)
    return got.select("run", "frame", "region", F.col("o.old_frames").alias("old_frame"), F.col("o.old_regions").alias("old_region"), F.col("o.ds").alias("d"))


def track(regions: DataFrame, region_px: DataFrame, thr: float = 0.0, window_hours: float = 168.0, weight: str = "proximity", k: int | None = None, near_thr: float = 0.0, keep: float | None = None) -> DataFrame:
    """Track ids (I5, W9): run, frame, region, id, count (how many regions of the frame had the id before).

    regions: run, frame, ts, region, and theta, phi of the centroid if k is given; region_px: run, frame, region, iy, ix,
    da. A region takes the label of the best mean overlap over thr (J20), else a new one. k: candidates are the labels
    whose probability among the k nearest earlier regions is over near_thr (J18); keep: without overlap, the likeliest
    label stays if its probability is at least that, as of a region that left its old pixels. Overlaps and neighbours of
    all frames are found in joins; only the fold of ids over them is sequential, one small row a pair, run by run.
    """
    kinds = [F.col(c).cast("long").alias(c) for c in ("run", "frame", "region")]
    some = {"ts": "timestamp_ntz", "old_frame": "long", "old_region": "long", "share_new": "double", "share_old": "double", "old_frames": "array<long>", "old_regions": "array<long>", "ds": "array<double>"}
    part = lambda df, what, *has: df.select(*kinds, *[(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in some.items()], F.lit(what).alias("what"))
    rows = part(regions, 0, "ts").unionByName(part(window_overlaps(regions, region_px, window_hours), 1, "old_frame", "old_region", "share_new", "share_old"))
    if k is not None:
        rows = rows.unionByName(part(nearest_lists(regions, k, window_hours), 2, "old_frames", "old_regions", "ds"))

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        parts = [df[df["what"] == i] for i in range(3)]
        if not len(parts[0]):
            return pd.DataFrame([], columns=["run", "frame", "region", "id", "count"])
        near = None
        if k is not None:
            lists, flat = parts[2], lambda c: np.concatenate([np.zeros(0, int), *parts[2][c]])
            n = np.array([len(ds) for ds in lists["ds"]], int)
            near = pd.DataFrame({**{c: np.repeat(lists[c].to_numpy(), n) for c in ("frame", "region")}, "old_frame": flat("old_frames"), "old_region": flat("old_regions"), "d": flat("ds")})
        return fold_tracks(parts[0], parts[1], thr, window_hours, weight, None, near, near_thr, keep)

    return rows.groupBy("run").applyInPandas(fold, TRACKED)


def connect(tracked: DataFrame, region_px: DataFrame, thr: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Edges (u, v, weight) between a region and those of the frame before, and the latest earlier ones of its id.

    tracked: frame, region, id, count; region_px: frame, region, iy, ix, da; tracked with the columns of `by`, such as the
    run, over which no edge goes. Frame numbers are integers and not shared by runs. An edge needs a mean overlap over
    thr; nodes are named frame_id_count, weights have three decimals. Regions meet by the pixels that they share, so what
    is moved follows the pixels and not the pairs of regions of two frames.
    """
    t = tracked.select(*by, "frame", "region", "id", "count").repartition(*by, "id").distinct()
    earlier = Window.partitionBy(*by, "id").orderBy("frame").rangeBetween(Window.unboundedPreceding, -1)
    t = table(t.withColumn("same", F.max("frame").over(earlier)), "connect_tracked")
    frames = t.select(*by, "frame").distinct().withColumn("prev", F.lag("frame").over(Window.partitionBy(*by).orderBy("frame")))  # one row a frame
    key = [F.col(c).cast(t.schema[c].dataType).alias(c) for c in ("frame", "region")]
    px = region_px.select(*key, "iy", "ix", "da").withColumn("size", F.sum("da").over(Window.partitionBy("frame", "region")))
    px = table(px.join(t.join(frames, [*by, "frame"]).drop(*by), ["frame", "region"]), "connect_px")
    old = px.select("iy", "ix", F.col("frame").alias("of"), F.col("region").alias("oregion"), F.col("id").alias("oid"), F.col("count").alias("ocount"), F.col("size").alias("osize"))
    asked = px.withColumn("of", F.explode(F.array_compact(F.array_distinct(F.array("prev", "same"))))).withColumn("any", F.col("of") == F.col("prev")).drop("prev", "same")
    met = asked.join(old, ["of", "iy", "ix"]).where(F.col("any") | (F.col("oid") == F.col("id")))
    both = met.groupBy("frame", "region", "id", "count", "size", "of", "oregion", "oid", "ocount", "osize").agg(F.sum("da").alias("s"))
    mean = (F.col("s") / F.col("size") + F.col("s") / F.col("osize")) / 2
    node = lambda *c: F.concat_ws("_", *c)
    return both.where(mean > thr).select(node("of", "oid", "ocount").alias("u"), node("frame", "id", "count").alias("v"), F.round(mean, 3).alias("weight"))


def rank_tracks(nodes: DataFrame, edges: DataFrame, n: int | None = None) -> DataFrame:
    """Connected parts of the graph by mean area, largest first: component, mean_area, n_nodes (A24, I7); n: the first n
    of them (O4)."""
    at = components(edges.select("u", "v"), "u", "v")
    named = nodes.where("node IS NOT NULL").join(at, "node", "left").withColumn("component", F.coalesce("component", "node"))
    got = named.groupBy("component").agg((F.sum("area") / F.count_distinct("frame")).alias("mean_area"), F.count("*").alias("n_nodes"))
    got = got.orderBy(F.desc("mean_area"), "component")
    return got if n is None else got.limit(n)


def track_series(nodes: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Area, net and unsigned flux, and nodes of each track and frame."""
    return nodes.groupBy(*by, "frame").agg(F.sum("area").alias("area"), F.sum("net_flux").alias("net_flux"), F.sum("abs_flux").alias("abs_flux"), F.count("*").alias("n_nodes"))


def edge_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Count, mean, deviation, median, least and greatest weight of edges within and between ids."""
    ids = nodes.select("node", "id")
    both = edges.join(ids.toDF("u", "__a"), "u").join(ids.toDF("v", "__b"), "v").withColumn("same_id", F.col("__a") == F.col("__b"))
    w = F.col("weight")
    both = table(both.select("same_id", "weight"), "edge_weights")
    got = both.groupBy("same_id").agg(F.count("*").alias("n"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.min(w).alias("least"), F.max(w).alias("greatest"))
    mid = exact_quantiles(both, "weight", [0.5], ["same_id"]).select(F.col("same_id").alias("__same"), F.col("quantiles")[0].alias("median"))
    return got.join(mid, F.col("same_id").eqNullSafe(F.col("__same")), "left").select("same_id", "n", "mean", "std", "median", "least", "greatest")


def weight_hist(edges: DataFrame, bins: int = 25) -> DataFrame:
    """Histogram of edge weights in [0, 1]."""
    i = F.least(F.floor(F.col("weight") * bins), F.lit(bins - 1)).cast("int")
    seen = edges.where(F.col("weight").between(0, 1)).groupBy(i.alias("bin")).agg(F.count("*").alias("n"))
    return edges.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(seen, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def expand_path(path: DataFrame, edges: DataFrame, nodes: DataFrame, thr: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a path: neighbours over edges of at least thr, then all nodes of the ids met."""
    both = edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")).where(F.col("weight") >= thr)
    near = both.join(path.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"))
    kept = path.select("node").unionByName(near).distinct()
    ids = nodes.join(kept, "node", "left_semi").select("id").distinct()
    wide = nodes.join(ids, "id", "left_semi").select(*nodes.columns)
    inside = edges.join(wide.select(F.col("node").alias("u")), "u", "left_semi").join(wide.select(F.col("node").alias("v")), "v", "left_semi").select(edges.columns)
    return wide, inside

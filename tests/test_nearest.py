"""Nearest points by cubes and sets of images with a bound, against plain loops."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from sunloom.operators import selection, tracks


def plain_nearest(test, train, k):
    out = []
    for i, t, p in test:
        at = (math.sin(t) * math.cos(p), math.sin(t) * math.sin(p), math.cos(t))
        near = sorted((round(math.dist(at, (math.sin(u) * math.cos(v), math.sin(u) * math.sin(v), math.cos(u))), 9), j) for j, u, v, _ in train)
        out += [(i, d) for d, _ in near[:k]]
    return sorted(out)


@pytest.mark.parametrize(("cell", "k"), [(None, 3), (0.01, 3), (2.0, 3), (None, 500)])
def test_nearest_points(spark, cell, k):
    rng = np.random.default_rng(5)
    spread = [(i, float(np.arccos(rng.uniform(-1, 1))), float(rng.uniform(0, 6.28))) for i in range(60)]
    clump = [(i, 1.0 + float(rng.uniform(0, 1e-3)), 2.0) for i in range(60, 160)]  # dense, while others are far apart
    train = [(i, t, p, i % 4) for i, t, p in spread + clump]
    test = [(0, 0.0, 0.0), (1, 1.0005, 2.0), (2, math.pi, 1.0), (3, *train[7][1:3])]
    schema = "theta double, phi double"
    got = tracks.nearest_points(spark.createDataFrame([*test, (9, None, 1.0)], f"test_id int, {schema}"), spark.createDataFrame(train, f"train_id int, {schema}, label int"), k, cell=cell)
    np.testing.assert_allclose(sorted((r.test_id, r.d) for r in got.collect()), plain_nearest(test, train, k), atol=2e-9)


def test_nearest_points_by_group_and_without_any(spark):
    test = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 7, 1.0, 1.0)], "test_id int, g int, theta double, phi double")
    train = spark.createDataFrame([(1, 0, 1.0, 1.0, 5), (2, 0, 2.0, 1.0, 6), (3, 1, 3.0, 1.0, 7)], "train_id int, g int, theta double, phi double, label int")
    got = {(r.test_id, r.train_id, r.label) for r in tracks.nearest_points(test, train, 2, ["g"]).collect()}
    assert got == {(1, 1, 5), (1, 2, 6), (2, 3, 7)}
    assert tracks.nearest_points(test, train.limit(0), 2).count() == 0
    assert {(r.test_id, r.label, r.prob) for r in tracks.knn_label_probs(test, train, 2, by=["g"]).collect()} == {(1, 5, 1.0), (2, 7, 1.0)}


def test_no_product_in_the_plan(spark):
    points = spark.createDataFrame(pd.DataFrame({"test_id": [1, 2], "train_id": [1, 2], "theta": [1.0, 2.0], "phi": [1.0, 2.0], "label": [1, 2]}))
    plan = tracks.knn_label_probs(points, points, 1)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_synchronic_sets_with_a_bound(spark):
    rng = np.random.default_rng(8)
    start = datetime(2024, 1, 1)
    names = ["a", "b", "c", "none"]
    images = [(i, names[i % 3], start + timedelta(seconds=int(rng.integers(0, 20)) * 300)) for i in range(90)]
    images += [(900, "a", start + timedelta(hours=10)), (901, "b", start + timedelta(hours=10, minutes=8)), (902, "b", start + timedelta(hours=9, minutes=53))]
    centers = [start + timedelta(minutes=m) for m in (0, 20, 47, 95, 600, 3000)]
    want = {}
    for c in centers:
        per = [[(i, t) for i, n, t in images if n == name and abs((t - c).total_seconds()) <= 1500] for name in names]
        best = None
        for combo in itertools.product(*[p for p in per if p]):
            days = [(t - c).total_seconds() / 86400 for _, t in combo]
            cost = sum(x * x for x in days) + sum((x - y) ** 2 for x, y in itertools.combinations(days, 2))
            order = (round(cost, 15), [t for _, t in combo], [i for i, _ in combo])
            best = order if best is None or order < best else best
        want[c] = sorted(best[2]) if best else []
    df = spark.createDataFrame(images, "data_id long, instrument string, date_obs timestamp_ntz")
    targets = spark.createDataFrame([(c,) for c in centers], "center timestamp_ntz")
    got = {c: [] for c in centers}
    for r in selection.select_synchronic(df, targets, names, 25).collect():
        got[r.center].append(r.data_id)
    assert {c: sorted(v) for c, v in got.items()} == want

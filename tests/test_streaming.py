"""Incremental jobs: any cut of a feed gives what the whole gives, and running again changes nothing."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import hist, selection
from sunloom.streaming import jobs

EDGES = [0.5 * k for k in range(11)]
START = datetime(2001, 1, 1)


def image_rows(seed=1, days=400):
    rng = random.Random(seed)
    rows = []
    for k in range(0, days, 5):
        for name, at in (("A", 2.0), ("B", 2.6)):
            rows += [(10 * k + ord(name), name, START + timedelta(days=k), min(4.9, max(0.1, rng.gauss(at, 0.6)))) for _ in range(30)]
    return rows


SCHEMA = "data_id long, instrument string, date_obs timestamp_ntz, value double"


def centers(spark):
    return selection.weekly_centers(spark, START, START + timedelta(days=420))


def sums(bins, due):
    return hist.window_hist(bins, due, 60).where("n > 0").groupBy("instrument", "center").agg(F.sum(F.col("n") * (F.col("i_int") + 1)).alias("m"))


def arrive(spark, tmp, rows, name):
    path = str(tmp / name)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.mode("append").parquet(path)
    jobs.update_histograms(jobs.read_feed(spark, path, df.schema, 1), f"{path}-store", f"{path}-check", "value", EDGES)
    return f"{path}-store"


def test_an_image_over_two_batches_keeps_all_pixels(spark, tmp_path):
    rows = image_rows()[:40]
    arrive(spark, tmp_path, rows[::2], "two")
    store = arrive(spark, tmp_path, rows[1::2], "two")
    got = {(r.data_id, r.i_int): r.n for r in jobs.histograms(spark, store).where("n > 0").collect()}
    want = {(r.data_id, r.i_y): r.n for r in hist.hist1d(spark.createDataFrame(rows, SCHEMA), ["data_id"], F.col("value"), EDGES).where("n > 0").collect()}
    assert got == want
    known = spark.createDataFrame([(rows[0][0],)], "data_id long")
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "known"))
    jobs.update_histograms(jobs.read_feed(spark, str(tmp_path / "known"), df.schema), str(tmp_path / "k-store"), str(tmp_path / "k-check"), "value", EDGES, known=known)
    assert rows[0][0] not in {r.data_id for r in jobs.histograms(spark, str(tmp_path / "k-store")).select("data_id").distinct().collect()}


@pytest.mark.parametrize("cut", ["dates", "mixed"])
def test_any_cut_gives_the_batch_result(spark, tmp_path, cut):
    rows = image_rows()
    if cut == "mixed":
        random.Random(3).shuffle(rows)
    fits, c = str(tmp_path / "fits"), centers(spark)
    for part in (rows[:700], rows[700:2000], rows[2000:]):
        store = arrive(spark, tmp_path, part, cut)
        assert jobs.update_fits(spark, store, fits, c, 60, sums) > 0
        before = spark.read.parquet(fits).count()
        assert jobs.update_fits(spark, store, fits, c, 60, sums) == 0  # without news
        assert spark.read.parquet(fits).count() == before
    got = {(r.instrument, r.center): r.m for r in jobs.coefficients(spark, fits).collect()}
    whole = str(tmp_path / "whole")
    jobs.update_fits(spark, store, whole, c, 60, sums)
    assert got == {(r.instrument, r.center): r.m for r in jobs.coefficients(spark, whole).collect()}
    assert max(t for _, t in got) <= START + timedelta(days=395 - 30)


def test_a_failed_second_stage_is_made_up_for(spark, tmp_path):
    rows, c = image_rows(), centers(spark)
    fits = str(tmp_path / "fits")
    store = arrive(spark, tmp_path, rows[:2000], "f")
    jobs.update_fits(spark, store, fits, c, 60, sums)
    store = arrive(spark, tmp_path, rows[2000:], "f")

    def broken(bins, due):
        return sums(bins, due).withColumn("m", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        jobs.update_fits(spark, store, fits, c, 60, broken)
    jobs.update_fits(spark, store, fits, c, 60, sums)
    whole = str(tmp_path / "whole")
    jobs.update_fits(spark, store, whole, c, 60, sums)
    rows_of = lambda p: {(r.instrument, r.center): r.m for r in jobs.coefficients(spark, p).collect()}
    assert rows_of(fits) == rows_of(whole)


def test_scaling_waits_for_limb_fits_and_minds_late_references(spark, tmp_path):
    """The reference's first weeks come last: weeks before its first are fitted again."""
    rows = image_rows(days=200)
    rows = [r for r in rows if r[1] == "B" or r[2] >= START + timedelta(days=80)]
    late = [r for r in rows if r[1] == "A" and r[2] < START + timedelta(days=120)]
    c, fits, bound = selection.weekly_centers(spark, START, START + timedelta(days=150)).where("day(center) < 15"), str(tmp_path / "fits"), str(tmp_path / "bound")
    store = arrive(spark, tmp_path, [r for r in rows if r not in late], "s")
    assert jobs.update_scaling(spark, store, fits, c, "A", EDGES, 60, limit=bound, within=0.05) == 0
    c.where(F.col("center") < START + timedelta(days=140)).withColumns({"version": F.lit(0), "upto": F.lit(0)}).write.parquet(bound)
    jobs.update_scaling(spark, store, fits, c, "A", EDGES, 60, limit=bound, within=0.05)
    store = arrive(spark, tmp_path, late, "s")
    jobs.update_scaling(spark, store, fits, c, "A", EDGES, 60, limit=bound, within=0.05)
    whole = str(tmp_path / "whole")
    jobs.update_scaling(spark, store, whole, c, "A", EDGES, 60, limit=bound, within=0.05)
    rows_of = lambda p: {(r.instrument, r.center): (round(r.alpha, 6), round(r.x, 6)) for r in jobs.coefficients(spark, p).collect()}
    got = rows_of(fits)
    assert got == rows_of(whole) and max(t for _, t in got) < START + timedelta(days=140)
    assert any(name == "B" and t < START + timedelta(days=50) for name, t in got)


def test_gaps_are_told_repaired_and_final(spark, tmp_path):
    hour = lambda h: START + timedelta(hours=h)
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    parts = [[("a", 0), ("b", 0), ("a", 1)], [("a", 5)], [("a", 3), ("a", 4)], [("a", 9), ("a", 10)], [("a", 14), ("a", 20)]]
    for part in parts:
        spark.createDataFrame([(k, hour(h)) for k, h in part], "instrument string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    feed = jobs.read_feed(spark, path, "instrument string, ts timestamp", 1)
    jobs.run_batches(jobs.feed_gaps(feed, 1.0, START, late="3 hours"), str(tmp_path / "check"), lambda b, n: b.write.mode("append").parquet(out))
    got = {(r["key"], r.kind, (r["at"] - START) // timedelta(hours=1), r.missing) for r in spark.read.parquet(out).collect()}
    assert ("a", "gap", 5, 3) in got and ("a", "repair", 5, 0) in got and ("a", "gap", 3, 1) in got and ("a", "gap", 9, 3) in got
    assert {(h, m) for k, kind, h, m in got if k == "a" and kind == "final"} == {(0, 0), (1, 0), (3, 1), (4, 0), (5, 0), (9, 3), (10, 0), (14, 3)}
    assert ("b", "final", 0, 0) in got and any(k == "b" and kind == "silent" for k, kind, _, _ in got)


def test_limb_fits_find_planted_parameters(spark):
    from sunloom.operators import limb

    edges, fine = np.linspace(0, 5, 101), np.linspace(0, 5, 20001)
    c = np.cumsum(np.exp(-(((fine - 2.3) / 0.4) ** 2) / 2) + 0.4 * np.exp(-(((fine - 1.5) / 0.3) ** 2) / 2))
    mus, planted, cubic = [*np.linspace(0.2, 1.0, 9)], (0.9, -0.15, 0.55), (-0.8, 0.9, -0.35, 1.2, -1.0, 0.3)
    forms = {
        "power": lambda m: (1 + planted[0] * (m ** planted[1] - 1), planted[2] * np.log10(m)),
        "cubic": lambda m: tuple(o + a * (m - 1) + b * (m * m - 1) + d * (m**3 - 1) for o, (a, b, d) in ((1, cubic[:3]), (0, cubic[3:]))),
        "rising": lambda m: (1 - 0.5 * (1 - m), 0.0),  # beta rises to the disk's centre, which the cubic may not
    }
    rows = [("empty", float(m), i, 0.0) for m in mus for i in range(100)]
    for name, f in forms.items():
        for m in map(float, mus):
            beta, y = f(m)
            rows += [(name, m, i, float(v)) for i, v in enumerate(np.diff(np.interp(beta * edges + y, fine, c / c[-1])))]
    df = spark.createDataFrame(rows, "who string, mu double, i_int int, share double")
    got = {(r.who, r.model): r for r in limb.fit_limb_models(df, list(edges), ["who"], max_rounds=60).collect()}
    power, poly, bound = got["power", "power_log"], got["cubic", "cubic"], got["rising", "cubic"]
    assert power.status == "converged" and np.allclose(power.params, planted, atol=0.03) and power.sse < 1e-4 and power.seconds > 0
    mu = np.array(mus)
    shape = lambda p: p[0] * (mu - 1) + p[1] * (mu**2 - 1) + p[2] * (mu**3 - 1)
    assert poly.status == "converged" and np.allclose(shape(poly.params[:3]), shape(cubic[:3]), atol=0.02) and np.allclose(shape(poly.params[3:]), shape(cubic[3:]), atol=0.05)
    a = bound.params
    assert a[0] <= 1e-12 and a[0] + 2 * a[1] + 3 * a[2] <= 1e-9 and a[3] >= -1e-12 and a[3] + 2 * a[4] + 3 * a[5] >= -1e-9
    assert min(abs(a[0]), abs(a[0] + 2 * a[1] + 3 * a[2])) < 1e-9  # on a bound
    assert got["empty", "cubic"].status == got["empty", "power_log"].status == "singular"
    stuck = limb.fit_limb(df.where("who = 'power'"), list(edges), "power_log", ["who"], max_rounds=2).first()
    assert stuck.status == "limit" and stuck.rounds == 2


def test_scaling_before_the_reference_has_its_own(spark):
    """The reference's own coefficients (base) move its histograms before others are fitted to them."""
    fine = np.linspace(0, 5, 5001)
    share = lambda a, x: np.diff(np.interp((np.array(np.linspace(0, 5, 51)) - x) / a, fine, np.cumsum(np.exp(-(((fine - 2) / 0.5) ** 2) / 2)))) * 100
    rows = [(n, START + timedelta(days=k), i, int(v)) for k in range(0, 60, 10) for n, (a, x) in {"ref": (1.0, 0.0), "other": (1.1, 0.2)}.items() for i, v in enumerate(share(a, x))]
    bins = spark.createDataFrame(rows, "instrument string, date_obs timestamp_ntz, i_int int, n long")
    c = spark.createDataFrame([(START + timedelta(days=30),)], "center timestamp_ntz")
    base = c.withColumns({"alpha": F.lit(1.2), "x": F.lit(-0.1)})
    got = {r.instrument: (r.alpha, r.x) for r in hist.fit_scaling(bins, c, "ref", [0.1 * k for k in range(51)], 180, base=base).collect()}
    assert got["ref"] == (1.2, -0.1)
    # other = 1.1 r + 0.2 and the scaled reference = 1.2 r - 0.1, so other goes to it by 1.2 / 1.1 and the rest
    assert abs(got["other"][0] - 1.2 / 1.1) < 0.02 and abs(got["other"][0] * 2.4 + got["other"][1] - 2.3) < 0.02

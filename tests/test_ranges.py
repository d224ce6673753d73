"""Work over ranges of group and order: as-of joins, numbering, trailing counts; plans whose cost follows the rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sunloom.operators import quality
from sunloom.plans import asof
from sunloom.plans.order import row_numbers

DAY = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else DAY + timedelta(minutes=minutes)


def plan(df):
    return df._jdf.queryExecution().analyzed().toString().lower()


def test_asof_brackets_in_few_large_groups(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "a", "a", "b", "c", None]), at(rng.choice([None, *range(0, 300, 3)]))) for i in range(400)]
    right = [(rng.choice(["a", "a", "b", None]), at(rng.randrange(0, 300)), rng.randrange(50)) for _ in range(150)]
    got = asof.asof_bracket(spark.createDataFrame(left, "i int, g string, t timestamp_ntz"), spark.createDataFrame(right, "g string, u timestamp_ntz, v int"), "t", "u", ["v"], ["g"])
    assert "currentrow$(), unboundedfollowing" not in plan(got)  # such a frame is gone through anew for every row
    found = {r.i: (r.before, r.after) for r in got.collect()}
    assert len(found) == len(left)
    for i, g, t in left:
        mine = [] if t is None else [(u, v) for h, u, v in right if h == g]
        early, late = [x for x in mine if x[0] <= t], [x for x in mine if x[0] >= t]
        want = (min(x for x in early if x[0] == max(early)[0]) if early else None, min(late) if late else None)
        assert tuple(None if s is None else tuple(s) for s in found[i]) == want, (i, g, t)


def test_numbers_within_groups_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(40)) for i in range(500)]
    got = row_numbers(spark.createDataFrame(rows, "i int, g string, o int"), ["o", "i"], parts=9, by=["g"]).collect()
    for g in ("a", "b", None):
        mine = sorted((o, i) for i, h, o in rows if h == g)
        assert {r.i: r.number for r in got if r.g == g} == {i: k + 1 for k, (_, i) in enumerate(mine)}


def test_trailing_counts_by_running_sums(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", None]), at(rng.choice([None, *range(0, 600, 7)]))) for i in range(300)]
    got = quality.frames_in_window(spark.createDataFrame(rows, "i int, g string, t timestamp_ntz"), 2, "t", ["g"])
    assert "rangeframe, -" not in plan(got)  # a sliding frame counts each row of the window anew
    found = {r.i: r.in_window for r in got.collect()}
    for i, g, t in rows:
        near = [s for _, h, s in rows if h == g and ((s is None) == (t is None)) and (t is None or timedelta() <= t - s <= timedelta(hours=2))]
        assert found[i] == len(near), (i, g, t)

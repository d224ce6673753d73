"""Set matching whose pairs don't follow shared members, and joins that don't broadcast by the size of files."""

import random
import re

from sunloom.operators import query as q
from sunloom.queries import QUERIES


def test_sets_that_share_a_frequent_member(spark):
    rng = random.Random(4)
    sets = {i: frozenset([0, *rng.sample(range(1, 12), rng.randrange(3))]) for i in range(120)} | {500: frozenset([1, None]), 501: frozenset([9, 10, 11, 3])}
    wants = {i: frozenset([0, *rng.sample(range(1, 12), rng.randrange(4))]) for i in range(80)} | {90: frozenset([1, None]), 91: sets[501]}
    rows = lambda x: [(i, m) for i, s in x.items() for m in s]
    got = q.match_sets(spark.createDataFrame(rows(wants), "w int, m int"), spark.createDataFrame(rows(sets), "s int, m int"), "w", "s", "m")
    assert not re.search(r"join inner, \(m#\d+ = m#\d+\)", got._jdf.queryExecution().analyzed().toString().lower())
    want = {}
    for w, s in wants.items():
        same = [i for i, t in sets.items() if t == s and None not in s]
        want[w] = same[0] if len(same) == 1 else None
    assert {r.w: r.s for r in got.collect()} == want and any(v is not None for v in want.values())


def test_small_files_are_not_broadcast(spark):
    got = QUERIES["a18_region_flux"](spark, "/root/testdata/sf0.001")
    assert "broadcasthashjoin" not in got._jdf.queryExecution().sparkPlan().toString().lower()

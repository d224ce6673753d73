"""Cheapest paths of many pairs at once, against a plain search."""

import heapq
import random

import pytest

from sunloom.plans import graph


def plain(edges, ids, src, dst):
    """(cost in millionths, edges) of the cheapest path, or None."""
    around = {}
    for u, v, w in edges:
        if u != v:
            c = 0 if ids[u] == ids[v] else round((1 - w) * 1_000_000)
            around.setdefault(u, []).append((v, c))
            around.setdefault(v, []).append((u, c))
    best, todo = {}, [(0, 0, src)]
    while todo:
        c, n, x = heapq.heappop(todo)
        if x in best:
            continue
        best[x] = (c, n)
        for y, w in around.get(x, []):
            if y not in best:
                heapq.heappush(todo, (c + w, n + 1, y))
    return best.get(dst)


@pytest.mark.parametrize("kind", ["chains", "bushy", "ring"])
def test_paths_by_a_plain_search(spark, kind):
    rng = random.Random(kind)
    n = {"chains": 90, "bushy": 40, "ring": 60}[kind]
    ids = {f"n{k}": rng.choice("abc") for k in range(n)}
    step = {"chains": [(k, k + 1) for k in range(n - 1) if k % 31 != 30] + [(5, 40), (12, 70), (40, 85)], "bushy": [(rng.randrange(n), rng.randrange(n)) for _ in range(90)], "ring": [(k, (k + 1) % n) for k in range(n)] + [(k, k) for k in range(3)]}[kind]
    edges = [(f"n{a}", f"n{b}", rng.choice([0.2, 0.5, 0.9, round(rng.random(), 3)])) for a, b in step]
    edges += [edges[0], (edges[1][1], edges[1][0], 0.99)]
    pairs = [(k, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for k in range(12)] + [(90, "n3", "n3"), (91, "n0", f"n{n - 1}"), (92, "n1", "nowhere")]
    got = {}
    frames = spark.createDataFrame(edges, "u string, v string, weight double"), spark.createDataFrame(list(ids.items()), "node string, id string"), spark.createDataFrame(pairs, "pair int, src string, dst string")
    for r in graph.cheapest_paths(*frames).orderBy("pair", "step").collect():
        got.setdefault(r.pair, []).append((r.step, r.node, r.cost))
    cost = {}
    for u, v, w in edges:
        c = 0 if ids[u] == ids[v] else round((1 - w) * 1_000_000)
        for a, b in ((u, v), (v, u)):
            cost[a, b] = min(c, cost.get((a, b), c))
    for k, src, dst in pairs:
        want = plain(edges, ids, src, dst) if dst in ids else None
        if want is None:
            assert k not in got
            continue
        steps, names, costs = zip(*got[k], strict=True)
        assert steps == tuple(range(len(steps))) and names[0] == src and names[-1] == dst and len(steps) - 1 == want[1]
        sums = [0]
        for a, b in zip(names, names[1:], strict=False):
            sums.append(sums[-1] + cost[a, b])
        assert sums[-1] == want[0] and all(abs(c - s / 1_000_000) < 1e-9 for c, s in zip(costs, sums, strict=True))


def test_components_of_leaves_make_no_rounds(spark, monkeypatch):
    """Nodes without greater neighbours leave at once: only ties between the others are gone through in rounds."""
    sizes, table = {}, graph.table

    def seen(df, name, *a):
        got = table(df, name, *a)
        sizes.setdefault(name, []).append(got.count())
        return got

    monkeypatch.setattr(graph, "table", seen)
    edges = [(k, 10_000 + 20 * k + j) for k in range(200) for j in range(20)] + [(7, 10_000), (8, 10_000), (9, 10_020), (50, 50), (90_000, 90_000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    join = {7: 0, 8: 0, 9: 1}
    assert got == {k: join.get(k, k) for k in range(200)} | {10_000 + 20 * k + j: join.get(k, k) for k in range(200) for j in range(20)} | {90_000: 90_000}
    assert max(sizes["component_round"]) <= 10


def least_reached(edges):
    at = {}

    def root(n):
        while at.setdefault(n, n) != n:
            n = at[n]
        return n

    for u, v in edges:
        p, q = sorted((root(u), root(v)))
        at[q] = p
    return {n: root(n) for n in list(at)}


def test_rounds_over_chains_work_on_what_is_left(spark, monkeypatch):
    """Chains in the order of their names: every round leaves about half, so all together leave less than twice the edges."""
    left, table = [], graph.table

    def seen(df, name, *a):
        got = table(df, name, *a)
        if name == "component_round":
            left.append(got.count())
        return got

    monkeypatch.setattr(graph, "table", seen)
    edges = [(f"{100 * c + k + 10_000}", f"{100 * c + k + 10_001}") for c in range(20) for k in range(99 - c)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == least_reached(edges)
    assert left[-1] == 0 and left[0] < 0.7 * len(edges) and sum(left) < 2 * len(edges)


@pytest.mark.parametrize("kind", ["chains", "hubs", "sparse", "dense"])
def test_components_by_a_plain_union(spark, kind):
    rng = random.Random(kind)
    name = [f"n{k}" for k in rng.sample(range(1000), 400)]
    edges = {
        "chains": [(name[k], name[k + 1]) for k in range(399) if k % 37] + [(name[k], name[k]) for k in range(0, 400, 37)],
        "hubs": [(name[rng.randrange(4)], name[rng.randrange(300)]) for _ in range(400)] + [(name[390], name[391])],
        "sparse": [(rng.choice(name), rng.choice(name)) for _ in range(180)],
        "dense": [(name[a + 50 * g], name[b + 50 * g]) for g in range(8) for a, b in [(rng.randrange(50), rng.randrange(50)) for _ in range(300)]],
    }[kind]
    edges += edges[:20] + [(v, u) for u, v in edges[:20]]
    got = spark.createDataFrame([*edges, (None, name[0]), (name[1], None)], "src string, dst string")
    rows = graph.components(got).collect()
    assert {r.node: r.component for r in rows} == least_reached(edges) and len(rows) == len(least_reached(edges))


def test_tracks_without_edges_are_ranked(spark):
    """Nodes without edges are tracks of their own, ends of edges that are no nodes count for nothing."""
    from sunloom.operators import tracks

    nodes = spark.createDataFrame([("b", 1, 4.0), ("c", 2, 2.0), ("d", 1, 9.0), ("e", 3, 1.0), (None, 1, 99.0)], "node string, frame int, area double")
    edges = spark.createDataFrame([("c", "b"), ("c", "x"), ("e", "e"), ("y", "z")], "u string, v string")
    got = [(r.component, r.mean_area, r.n_nodes) for r in tracks.rank_tracks(nodes, edges).collect()]
    assert got == [("d", 9.0, 1), ("b", 3.0, 2), ("e", 1.0, 1)]
    assert [r.component for r in tracks.rank_tracks(nodes, edges, 2).collect()] == ["d", "b"]


def test_chains_are_drawn_out_by_their_own_round(spark, monkeypatch):
    """A joint is asked for in the round it was taken out in, so a path's rows are joined once each."""
    names, table = [], graph.table
    monkeypatch.setattr(graph, "table", lambda df, name, *a: names.append(name) or table(df, name, *a))
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 0.5) for k in range(24)], "u string, v string, weight double")
    ids = spark.createDataFrame([(f"n{k}", str(k)) for k in range(25)], "node string, id string")
    got = graph.cheapest_paths(edges, ids, spark.createDataFrame([(1, "n0", "n24")], "pair int, src string, dst string"))
    assert [(r.step, r.node, r.cost) for r in got.orderBy("step").collect()] == [(k, f"n{k}", 0.5 * k) for k in range(25)]
    assert "path_how" not in names and names.count("path_parts") == 1

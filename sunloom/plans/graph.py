"""Connected components and cheapest paths as rounds of joins over written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import table


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each node of an undirected edge list reaches (operator I7).

    First the nodes without greater neighbours go, in one aggregation, unless they are few: each waits for its least
    neighbour's component, and its other neighbours are tied to that one. What is left is contracted in rounds: each node
    is drawn into that of its neighbours and itself whose hash of the round is least, so that a round leaves at most three
    quarters of the nodes on average, of a chain about half, and all rounds together cost a few times the first, however
    long the chains are. A round is an aggregation, two joins and a distinct over what is left; beyond max_rounds it
    raises. At last the rounds' choices are followed back, and each part is named by its least node. Nulls and loops are
    no edges, but a loop's node is a node.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    start = table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "component_edges")
    ends = start.where("u <> v")
    none = F.lit(None).cast(start.schema["v"].dataType).alias("v")
    each = ends.select(F.col("u").alias("n"), "v", F.lit(False).alias("below")).unionByName(ends.select(F.col("v").alias("n"), none, F.lit(True).alias("below"))).unionByName(start.where("u = v").select(F.col("u").alias("n"), none, F.lit(False).alias("below")))
    nodes = table(each.groupBy("n").agg(F.min("v").alias("m"), F.max("v").alias("x"), F.count("v").alias("d"), F.max("below").alias("below")), "component_nodes")
    tops = nodes.where("m IS NOT NULL AND NOT below")
    few = 4 * tops.count() < nodes.count()
    stay = nodes.where("m IS NOT NULL AND (below OR (d > 2 AND m <> x))").select(F.col("n").alias("u"), "m", "below")
    kept = ends.join(stay, "u").select(F.when(F.col("below"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("below"), F.col("v")).otherwise(F.col("m")).alias("v")).where("u <> v")
    now = ends if few else table(kept.unionByName(tops.where("m <> x").select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "component_round")
    drawn: list[DataFrame] = []
    for number in range(max_rounds):
        if now.isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mark = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        least = both.groupBy("u").agg(F.min(mark("v")).alias("s")).select(F.col("u").alias("n"), F.least(mark("u"), "s")["n"].alias("r"))
        drawn.append(table(least, "component_drawn"))
        a, b = drawn[-1].alias("a"), drawn[-1].alias("b")
        tied = now.join(a, F.col("u") == F.col("a.n")).join(b, F.col("v") == F.col("b.n")).where("a.r <> b.r")
        now = table(tied.select(F.greatest("a.r", "b.r").alias("u"), F.least("a.r", "b.r").alias("v")).distinct(), "component_round")
    else:
        raise RuntimeError(f"components were contracted still in round {max_rounds}")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("top"))
    for step in reversed(drawn):
        found = step.join(found.withColumnRenamed("node", "r"), "r", "left").select(F.col("n").alias("node"), F.coalesce("top", "r").alias("top"))
        found = table(found, "component_found")
    found = found.join(found.groupBy("top").agg(F.min("node").alias("component")), "top").select("node", "component")
    at = nodes.select(F.col("n"), F.when(F.lit(few) | F.col("m").isNull() | F.col("below"), F.col("n")).otherwise(F.col("m")).alias("node"))
    return at.join(found, "node", "left").select(F.col("n").alias("node"), F.coalesce("component", "node").alias("component"))


#: Costs count in millionths, and below them the edges of a path, so that of equal costs the fewest edges win.
UNIT = 1_000_000


def _least_edges(e: DataFrame) -> DataFrame:
    """One edge (a < b, w, via, round) a pair of nodes, the cheapest."""
    best = F.min(F.struct("w", "via", "round")).alias("s")
    return e.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(best).select("a", "b", "s.w", "s.via", "s.round")


def _shorten(e: DataFrame, terminals: DataFrame, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """(core edges, joints of each round): nodes of at most two edges that no path begins or ends at are taken out.

    In a round nodes go of which no two are neighbours, about a third of a chain, so rounds grow as the logarithm of the
    longest chain. A node between two others leaves one edge between them, with the node as `via` and the number of its
    `round`, and a joint with both its edges: mid, p (other node, w, via, round), q; a dead end leaves none. A round is
    three aggregations, by node, by node of few edges, and by edge.
    """
    joints: list[DataFrame] = []
    seat = terminals.select(F.col("node").alias("n"), F.lit(None).cast(e.select(F.struct(F.col("a").alias("o"), "w", "via", "round")).schema[0].dataType).alias("s"))
    for number in range(max_rounds):
        side = lambda n, o: e.select(F.col(n).alias("n"), F.struct(F.col(o).alias("o"), "w", "via", "round").alias("s"))
        nodes = side("a", "b").unionByName(side("b", "a")).unionByName(seat).groupBy("n").agg(F.count("*").alias("d"), F.min("s").alias("p"), F.max("s").alias("q"), F.max(F.col("s").isNull()).alias("held"))
        few = table(nodes.where("d <= 2 AND NOT held").drop("held"), "path_few")
        mark = F.struct(F.xxhash64("n", F.lit(number)).alias("x"), F.col("n").alias("y"))
        # a node goes if its mark is less than those that its neighbours of few edges send it
        sent = few.select(F.explode(F.array_distinct(F.array("p.o", "q.o"))).alias("n"), mark.alias("h"))
        every = few.select("n", mark.alias("h"), F.struct(F.col("d"), "p", "q").alias("own")).unionByName(sent.withColumn("own", F.lit(None).cast(few.select(F.struct(F.col("d"), "p", "q")).schema[0].dataType)))
        met = every.groupBy("n").agg(F.max("own").alias("own"), F.min("h").alias("h")).where(F.col("own").isNotNull() & (F.col("h.y") == F.col("n")))
        out = table(met.select(F.col("n").alias("mid"), "own.*"), "path_out")
        if out.isEmpty():
            return e, joints
        joints.append(out.where("d = 2").select("mid", "p", "q"))
        pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
        new = out.where("d = 2").select(*pair("p.o", "q.o"), (F.col("p.w") + F.col("q.w")).alias("w"), F.col("mid").alias("via"), F.lit(number).alias("round"))
        gone = out.select("mid", F.explode(F.array_distinct(F.array("p.o", "q.o"))).alias("o")).select(*pair("mid", "o"))
        kept = e.unionByName(new).withColumn("s", F.struct("w", "via", "round")).select("a", "b", "s").unionByName(gone.withColumn("s", F.lit(None).cast(e.select(F.struct("w", "via", "round")).schema[0].dataType)))
        kept = kept.groupBy("a", "b").agg(F.min("s").alias("s"), F.max(F.col("s").isNull()).alias("gone")).where("NOT gone")
        e = table(kept.select("a", "b", "s.w", "s.via", "s.round"), "path_core")
    raise RuntimeError(f"chains were shortened still in round {max_rounds}")


def _search(core: DataFrame, pairs: DataFrame, max_rounds: int) -> DataFrame:
    """(pair, s, a, b): the edges of a cheapest path of each pair over the core, from both ends; s edges lie before.

    A round relaxes the nodes whose cost fell. A pair is settled when what both fronts have cost is no less than the
    best meeting of its two sides.
    """
    both = table(core.select("a", "b", "w").unionByName(core.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "path_both")
    node = pairs.schema["src"].dataType
    begin = lambda c, side: pairs.select("pair", F.lit(side).alias("side"), F.col(c).alias("node"), F.lit(0).cast("long").alias("d"), F.lit(None).cast(node).alias("pred"), F.lit(True).alias("new"))
    best = table(begin("src", 0).unionByName(begin("dst", 1)), "path_best")
    for _ in range(max_rounds):
        two = best.where("side = 0").select("pair", "node", F.col("d").alias("d0")).join(best.where("side = 1").select("pair", "node", F.col("d").alias("d1")), ["pair", "node"])
        meet = two.groupBy("pair").agg(F.min(F.struct((F.col("d0") + F.col("d1")).alias("d"), "node")).alias("m"))
        fronts = best.where("new").groupBy("pair").agg(F.min(F.when(F.col("side") == 0, F.col("d"))).alias("f0"), F.min(F.when(F.col("side") == 1, F.col("d"))).alias("f1"))
        state = table(fronts.join(meet, "pair", "left").where("f0 IS NOT NULL AND f1 IS NOT NULL AND (m IS NULL OR f0 + f1 < m.d)").select("pair", F.col("m.d").alias("most")), "path_state")
        if state.isEmpty():
            break
        front = best.where("new").join(state, "pair").where("most IS NULL OR d < most").select("pair", "side", F.col("node").alias("a"), "d")
        reach = front.join(both, "a").select("pair", "side", F.col("b").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.col("a").alias("pred"), F.lit(1).alias("fresh"))
        all_ = best.select("pair", "side", "node", "d", "pred", F.lit(0).alias("fresh")).unionByName(reach)
        low = all_.groupBy("pair", "side", "node").agg(F.min(F.struct("d", "fresh", "pred")).alias("s"))
        best = table(low.select("pair", "side", "node", "s.d", "s.pred", (F.col("s.fresh") == 1).alias("new")), "path_best")
    else:
        raise RuntimeError(f"paths became cheaper still in round {max_rounds}")
    at = table(meet.select("pair", F.col("m.node").alias("node"), F.col("m.d").alias("total")), "path_meet")
    found = None
    walk = at.select("pair", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    steps = best.select("pair", "side", "node", "pred", "d").where("pred IS NOT NULL")
    while True:  # as many steps as the longer half of a path has over the core
        now = table(walk.join(steps, ["pair", "side", "node"]), "path_walk")
        if now.isEmpty():
            break
        found = now if found is None else found.unionByName(now)
        walk = now.select("pair", F.col("pred").alias("node"), "side")
    if found is None:
        return at.select("pair", F.lit(0).cast("long").alias("s"), F.col("node").alias("a"), F.col("node").alias("b")).where(F.lit(False))
    edge = both.select(F.col("a").alias("pred"), F.col("b").alias("node"), "w")
    found = found.join(edge, ["pred", "node"]).join(at.select("pair", "total"), "pair")
    forth = (F.col("side") == 0)
    hops = lambda c: F.pmod(c, F.lit(UNIT))
    start = F.when(forth, hops(F.col("d") - F.col("w"))).otherwise(hops(F.col("total")) - hops(F.col("d")))
    return found.select("pair", start.alias("s"), F.when(forth, F.col("pred")).otherwise(F.col("node")).alias("a"), F.when(forth, F.col("node")).otherwise(F.col("pred")).alias("b"))


def cheapest_paths(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(pair, step, node, cost): a cheapest path for each of many pairs of nodes (operator I8); no rows if there is none.

    edges: u, v, weight; nodes: node, id; pairs: pair, src, dst. An edge costs 0 between nodes of one id, else 1 - weight,
    either way; of equal costs the fewest edges win. Chains are shortened to single edges first, the rest is searched for
    all pairs at once from both ends, and the edges found are drawn out again. cost adds up along the path.
    """
    ids = nodes.select("node", "id")
    e = edges.select("u", "v", "weight").where("weight IS NOT NULL").join(ids.toDF("u", "iu"), "u").join(ids.toDF("v", "iv"), "v")
    cost = F.when(F.col("iu") == F.col("iv"), 0).otherwise(F.round((1 - F.col("weight")) * 1_000_000)).cast("long")
    none = F.lit(None).cast(nodes.schema["node"].dataType)
    e = table(_least_edges(e.select(F.col("u").alias("a"), F.col("v").alias("b"), (cost * UNIT + 1).alias("w"), none.alias("via"), F.lit(None).cast("int").alias("round"))), "path_edges")
    known = ids.select("node")
    pairs = table(pairs.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("pair", "src", "dst"), "path_pairs")
    terminals = table(pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct(), "path_terminals")
    core, joints = _shorten(e, terminals, max_rounds)
    # each pair's edges over the core, drawn out from the last round back: a joint is asked for in its own round only
    found = table(_search(core, pairs, max_rounds), "path_parts")
    known = core.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "via", "round")
    parts = table(found.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))).select("pair", "s", "a", "b", "w", "via", "round"), "path_told")
    done = parts.where("round IS NULL").select("pair", "s", "b", "w")
    waits = [parts.where("round IS NOT NULL")]
    for number in reversed(range(len(joints))):
        wide = reduce(DataFrame.unionByName, [w.where(F.col("round") == number) for w in waits])
        met = wide.select("pair", "s", "a", "b", F.col("via").alias("mid")).join(joints[number], "mid")
        turned = F.col("p.o") != F.col("a")
        first, last = F.when(turned, F.col("q")).otherwise(F.col("p")), F.when(turned, F.col("p")).otherwise(F.col("q"))
        met = met.select("pair", "s", "a", "b", "mid", first.alias("f"), last.alias("l"))
        part = lambda s, a, b, h: F.struct(s.alias("s"), F.col(a).alias("a"), F.col(b).alias("b"), *[F.col(f"{h}.{c}").alias(c) for c in ("w", "via", "round")])
        two = F.array(part(F.col("s"), "a", "mid", "f"), part(F.col("s") + F.pmod("f.w", F.lit(UNIT)), "mid", "b", "l"))
        parts = table(met.select("pair", F.explode(two).alias("t")).select("pair", "t.*"), "path_told")
        done = done.unionByName(parts.where("round IS NULL").select("pair", "s", "b", "w"))
        waits.append(parts.where("round IS NOT NULL"))
    starts = pairs.join(done.select("pair").distinct(), "pair", "left_semi").unionByName(pairs.where("src = dst")).select("pair", F.lit(0).cast("long").alias("step"), F.col("src").alias("node"), F.lit(0).cast("long").alias("w"))
    line = starts.unionByName(done.select("pair", (F.col("s") + 1).alias("step"), F.col("b").alias("node"), "w"))
    upto = F.sum(F.floor(F.col("w") / UNIT)).over(Window.partitionBy("pair").orderBy("step"))
    return line.select("pair", F.col("step").cast("int").alias("step"), "node", (upto / 1_000_000).alias("cost"))


def cheapest_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, max_rounds: int = 1000) -> DataFrame:
    """(step, node, cost): the cheapest path between two nodes (operator I8); no rows if there is none."""
    pairs = edges.sparkSession.createDataFrame([(0, start, goal)], "pair int, src string, dst string")
    return cheapest_paths(edges, nodes, pairs, max_rounds).select("step", "node", "cost")

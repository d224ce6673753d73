"""Minimax contiguous sharding.

Rows fall into atomic groups (equal texts). The groups stand in hash order, and the smallest capacity for which
that order can be cut into the given number of contiguous shards is found by binary search with a greedy check.
The check needs prefix sums of the group sizes; only a summary of bounded size ever reaches the driver, and the
parts of it that the search still doubts are refined by further aggregations until the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Order buckets; their totals are the only rows that meet in one task.
BUCKETS = 1024
#: Parts that the rows of one group are dealt into when they are numbered.
SALTS = 256
#: Rows of a summary of prefix sums that the driver holds.
SUMMARY = 8192


class _Ends:
    """What is known of the ends of groups on the line of summed sizes: blocks (least end, greatest end, ends)."""

    def __init__(self, total: int, summarise: Callable[[list[tuple[int, int]]], list[tuple[int, int, int]]]):
        self.total, self._summarise = total, summarise
        self.blocks = summarise([(1, total)]) if total else []
        self._index()

    def _index(self) -> None:
        self.blocks.sort()
        self.first, self.last = [b[0] for b in self.blocks], [b[1] for b in self.blocks]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest end <= x; they differ while it hides in a block."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        lo, hi, n = self.blocks[i]
        if x >= hi:
            return hi, hi
        return (lo, lo) if n <= 2 else (lo, min(x, hi - 1))

    def above(self, x: int) -> tuple[int, int]:
        """Bounds of the least end >= x."""
        i = bisect_left(self.last, x)
        if i == len(self.blocks):
            return self.total, self.total
        lo, hi, n = self.blocks[i]
        if x <= lo:
            return lo, lo
        return (hi, hi) if n <= 2 else (max(x, lo + 1), hi)

    def refine(self, ranges: Sequence[tuple[int, int]]) -> bool:
        """Ask again about the doubtful blocks that meet the ranges; False if there are none."""
        doubt = [b for b in self.blocks if b[2] > 2 and any(b[0] <= y and b[1] >= x for x, y in ranges)]
        if not doubt:
            return False
        gone, windows = set(doubt), []
        for b in doubt:
            if windows and windows[-1][2] == b[0]:
                windows[-1] = (windows[-1][0], b[1], b[1] + 1)
            else:
                windows.append((b[0], b[1], b[1] + 1))
        self.blocks = [b for b in self.blocks if b not in gone] + self._summarise([w[:2] for w in windows])
        self._index()
        return True

    def settle(self, points: Sequence[int], side: str) -> list[int]:
        look = getattr(self, side)
        while True:
            found = [look(x) for x in points]
            open_ = [(x, x) for x, (a, b) in zip(points, found, strict=True) if a != b]
            if not open_ or not self.refine(open_):
                return [a for a, _ in found]

    def path(self, capacity: int, shards: int, sure: bool) -> tuple[list[int], bool]:
        """Greedy cuts under a capacity, and whether they reach the end. sure: by lower bounds, else by upper ones.

        A greedy walk that meets a group larger than the capacity stands still from there on.
        """
        at, cuts = 0, []
        for _ in range(shards):
            at = max(at, self.below(at + capacity)[0 if sure else 1])
            cuts.append(at)
        return cuts, at >= self.total

    def least(self, shards: int, sure: bool) -> int:
        lo, hi = max(1, -(-self.total // shards)), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.path(mid, shards, sure)[1] else (mid + 1, hi)
        return lo


def block_widths(windows: Sequence[tuple[int, int]], summary: int) -> list[int]:
    """Widths of the blocks that each window is cut into: about `summary` in all, and two a window at least."""
    span = sum(b - a + 1 for a, b in windows)
    return [max(1, min(-(-span // summary), (b - a + 2) // 2)) for a, b in windows]


def minimax_cuts(ends: _Ends, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and cuts under it: each as near to an equal share as the capacity lets it."""
    if not ends.total:
        return 0, []
    while True:
        low, high = ends.least(shards, sure=False), ends.least(shards, sure=True)
        a, b = ends.path(low, shards, sure=True)[0], ends.path(high, shards, sure=False)[0]
        if not ends.refine([(p + low, q + high) for p, q in zip([0, *a], [0, *b], strict=True)]):
            break  # no cut of a capacity between the bounds is in doubt, so they are equal
    cap = high
    back, at = [], ends.total
    for _ in range(shards - 1):
        at = ends.settle([at - cap], "above")[0] if at > cap else 0
        back.append(at)
    back.reverse()
    ideal = [ends.total * k // shards for k in range(1, shards)]
    under, over = ends.settle(ideal, "below"), ends.settle(ideal, "above")
    cuts, at = [], 0
    for k in range(shards - 1):
        want = under[k] if ideal[k] - under[k] <= over[k] - ideal[k] else over[k]
        want = max(want, back[k], at)
        if ends.below(at + cap)[0] < want:
            want = min(want, ends.settle([at + cap], "below")[0])
        cuts.append(at := want)
    return cap, cuts


def minimax_shards(rows: DataFrame, id_col: str, size_col: str, group_cols: Sequence[str], shards: int) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Rows with equal group columns (nulls equal) share a shard. Sizes are positive; rows of one id may repeat, and
    an empty table gives an empty result. Only ids, sizes and hashes are shuffled, never the texts.
    """
    spark, g = rows.sparkSession, [f"__g{i}" for i in range(len(group_cols))]
    keyed = rows.withColumns({a: F.col(b) for a, b in zip(g, group_cols, strict=True)})
    keyed = keyed.withColumns({"__o": F.xxhash64(*g), "__salt": F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS))})
    bucket = F.shiftright("__o", 54).cast("int").alias("__b")
    parts = written(
        keyed.groupBy(bucket, "__o", *g, "__salt").agg(F.count("*").alias("__n"), F.sum(size_col).cast("long").alias("__s")),
        "shard_parts",
    )
    run = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__b").agg(F.sum("__n").alias("n"), F.sum("__s").alias("s"))
    starts = starts.select("__b", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("__n0"), F.coalesce(F.sum("s").over(run), F.lit(0)).alias("__s0"))
    whole = Window.partitionBy("__b").orderBy("__o", *g).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("__b").orderBy("__o", *g, "__salt").rowsBetween(Window.unboundedPreceding, -1)
    nth = Window.partitionBy("__b", "__o", *g).orderBy("__salt")
    line = parts.select(
        "*",
        F.sum("__s").over(whole).alias("__end"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__row"),
        (F.row_number().over(nth) == 1).alias("__first"),
    ).join(F.broadcast(starts), "__b")  # at most BUCKETS rows
    line = written(line.select("__o", *g, "__salt", (F.col("__end") + F.col("__s0")).alias("__end"), (F.col("__row") + F.col("__n0")).alias("__row"), "__first"), "shard_line")

    def summarise(windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        block, base = None, 0
        for (a, b), width in zip(windows, block_widths(windows, SUMMARY), strict=True):
            here = F.lit(base) + F.floor((F.col("__end") - a) / width).cast("long")
            fits = F.col("__end").between(a, b)
            block = F.when(fits, here) if block is None else block.when(fits, here)
            base += (b - a) // width + 1
        got = line.where("__first").select(block.alias("k"), "__end").where("k IS NOT NULL").groupBy("k")
        return [(r.lo, r.hi, r.n) for r in got.agg(F.min("__end").alias("lo"), F.max("__end").alias("hi"), F.count("*").alias("n")).collect()]

    total = line.agg(F.max("__end").alias("t")).first().t or 0
    _, cuts = minimax_cuts(_Ends(total, summarise), shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("__end") > c).cast("int")
    line = line.withColumn("shard", shard.cast("int"))
    begin = {r["shard"]: r.row for r in line.groupBy("shard").agg(F.min("__row").alias("row")).collect()}  # one row a shard
    first = F.element_at(F.array(*[F.lit(begin.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard") + 1)
    line = line.select("__o", *[F.col(c).alias(f"{c}r") for c in g], "__salt", "shard", (F.col("__row") - first).alias("__row"))
    rank = F.row_number().over(Window.partitionBy("__o", "__salt", *g).orderBy(id_col)) - 1
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}r")) for c in g]
    on = (F.col("a.__o") == F.col("b.__o")) & (F.col("a.__salt") == F.col("b.__salt"))
    for s in same:
        on = on & s
    out = keyed.withColumn("__rank", rank.cast("long")).alias("a").join(line.alias("b"), on)
    return out.select(*[F.col(f"a.{c}") for c in rows.columns], F.col("b.shard").alias("shard"), (F.col("b.__row") + F.col("a.__rank")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents dealt into shards of near equal bytes; equal texts stay together.

    size: UTF-8 bytes of the text plus 8 (null text: as the empty text, so 8). Groups are told apart by a 64-bit
    hash, the crc and the size together. Columns of docs other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    out = minimax_shards(rows, "doc_id", "size", ["text_hash", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole.

For sets whose smaller one falls in a size band, the threshold bounds the symmetric difference by some h. Shingles are
hashed into m segments. If a match allows a difference of d per segment (0: the same subset; 1: the same but for one
deleted shingle), at most h // (d + 1) segments of a linked pair don't match, so m = h // (d + 1) + 1 + spare segments
leave spare + 1 that do. Spare segments let a set leave its smallest segments unindexed: only a set with more than
`spare` of those indexes them as well, and two such sets still meet. A cost model picks d, spare and what counts as
small for each band. Candidates are verified on whole sets.

Copies (equal sets) are one class. A class is indexed only if enough of its least shingles, in one order for all, are
held by other classes as well: of two linked sets of which the smaller has n shingles, the least n - need + k share k at
least, where need is what both must hold in common. So most sets without near copies cost no keys, and no link is lost.

Within a key, every class is verified against the head of the key; classes linked to it are in one component, so only
pairs of a key that are still in different components follow, each with one side out of the key's largest component.
Pairs whose parities differ in more bits than the sets may in shingles can't be linked; parities are about as wide as
the sets and are compared before sets are moved. No link between components is lost, and a key of many near copies costs
about as many verifications as it has members.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import components
from ..plans.tables import dropped
from .common import bound_batches, sized_broadcast, written

_UPPER = bytes(range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Band:
    """Sets of lo to hi shingles as the smaller of a pair, whose larger has at most `top`."""

    lo: int
    hi: int
    top: int
    segments: int
    deletions: bool
    spare: int
    small: int  # a segment of at most so many rare shingles is small


@dataclass(frozen=True)
class Join:
    """words per shingle, and the similarity in hundredths that links two sets."""

    words: int = 3
    percent: int = 90
    ratio: float = 1.4

    def largest(self, n: int) -> int:
        """The most shingles of a set that can be linked to one of n."""
        return 100 * n // self.percent

    def difference(self, n: int) -> int:
        """The most shingles by which two linked sets differ, the smaller of at most n."""
        return (n + self.largest(n)) * (100 - self.percent) // (100 + self.percent)

    def need(self, n: int) -> int:
        """The fewest shingles that a set of n and one linked to it hold in common; also the least size of the latter."""
        return -(-self.percent * n // 100)

    def spare(self, n: int) -> int:
        """How many of a set's least shingles its partner holds at least, beyond the first: rises with n, below need."""
        return n * (100 - self.percent) // 200

    def least(self, n: int) -> int:
        """How many of its least shingles speak for a set of n."""
        return n - self.need(n) + 1 + self.spare(n)


def _tail(m: int, p: float, most: int) -> float:
    """P(more than `most` of m segments are small) if each is with chance p."""
    term, left = (1 - p) ** m, 1.0
    for k in range(most + 1):
        left -= term
        term *= (m - k) / (k + 1) * p / (1 - p) if p < 1 else 0
    return max(left, 0.0)


@lru_cache(maxsize=4096)
def _allocate(lo: int, hi: int, top: int, h: int) -> Band:
    """The cheapest allocation: keys to index, plus a penalty for sets that must index their small segments."""
    best = None
    for deletions in (False, True):
        for spare in sorted({0, 1, 2, 3, 4, 6, 8, *(int(h * f) for f in (0.05, 0.1, 0.15, 0.2, 0.3, 0.4))}):
            m = (h // 2 if deletions else h) + 1 + spare
            rate = 0.7 * lo / m
            low = int(deletions)
            p = sum(exp(-rate + k * log(rate) - sum(map(log, range(1, k + 1)))) for k in range(low + 1))
            cost = m + (hi if deletions else 0) + 500 * _tail(m, min(p, 0.999), spare)
            if best is None or cost < best[0]:
                best = (cost, Band(lo, hi, top, m, deletions, spare, low))
    return best[1]


def band(k: int, join: Join) -> Band:
    lo, hi = _edges(k, join)
    return _allocate(lo, hi, join.largest(hi), join.difference(hi))


@lru_cache(maxsize=4096)
def _edges(k: int, join: Join) -> tuple[int, int]:
    lo = 1
    for _ in range(k):
        lo = max(lo + 1, int(lo * join.ratio))
    return lo, max(lo + 1, int(lo * join.ratio)) - 1


def bands_of(n: int, join: Join) -> list[tuple[int, Band]]:
    """The bands in which a set of n shingles can be one of a pair."""
    out, k = [], 0
    while _edges(k, join)[0] <= n:
        lo, hi = _edges(k, join)
        if n <= join.largest(hi):
            out.append((k, band(k, join)))
        k += 1
    return out


def shingle_set(text: str, join: Join) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: runs of `words` words, or all words if there are fewer.

    A-Z are lower-cased; words are cut at the six ASCII white-space characters. No words: an empty set.
    """
    words = text.encode().translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hash_word, words), dtype=np.uint64, count=len(words))
    size = min(join.words, len(words))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = mix(h * _M1 + w[i : len(w) - size + 1 + i])
    return np.unique(h)


_words: dict[bytes, int] = {}


def hash_word(word: bytes) -> int:
    found = _words.get(word)
    if found is None:
        import xxhash

        if len(_words) > 150_000:
            _words.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            _words[word] = found
    return found


def width(n: int) -> int:
    """Bits of the parities of a set of n shingles: the power of two above n, 512 at least."""
    return max(512, 1 << n.bit_length())


def parity(h: np.ndarray, bits: int) -> bytes:
    """A bit for each remainder of the shingles by `bits`: is their number odd? Two sets differ in at least as many shingles
    as bits. Folding halves onto each other gives the parities of half the width."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def folded(x: bytes, bits: int) -> np.ndarray:
    """Parities at a smaller width, as 64-bit numbers."""
    p = np.frombuffer(x, np.int64)
    while 64 * len(p) > bits:
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return p


def apart(x: bytes, y: bytes) -> int:
    """The bits in which two parities differ, at the width of the narrower one."""
    bits = 8 * min(len(x), len(y))
    return int(np.bitwise_count((folded(x, bits) ^ folded(y, bits)).view(np.uint64)).sum())  # of signed numbers it would count absolute values


def set_name(h: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers for a set; equal sets have equal ones."""
    other = mix(h ^ _M3)
    both = np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h)), other.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(other + _M1)), len(h)], dtype=np.uint64)
    return tuple((mix(both[k : k + 1] * _M1 + both[k + 1 : k + 2]) + both[4:] * _M3).view(np.int64)[0].item() for k in (0, 2))


def rare_mask(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    return common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h if len(common) else np.ones(len(h), bool)


def least_shingles(h: np.ndarray, join: Join, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The rare ones among the least shingles of a set, and the number of common ones; none if only copies can be linked.

    Least is in the order of the hashes, with common shingles last.
    """
    if all(join.difference(b.hi) == 0 for _, b in bands_of(len(h), join)):
        return h[:0], 0
    least = join.least(len(h))
    rare = h[rare_mask(h, common)][:least]
    return rare, min(least, len(h)) - len(rare)


def keys_of(h: np.ndarray, join: Join, common: np.ndarray) -> np.ndarray:
    """The index keys of a set, for every band in which it can be one of a pair. common: sorted hashes."""
    out = []
    rare = rare_mask(h, common)
    for k, b in bands_of(len(h), join):
        if join.difference(b.hi) == 0:
            continue  # only copies can be linked here
        salt = 1_000_003 * k + 1
        token = mix(h + np.uint64(salt * int(_M1) & (1 << 64) - 1))
        seg = ((token >> np.uint64(32)) * np.uint64(b.segments)) >> np.uint64(32)
        seg = seg.astype(np.int64)
        size = np.bincount(seg, minlength=b.segments)
        order = np.argsort(seg, kind="stable")
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + _M2)[order], dtype=np.uint64)])
        ends = np.cumsum(size)
        total = running[ends] - running[ends - size]
        name = (np.arange(b.segments, dtype=np.uint64) + np.uint64(salt << 20)) * _M1
        scarce = np.bincount(seg[rare], minlength=b.segments)
        every = int((scarce <= b.small).sum()) > b.spare
        out.append(mix(total + name)[slice(None) if every else scarce >= b.small + 1 - b.deletions])
        if b.deletions:
            keep = np.ones(len(h), bool) if every else (scarce >= b.small + 1)[seg]
            one = (total[seg] - mix(token + _M2) + name[seg])[keep]
            out.append(mix(one))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def common_shingles(docs: DataFrame, join: Join, share: float = 0.004, least_docs: int = 4000, least: int = 8, most: int = 500_000) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold, by a sample of `share` of all (least_docs if that is more).

    Counted there at least `least` times; the `most` frequent of them, 4 MB at most. A poor sample makes the join slower,
    not wrong.
    """
    n, space = docs.count(), 1 << 30
    cut = int(space * min(1.0, max(share, least_docs / max(1, n))))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(space)) < cut)
    held = _texts(sample, lambda h: (h, 0), join).groupBy("hi", "lo").agg(F.any_value("items").alias("items")).select(F.explode("items").alias("s"))
    top = held.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(most)
    return np.sort(top.select("s").toArrow()["s"].to_numpy().view(np.uint64))


def _lists(items: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, items)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items).view(np.int64) if items else np.zeros(0, np.int64)))


def _texts(docs: DataFrame, items: Callable[[np.ndarray], tuple[np.ndarray, int]], join: Join, once: bool = False) -> DataFrame:
    """doc_id, size, name (hi, lo), items and a number beside them of the set of each row.

    once: a task gives the items of copies once, mostly; the others have none, and 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sizes, names, lists, beside = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text or "", join)
                name = set_name(h)
                sizes.append(len(h))
                names.append(name)
                found, more = items(h) if name not in seen else (h[:0], 0)
                lists.append(found)
                beside.append(more)
                if once:
                    seen.add(name)
            if len(seen) > 200_000:
                seen.clear()
            hi, lo = zip(*names, strict=True) if names else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(beside, pa.int32()), _lists(lists)],
                ["doc_id", "n", "hi", "lo", "sure", "items"],
            )

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n int, hi long, lo long, sure int, items array<long>")


def _candidates(signed: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The classes that share enough of their least shingles with others to be linked with one.

    Common shingles are shared: several sets of the sample hold them. Only rare ones meet by their hash, so none of
    those is held by a large part of all classes.
    """
    tokens = signed.select(F.explode("items").alias("s"), "lo").repartition("s")
    held = Window.partitionBy("s")
    shared = tokens.withColumn("least", F.min("lo").over(held)).withColumn("most", F.max("lo").over(held)).where("least <> most")
    counts = shared.select("s", "lo").distinct().groupBy("lo").agg(F.count("*").alias("shared"))
    smaller = F.floor((F.lit(join.percent) * F.col("n") + 99) / 100)  # the least size of a partner
    enough = 1 + F.floor(smaller * (100 - join.percent) / 200)
    return classes.join(counts, "lo", "left").where(F.coalesce("shared", F.lit(0)) + F.col("sure") >= enough).drop("shared", "sure")


def _sets(docs: DataFrame, wanted: DataFrame, join: Join, bound: int = 1_000_000) -> DataFrame:
    """c, n, parities (also at 512 bits) and shingles of each wanted class, from the text of its least doc_id, or of any row without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists, odd = [], [], []
            for text, c, hi, lo in zip(*(col.to_pylist() for col in batch.columns[:4]), strict=True):
                h = shingle_set(text or "", join)
                if set_name(h) == (hi, lo):
                    out.append((c, len(h)))
                    lists.append(h)
                    odd.append(parity(h, width(len(h))))
            c, n = zip(*out, strict=True) if out else ((), ())
            short = _lists([folded(x, 512) for x in odd])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(odd, pa.binary()), short, _lists(lists)], ["c", "n", "odd", "short", "items"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = zip(*(set_name(shingle_set(t or "", join)) for t in batch.column(0).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["text", "hi", "lo"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    by_id, no_id = wanted.where("rep IS NOT NULL"), wanted.where("rep IS NULL")
    n, m = wanted.agg(F.count("rep"), F.count_if(F.col("rep").isNull())).first()
    rows = texts.join(sized_broadcast(by_id, n, bound), "rep").select("text", "c", "hi", "lo")
    if m:  # sets that only rows without a doc_id hold
        loose = docs.where(F.col("doc_id").isNull()).select(F.col("text").cast("string").alias("text")).mapInArrow(name, "text string, hi long, lo long")
        rows = rows.unionByName(loose.join(sized_broadcast(no_id.drop("rep"), m, bound), ["hi", "lo"]).select("text", "c", "hi", "lo"))
    sets = written(rows.mapInArrow(run, "c long, n int, odd binary, short array<long>, items array<long>"), "jaccard_sets")
    return sets if sets.count() == n + m else sets.dropDuplicates(["c"])  # a doc_id or text may repeat


def _met(sets: DataFrame, known: Broadcast, join: Join) -> DataFrame:
    """(key, c, n, crowd): the classes of every key that at least two classes hold, and how many they are.

    Keys are counted by aggregation and joined back, so the classes of a hot key need not meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            keys = [keys_of(values[a:b], join, known.value) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            times = np.array([*map(len, keys)], dtype=np.int64)
            columns = [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), *(pa.array(np.repeat(col.to_numpy(), times)) for col in batch.columns[:2])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "c", "n"])

    held = written(sets.select("c", "n", "items").mapInArrow(run, "key long, c long, n int"), "jaccard_keys")
    return held.join(held.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1"), "key")


def _similar(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough: by parities first, then by the sets themselves."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns[:6])
            yield batch.select(["a", "b"]).filter(pa.array([(100 + join.percent) * apart(p, q) <= (100 - join.percent) * (i + k) for i, k, p, q in zip(n, m, x, y, strict=True)], pa.bool_()))

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("c").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    fit = pairs.join(side("a", "n", "odd"), "a").join(side("b", "n", "odd"), "b").select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(near, "a long, b long")
    fit = written(fit, "jaccard_fit")
    both = F.size(F.array_intersect("items_a", "items_b"))
    linked = 100 * both >= join.percent * (F.size("items_a") + F.size("items_b") - both)
    return fit.join(side("a", "items"), "a").join(side("b", "items"), "b").where(linked).select("a", "b")


def _component(rows: DataFrame, at: DataFrame, of: str, name: str = "component") -> DataFrame:
    """rows with the component of the node in a column, which is its own where it has no link."""
    found = at.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return rows.join(found, F.col(of) == F.col("__node"), "left").withColumn(name, F.coalesce("__component", of)).drop("__node", "__component")


def link_documents(docs: DataFrame, join: Join = Join(), block: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    component_id is the least doc_id that links reach; a row whose set is empty (null text, no words) has its own id.
    Rows with equal sets are linked. Rows with a null doc_id are judged like others; the least id skips nulls.
    block: about so many classes of a key that lie outside its largest component meet all others of it in one task.
    """
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, join))  # of bounded size
    signed = written(_texts(docs, lambda h: least_shingles(h, join, known.value), join, once=True), "jaccard_signed")
    classes = signed.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sure").alias("sure"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "jaccard_classes")
    wanted = written(_candidates(signed, classes, join), "jaccard_wanted")
    rows = written(signed.select("doc_id", "n", "hi", "lo").join(classes.select("hi", "lo", "c"), ["hi", "lo"], "left").select("doc_id", "n", "c"), "jaccard_rows")
    classes = written(classes.select("c", "rep"), "jaccard_names")
    dropped(signed)
    sets = _sets(docs, wanted.select("rep", "c", "hi", "lo"), join)
    met = written(_met(sets, known, join), "jaccard_met")
    # the head of a key is the set that meets most others: of near copies, the one they come from
    pull = met.groupBy("c").agg(F.sum("crowd").alias("w"))
    heads = met.join(pull, "c").groupBy("key").agg(F.max(F.struct("w", "c", "n")).alias("head"))
    headed = met.join(heads, "key")
    near = 100 * F.least("n_a", "n_b") >= join.percent * F.greatest("n_a", "n_b")
    pairs = headed.select(F.col("head.c").alias("a"), F.col("head.n").alias("n_a"), F.col("c").alias("b"), F.col("n").alias("n_b"))
    first = written(pairs.where((F.col("a") != F.col("b")) & near).select("a", "b").distinct(), "jaccard_first")
    links = written(_similar(first, sets, join), "jaccard_links")
    at = components(links, "a", "b")
    # keys that still hold more than one component: all their pairs across components, in blocks of one side
    placed = _component(met.select("key", "c", "n"), at, "c")
    many = placed.groupBy("key", "component").agg(F.count("*").alias("k"))
    open_ = many.groupBy("key").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("parts"), F.sum("k").alias("crowd")).where("parts > 1")
    open_ = open_.select("key", F.col("most.component").alias("main"), F.ceil((F.col("crowd") - F.col("most.k")) / block).cast("int").alias("blocks"))
    rest = written(placed.join(open_, "key").join(sets.select("c", "short"), "c"), "jaccard_open")
    other = rest.where("component <> main").select("key", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"), *(F.col(c).alias(f"{c}_a") for c in ("c", "n", "component", "short")))
    bits = sum(F.bit_count(F.get("short", F.lit(i)).bitwiseXOR(F.get("short_a", F.lit(i)))) for i in range(8))
    fits = (100 * F.least("n_a", "n") >= join.percent * F.greatest("n_a", "n")) & ((100 + join.percent) * bits <= (100 - join.percent) * (F.col("n_a") + F.col("n")))
    once = (F.col("component") == F.col("main")) | (F.col("c_a") < F.col("c"))
    rest_by_block = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.join(rest_by_block, ["key", "block"]).where((F.col("component_a") != F.col("component")) & once & fits)
    pairs = pairs.select(F.least("c_a", "c").alias("a"), F.greatest("c_a", "c").alias("b")).distinct()
    pairs = written(pairs.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti"), "jaccard_pairs")
    dropped(met, rest)
    more = written(_similar(pairs, sets, join), "jaccard_more")
    dropped(sets)
    named = _component(classes, at, "c")
    if not more.isEmpty():  # links between components
        over = _component(_component(more, at, "a", "u"), at, "b", "v").select("u", "v")
        named = _component(named, components(over, "u", "v"), "component")
    named = written(named, "jaccard_named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("c", "component_id")
    out = rows.join(named, "c", "left")
    own = F.when(F.col("n") > 0, F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce(own, F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join(5, 80), bound: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, without those that links tie to a lesser doc_id.

    Rows that share a doc_id are one document: one of them stays. Rows without a doc_id stay.
    """
    linked = written(link_documents(docs.select("doc_id", "text"), join).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "jaccard_groups")
    gone = linked.where("component_id < doc_id").select("doc_id")
    stay = docs.join(F.broadcast(gone) if gone.count() <= bound else gone, "doc_id", "left_anti").select(docs.columns)
    again = linked.where("n > 1 AND component_id = doc_id").select("doc_id")
    if again.isEmpty():
        return stay
    one = stay.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return stay.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)

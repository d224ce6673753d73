"""SimHash fingerprints of word shingles, and links between near ones by pigeonring filtering.

A fingerprint's 64 bits are a ring of equal segments. If two fingerprints differ in at most `budget` bits, then from some
segment on, every chain of consecutive segments differs in at most its share of the budget: l of m segments in at most
l * budget / m bits. So the first segments of that chain are equal, and among those up to where two differences would be
in budget at most one differs. An index key is a start with the segments that are equal: the first ones and all but one
of the next. Two fingerprints that share a key are checked along the rest of the chain, and then in all bits.

Work is linear in the members of a key. Each is checked against the key's head; members that this leaves in different
components are compared with each other, one side out of the largest component. Where those comparisons would be many,
as in a large group of near copies, the members meet at the fingerprints between them instead: all that lie within half
of the budget of one point are linked, whatever their number, without a pair being made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import components
from .common import bound_batches, sized_broadcast, written

_UPPER = bytes(range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
BITS = 64


@dataclass(frozen=True)
class Ring:
    """budget: most bits in which linked fingerprints differ, fewer than the segments, whose number divides 64.

    dense: most comparisons in a key before its members meet at points between them (bears on cost only).
    """

    budget: int = 3
    segments: int = 8
    dense: int = 4096

    @property
    def width(self) -> int:
        return BITS // self.segments

    @property
    def equal(self) -> int:
        """Segments at the start of a chain that have no budget."""
        return max(n for n in range(1, self.segments + 1) if n * self.budget // self.segments == 0)

    @property
    def single(self) -> int:
        """Segments from the start of a chain that have a budget of one bit."""
        return max(n for n in range(1, self.segments + 1) if n * self.budget // self.segments <= 1)


def fingerprint(text: str | None, words: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """The SimHash of a text's shingles, repeats included: a bit is set where over half of their XXH64 have it.

    A-Z are lower-cased, words are cut at the six ASCII white-space characters. Fewer words than a shingle has: the
    whole sequence is one; none, or a null text: 0.
    """
    import xxhash

    found = (text or "").encode().translate(_UPPER).split()
    if not found:
        return 0
    k = min(words, len(found))
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts, digest = len(found) - k + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        a, b = starts[at : min(at + block, n)].tolist(), ends[at + k - 1 : min(at + block, n) + k - 1].tolist()
        h = np.array([digest(line[x:y], seed) for x, y in zip(a, b, strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _turned(x: Column, by: int) -> Column:
    """The ring from bit `by` on."""
    return x if by == 0 else F.shiftrightunsigned(x, by).bitwiseOR(F.shiftleft(x, BITS - by))


def _low(bits: int) -> Column:
    return F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")


def chain_keys(fp: Column, ring: Ring) -> Column:
    """Structs (start, but, part): for every start of a chain and every segment that may differ in it, the others."""
    out, w = [], ring.width
    for start in range(ring.segments):
        chain = _turned(fp, start * w).bitwiseAND(_low(ring.single * w))
        for but in range(ring.equal, ring.single) or [None]:
            part = chain if but is None else chain.bitwiseAND(F.lit(~(((1 << w) - 1) << (but * w))).cast("long"))
            out.append(F.struct(F.lit(start * ring.segments + (but or 0)).cast("int").alias("at"), part.alias("part")))
    return F.array(*out)


def in_chain(a: Column, b: Column, at: Column, ring: Ring) -> Column:
    """Is every chain from the key's start within its share of the budget, and the whole ring in budget?"""
    x, w = a.bitwiseXOR(b), ring.width
    turned = F.lit(None).cast("long")
    for start in range(ring.segments):
        turned = F.when(F.floor(at / ring.segments) == start, _turned(x, start * w)).otherwise(turned)
    fine = F.lit(True)
    for most in range(1, ring.budget + 1):  # the longest chain of each share; shorter ones lie in it
        n = max(n for n in range(1, ring.segments + 1) if n * ring.budget // ring.segments <= most)
        fine = fine & (F.bit_count(turned.bitwiseAND(_low(n * w))) <= most)
    return fine


def _met(prints: DataFrame, ring: Ring, bound: int) -> DataFrame:
    """(at, part, fp, crowd): the members of every key that two fingerprints hold at least."""
    keyed = prints.select("fp", F.explode(chain_keys(F.col("fp"), ring)).alias("k")).select("k.at", "k.part", "fp")
    shared = written(keyed.groupBy("at", "part").agg(F.count("*").alias("crowd")).where("crowd > 1"), "simhash_shared")
    return written(keyed.join(sized_broadcast(shared, shared.count(), bound), ["at", "part"]), "simhash_met")


def _placed(rows: DataFrame, at: DataFrame) -> DataFrame:
    """rows with the component of fp."""
    found = at.select(F.col("node").alias("fp"), F.col("component").alias("__c"))
    return rows.join(found, "fp", "left").withColumn("component", F.coalesce("__c", "fp")).drop("__c")


def _open(met: DataFrame, at: DataFrame) -> DataFrame:
    """The members of keys that hold several components, with the largest of them (main), the members (size) and those
    outside it (others)."""
    placed = _placed(met, at)
    parts = placed.groupBy("at", "part", "component").agg(F.count("*").alias("k"))
    keys = parts.groupBy("at", "part").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.max("k").alias("k"), F.count("*").alias("n"))
    return placed.join(keys.where("n > 1").select("at", "part", "main", "size", (F.col("size") - F.col("k")).alias("others")), ["at", "part"])


def _flips(rows: DataFrame, *radii: int) -> DataFrame:
    """(fp, point): the points that differ from a fingerprint in a number of bits out of radii."""
    masks = np.array([sum(1 << i for i in c) for r in radii for c in combinations(range(BITS), r)], dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                fp = batch.column(0)[a : a + 256].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, len(masks))), pa.array((fp[:, None] ^ masks).ravel())], ["fp", "point"])

    return rows.select("fp").mapInArrow(run, "fp long, point long")


def _around(members: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of all that lie within a radius of one point to the least of them."""
    at = _flips(members, *range(radius + 1))
    least = at.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    return at.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def _between(near: DataFrame, far: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints of near and far at twice the radius and one bit. They meet at a point as far as
    the radius from the one and a bit more from the other; of the near ones, which are linked with each other, the least
    stands for all."""
    points = _flips(near, radius).groupBy("point").agg(F.min("fp").alias("a"))
    return _flips(far, radius + 1).join(points, "point").select("a", F.col("fp").alias("b")).distinct()


def link_prints(prints: DataFrame, ring: Ring = Ring(), bound: int = 500_000) -> DataFrame:
    """(node, component): the least fingerprint that links reach from each linked one; prints: distinct fp."""
    met = _met(prints, ring, bound)
    pull = met.groupBy("fp").agg(F.sum("crowd").alias("pull"))
    heads = met.join(pull, "fp").groupBy("at", "part").agg(F.max_by("fp", F.struct("pull", "fp")).alias("head"))
    headed = written(met.join(heads, ["at", "part"]), "simhash_headed")
    links = written(headed.where(F.col("fp") != F.col("head")).where(in_chain(F.col("fp"), F.col("head"), F.col("at"), ring)).select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct(), "simhash_links")
    at = components(links, "a", "b")
    rest = written(_open(headed.where(F.col("fp") != F.col("head")).select("at", "part", "fp"), at), "simhash_open")
    one = rest.where(F.col("others") * F.col("size") <= ring.dense)
    a = one.where("component <> main").select("at", "part", F.col("fp").alias("a"), F.col("component").alias("c"))
    b = one.select("at", "part", F.col("fp").alias("b"), F.col("component").alias("e"), "main")
    fits = (F.col("c") != F.col("e")) & ((F.col("e") == F.col("main")) | (F.col("a") < F.col("b"))) & in_chain(F.col("a"), F.col("b"), F.col("at"), ring)
    more = written(a.join(b, ["at", "part"]).where(fits).select("a", "b").distinct(), "simhash_more")
    every = links.unionByName(more)
    crowded = rest.where(F.col("others") * F.col("size") > ring.dense)
    if not crowded.isEmpty():
        dense = written(crowded.select("fp").distinct(), "simhash_dense")
        every = every.unionByName(written(_around(dense, ring.budget // 2), "simhash_around"))
        if ring.budget % 2:
            still = written(_open(crowded.select("at", "part", "fp"), components(every, "a", "b")), "simhash_still")
            far = written(still.where("component <> main").select("fp").distinct(), "simhash_far")
            if not far.isEmpty():
                every = every.unionByName(written(_between(still.select("fp").distinct(), far, ring.budget // 2), "simhash_between"))
    return components(every, "a", "b")


def link_documents(docs: DataFrame, ring: Ring = Ring(), words: int = 3, seed: int = 42, bound: int = 500_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach, of every row.

    Equal fingerprints are linked, also those of rows without words or text, which are 0. Rows with a null doc_id are
    linked like others; the least id skips nulls, and is null where a component has no other. Repeated rows are repeated.
    """
    rows = written(fingerprints(docs, words, seed), "simhash_rows")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "simhash_prints")
    at = written(link_prints(prints.select("fp"), ring, bound), "simhash_components")
    known = prints.join(at.select(F.col("node").alias("fp"), "component"), "fp", "left").where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "fp"))
    known = written(known, "simhash_known")
    named = known.join(known.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("fp", "component_id", F.lit(True).alias("linked"))
    named = written(named, "simhash_named")
    out = rows.join(sized_broadcast(named, named.count(), bound), "fp", "left")
    own = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"))

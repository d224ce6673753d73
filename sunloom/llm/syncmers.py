"""Document fingerprints from closed syncmers.

A k-byte window of the UTF-8 text is an anchor if the least hash among its inner s-byte windows lies at its first or
last place. Whether a window is one depends on nothing outside it, so an edit moves or removes only anchors that touch
it. A fingerprint lists hash and place of the anchors of a sampling level; two are compared along a chain of common
anchors whose places rise in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Bytes of a window and of an inner window, and the anchors that a fingerprint aims at, at most twice that on average.
K, S, ANCHORS = 24, 8, 96
_MULT, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _hashes(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of S bytes and of `size` = 3 * S bytes, by doubling."""
    h, width, power = raw.astype(np.uint64) + np.uint64(1), 1, _MULT
    while width < S:
        h, width, power = h[:-width] * np.uint64(power) + h[width:], 2 * width, power * power & _ALL
    mult = np.uint64(power)
    inner = h ^ (h >> np.uint64(29))
    inner *= _MIX
    inner ^= inner >> np.uint64(32)
    outer = (h[: len(h) - 2 * S] * mult + h[S : len(h) - S]) * mult + h[2 * S :]
    outer = (outer ^ (outer >> np.uint64(31))) * _MIX
    return inner, outer ^ (outer >> np.uint64(33))


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    low, have = h, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every closed syncmer of a text; none if it is shorter than K bytes."""
    if len(raw) < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner, outer = _hashes(np.frombuffer(raw, dtype=np.uint8), K)
    width = K - S + 1
    least = _sliding_least(inner, width)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    return outer[at], at


def fingerprint(raw: bytes, aim: int | None = ANCHORS) -> tuple[int, np.ndarray, np.ndarray]:
    """(level, hashes, places): the anchors whose hash ends in `level` zero bits, level rising with the number of distinct
    hashes, as far as anchors stay. Of a hash that repeats, every place is listed. aim None: all anchors stay."""
    h, at = anchors(raw)
    distinct = np.unique(h)
    level = max(0, (len(distinct) // aim).bit_length() - 1) if aim and len(distinct) > 2 * aim else 0
    while level and (distinct & np.uint64((1 << level) - 1)).all():
        level -= 1
    if level:
        keep = (h & np.uint64((1 << level) - 1)) == 0
        h, at = h[keep], at[keep]
    if not len(h):  # too short or too plain for anchors: the text as a whole is one
        whole = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        return 0, np.array([whole], np.uint64), np.array([0])
    return level, h, at


def written_out(f: tuple[int, np.ndarray, np.ndarray]) -> str:
    level, h, at = f
    return f"{level}:" + ";".join(f"{x:x}@{p:x}" for x, p in zip(h.tolist(), at.tolist(), strict=True))


def parsed(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """A fingerprint from its written form."""
    level, _, rest = text.partition(":")
    pairs = [x.split("@") for x in rest.split(";")]
    return int(level), np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p, 16) for _, p in pairs])


def _chain(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence: equal ends are cut off, then a bit for each place of b, a step of a at a
    time, so that a hash that repeats costs no more than others."""
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(a) & set(b)
    b = [x for x in b if x in both]
    at: dict[int, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    left = full
    for x in a:
        if x in both:
            hit = left & at[x]
            left = (left + hit | left - hit) & full
    return head + tail + len(b) - left.bit_count()


def likeness(a: tuple, b: tuple) -> float:
    """Anchors on the longest chain that rises in both texts, over the larger number of anchors; 1 for equal texts.

    Levels are brought to the higher one first. Of a hash that repeats, every place counts.
    """
    level = max(a[0], b[0])
    mask = np.uint64((1 << level) - 1)
    ha, hb = (h if lv == level else h[(h & mask) == 0] for lv, h, _ in (a, b))
    if not len(ha) or not len(hb):
        return 0.0
    if len(ha) == len(hb) and np.array_equal(ha, hb):
        return 1.0
    return _chain(ha.tolist(), hb.tolist()) / max(len(ha), len(hb))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame, parts: int | None = None, aim: int | None = ANCHORS) -> DataFrame:
    """Every text, its edited text and its successor by doc_id, fingerprinted and compared.

    Documents are cut into ranges of doc_id at quantiles; the first of each range goes to the range before it too
    (that of the first range to the last), so each range is worked through alone and in order. A null text is empty,
    a null doc_id comes before all; rows of one doc_id stand in the order of their text's hash. A lone document
    follows itself. The texts are shuffled once. Fingerprints sample the anchors by the last bits of their hashes, down to
    about `aim` to 2 * aim, and equal likenesses come of the written fingerprints; with aim None they hold all anchors.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = rows.agg(F.percentile_approx("id", [k / parts for k in range(parts)], 20 * parts).alias("q"), F.min("id").alias("lo")).first()
    starts = np.array(sorted({*(got.q or ()), *([] if got.lo is None else [got.lo])}), dtype=np.int64)
    n = max(1, len(starts))

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, ids.to_numpy(), side="right") - 1
        first = starts[np.maximum(at, 0)] == ids.to_numpy()
        return pd.Series([[k, (k - 1) % n] if f else [k] for k, f in zip(at.tolist(), first.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last document, which waits for its successor
        done: list[tuple] = []

        def pair(doc: tuple, nxt: tuple) -> tuple:
            text, cut = doc[3], len(doc[3]) // 4
            edited = text[: len(text) - cut] + nxt[3][:cut]
            raw = edited.encode()
            f = fingerprint(raw, aim)
            return (None if doc[4] else doc[1], len(text), hashlib.sha256(raw).hexdigest(), written_out(doc[5]), written_out(f), likeness(doc[5], f), likeness(doc[5], nxt[5]))

        for batch in batches:
            for rng, i, halo, text, no_id in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                doc = (rng, i, halo, text, no_id, fingerprint(text.encode(), aim))
                if held is not None and not held[2] and held[0] == rng:
                    done.append(pair(held, doc))
                if held is None or held[0] != rng or not held[2]:
                    held = doc
            cols = list(zip(*done, strict=True)) or [()] * 7
            done = []
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split(" ")[0] for c in OUT.split(", ")])

    bound_batches(spark)
    dealt = rows.select("*", F.posexplode(ranges("id")).alias("halo", "range"))
    dealt = dealt.select("range", "id", (F.col("halo") == 1).alias("halo"), "text", "no_id").repartition("range").sortWithinPartitions("range", "halo", "id", F.xxhash64("text"))
    return dealt.mapInArrow(run, OUT)

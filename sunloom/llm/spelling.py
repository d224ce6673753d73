"""Spelling variants by a dictionary of trie-node pairs.

The nodes of the trie of all words, and of that of the reversed words, are numbered. A word is at each of its places a
pair of a prefix node and a suffix node: two words that differ by one replaced code point share the pair that skips it,
and a word's pair that skips a code point is the pair at which the word without it is cut. So joins of integer pairs give
exactly the words that are one replaced, deleted or inserted code point apart, and never more than an alphabet of them
meets at a pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, sized_broadcast, written

#: Letters A-Z, a-z and U+00C0 to U+00FF of Latin-1, capitals A-Z made small; all else is a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_PRIME, _BASES = (1 << 61) - 1, (911_382_323_091, 1_972_663_717_877)


@dataclass(frozen=True)
class Spelling:
    """Words of at least `length` code points that occur `least` times; a form has `times` the occurrences of its variant.

    modulus: of the hash by which a document's word loses a code point; 0: never.
    """

    length: int = 6
    least: int = 5
    times: int = 5
    modulus: int = 199


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z made small, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(docs: DataFrame, spelling: Spelling = Spelling(), most: int = 4 << 20) -> DataFrame:
    """(word, n) of all documents. A null doc_id is an empty text in the hash that deletes code points; a repeated row
    counts as often as it occurs. A task sums the words that it holds, in at most about `most` bytes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs(text)).items():
                    if len(word) < spelling.length:
                        continue
                    if spelling.modulus:
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % spelling.modulus == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < spelling.length:
                                continue
                    if word not in held:
                        size += len(word) + 100
                    held[word] += n
                if size > most:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(words: DataFrame) -> DataFrame:
    """The pairs of each word: (id, n, skip, once, p, q, s, t). p, q name the prefix before a place and s, t the suffix
    after it; skip: one code point is left out between them, once: the first of equal ones in a row."""

    def ends(codes: list[int]) -> tuple[list[int], list[int]]:
        out = []
        for base in _BASES:
            h, line = 0, [0]
            for c in codes:
                h = (h * base + c) % _PRIME
                line.append(h)
            out.append(line)
        return out[0], out[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["id", "n", "skip", "once", "p", "q", "s", "t"], [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
        for batch in batches:
            rows: list[tuple] = []
            for i, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, k = [ord(c) + 1 for c in word], len(word)
                (p, q), (s, t) = ends(codes), ends(codes[::-1])
                for at in range(k + 1):
                    rows.append((i, n, False, False, p[at], q[at], s[k - at], t[k - at]))
                    if at < k:
                        rows.append((i, n, True, at == 0 or codes[at] != codes[at - 1], p[at], q[at], s[k - at - 1], t[k - at - 1]))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return words.select("id", "word", "n").mapInArrow(run, "id long, n long, skip boolean, once boolean, p long, q long, s long, t long")


def _numbered(places: DataFrame, first: str, second: str, name: str, bound: int) -> DataFrame:
    """places with the number of a trie node instead of its two hashes."""
    nodes = written(places.select(first, second).distinct().withColumn(name, F.monotonically_increasing_id()), f"spelling_{name}")
    return places.join(sized_broadcast(nodes, nodes.count(), bound), [first, second]).drop(first, second)


def near_words(words: DataFrame, bound: int = 300_000) -> DataFrame:
    """(id, near_id, near_n): every ordered pair of words that are one replaced, inserted or deleted code point apart,
    once. words: id, word, n, distinct words."""
    places = written(_places(words), "spelling_places")
    pairs = written(_numbered(_numbered(places, "p", "q", "prefix", bound), "s", "t", "suffix", bound), "spelling_pairs")
    skip, cut = pairs.where("skip"), pairs.where("NOT skip")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("prefix", "suffix", F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"))

    same = side(skip, "a").join(side(skip, "b"), ["prefix", "suffix"]).where("a_id <> b_id").select("a_id", "b_id", "b_n")
    drop = side(skip.where("once"), "a").join(side(cut, "b"), ["prefix", "suffix"])  # b is a without a code point
    both = same.unionByName(drop.select("a_id", "b_id", "b_n")).unionByName(drop.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.col("a_n").alias("b_n")))
    return both.toDF("id", "near_id", "near_n")


def _roots(forms: DataFrame, most_n: int, spelling: Spelling, bound: int) -> DataFrame:
    """(id, root): the last word that forms lead to, for words that have one. A form occurs `times` as often as its
    variant, so a way has at most so many steps as powers lie between the extremes; each round doubles it."""
    steps = max(1, ceil(log(max(most_n, 1) / spelling.least, spelling.times)) if most_n > spelling.least and spelling.times > 1 else 1)
    now = written(forms.select("id", F.col("form_id").alias("root")), "spelling_roots")
    for _ in range(ceil(log(steps + 1, 2))):
        on = now.select(F.col("id").alias("root"), F.col("root").alias("__next"))
        now = written(now.join(sized_broadcast(on, now.count(), bound), "root", "left").select("id", F.coalesce("__next", "root").alias("root")), "spelling_roots")
    return now


def group_variants(docs: DataFrame, spelling: Spelling = Spelling(), bound: int = 300_000) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) of every word of docs.

    A word's form is its near word of most occurrences, the first in code-point order of equals, if that occurs `times`
    as often as the word; root is where forms end. Empty or null texts have no words.
    """
    if spelling.times < 2:
        raise ValueError("times is 2 at least, so that forms end")
    counts = written(word_counts(docs, spelling).where((F.col("n") >= spelling.least) & (F.length("word") >= spelling.length)), "spelling_counts")
    # numbers in the order of code points, since strings are sorted by their bytes
    words = written(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling_words")
    near = near_words(words, bound).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_id").alias("id"))).alias("best"))
    known = written(words.drop("word").join(near, "id", "left").select("id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= spelling.times * F.col("n"), F.col("best.id")).alias("form_id")), "spelling_near")
    forms = known.where("form_id IS NOT NULL")
    most_n = words.agg(F.max("n")).first()[0] or 0
    n_forms = forms.count()
    roots = _roots(forms, most_n, spelling, bound)
    named = lambda name: words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))
    told = forms.select("id", "form_id").join(roots.withColumnRenamed("root", "root_id"), "id").join(named("form"), "form_id").join(named("root"), "root_id")
    told = told.join(words.select(F.col("id").alias("form_id"), F.col("n").alias("form_n")), "form_id").select("id", "form", "root", "form_n")
    told = written(told, "spelling_forms")
    out = words.join(known.select("id", "n_near"), "id").join(sized_broadcast(told, n_forms, bound), "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""SimHash links and spelling variants against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sunloom.llm import simhash, spelling

DOCS = "doc_id long, text string, lang string, component_id long, word string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], DOCS)


def plain_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64(" ".join(w[j : j + k]).encode(), seed=42).intdigest() for j in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reached(ids, links):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        at[q] = p
    return {i: root(i) for i in ids}


def test_simhash_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "ABC", "a b"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 30, 200, 600]))] for _ in range(30)]
    texts = [None, "", " \n\t", "one", "One", "one two", "one  two\x0b"]
    for _ in range(200):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    rows = [*enumerate(texts), (5, texts[5])]  # a repeated row
    want = {i: plain_print(t) for i, t in rows}
    ids = sorted(want)
    roots = least_reached(ids, [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 3])
    got = simhash.link_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{want[i]:016x}", roots[i]) for i in ids}


def test_simhash_of_rows_without_ids(spark):
    rows = [(None, "one two three"), (4, "one two three"), (2, "one two three"), (None, "alone here now"), (None, None)]
    got = sorted((r.doc_id is None, r.component_id or 0) for r in simhash.link_documents(docs_of(spark, rows)).collect())
    assert got == [(False, 2), (False, 2), (True, 0), (True, 0), (True, 2)]
    assert simhash.link_documents(docs_of(spark, [])).count() == 0


def test_very_long_text():
    text = " ".join(f"w{k % 977}" for k in range(300_000))
    assert simhash.fingerprint(text) == plain_print(text) == simhash.fingerprint(text, block=1000)


@pytest.mark.parametrize("ring", [simhash.Ring(3, 8), simhash.Ring(2, 4), simhash.Ring(4, 8), simhash.Ring(5, 16)])
def test_every_pair_in_budget_meets_in_a_chain(spark, ring):
    """Fingerprints in budget share a key whose chains are all within their shares."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, ring.budget + 3), replace=False)) for _ in a]
    pairs = spark.createDataFrame([(i, *(int(x) for x in np.array([p, p ^ np.uint64(f)], np.uint64).view(np.int64)), f.bit_count()) for i, (p, f) in enumerate(zip(a, flips, strict=True))], "i long, a long, b long, d int")
    x = pairs.select("i", "a", "b", "d", F.explode(simhash.chain_keys(F.col("a"), ring)).alias("k"))
    y = pairs.select("i", F.explode(simhash.chain_keys(F.col("b"), ring)).alias("k"))
    met = x.join(y, ["i", "k"]).where(simhash.in_chain(F.col("a"), F.col("b"), F.col("k.at"), ring))
    got = {r.i for r in met.select("i").distinct().collect()}
    assert got == {i for i, f in enumerate(flips) if f.bit_count() <= ring.budget}


@pytest.mark.parametrize("ring", [simhash.Ring(3, 8), simhash.Ring(3, 8, dense=2), simhash.Ring(2, 8, dense=2), simhash.Ring(5, 16, dense=2)])
def test_crowded_keys(spark, ring):
    """Near copies around a few points, with points that only others connect, linked as by all pairs."""
    rng = random.Random(ring.budget + ring.dense)
    found = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(70):
            y = x
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6])):
                y ^= 1 << b
            found.add(y)
        for k in range(0, 60, ring.budget):  # a path whose steps just fit
            x ^= sum(1 << (k + j) for j in range(ring.budget) if k + j < 64)
            found.add(x)
    signed = sorted(y - (1 << 64) if y >> 63 else y for y in found)
    links = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= ring.budget]
    roots = least_reached(signed, links)
    at = {r.node: r.component for r in simhash.link_prints(spark.createDataFrame([(x,) for x in signed], "fp long"), ring).collect()}
    assert {x: at.get(x, x) for x in signed} == roots


def plain_words(rows, s):
    n = {}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % s.modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= s.length and k >= s.least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("s", [spelling.Spelling(), spelling.Spelling(3, 2, 2, 7)])
def test_variants_by_brute_force(spark, s):
    rng = random.Random(s.length)
    roots_ = ["banana", "bananas", "aaaaaa", "aaaaaaa", "letter", "lettre", "garçonne", "naïveté", "straßenbahn", "x" * 40, "coffee", "ÀÉcoffee", "Ācoffee"]
    texts = []
    for _ in range(300):
        line = []
        for _ in range(12):
            w = rng.choice(roots_)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abß×÷e") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("etÿ") + w[k + 1 :]])
            line.append(rng.choice([w, w.upper(), w.title()]))
        texts.append(rng.choice([" ", "-", "1", "あ"]).join(line))
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (900, None), (901, ""), (902, "123 \U0001f600")]
    n = plain_words(rows, s)
    want = {}
    for w in n:
        around = [v for v in n if v != w and near(v, w)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        want[w] = (best if best is not None and n[best] >= s.times * n[w] else None, len(around))

    def root(w):
        while want[w][0] is not None:
            w = want[w][0]
        return w

    got = spelling.group_variants(docs_of(spark, rows).repartition(5), s).collect()
    assert len(got) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == {w: (f, root(w), n[w], k, n.get(f)) for w, (f, k) in want.items()}


def test_long_words_and_none(spark):
    long_ = "ab" * 20_000
    rows = [(i, f"{long_} {long_}x") for i in range(5)]
    got = {r.n: (r.word, r.n_near) for r in spelling.group_variants(docs_of(spark, rows), spelling.Spelling(modulus=0)).collect()}
    assert got[5][1] == 1
    assert spelling.group_variants(docs_of(spark, [])).count() == 0
    assert spelling.group_variants(docs_of(spark, [(1, None)])).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(docs_of(spark, []), spelling.Spelling(times=1))

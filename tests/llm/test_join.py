"""The Jaccard join against brute force, and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sunloom.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, join):
    up = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(up)) if x]
        k = min(join.words, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    at = {i: i for i in texts}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= join.percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                at[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 15, 30, 60, 150, 400]))] for _ in range(n // 4)]
    out = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t = t + passage
        if rng.random() < 0.3:
            t = t[: int(len(t) * rng.uniform(0.88, 1))] or t
        out.append((" ".join(t) if rng.random() < 0.9 else " \n".join(t).upper()))
    return out


@pytest.mark.parametrize("seed,words,percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 1, 80)])
def test_join_by_brute_force(spark, seed, words, percent):
    texts = dict(enumerate([None, "", " \n", *corpus(seed)]))
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS).withColumn("component_id", F.lit(5))
    join = jaccard.Join(words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs, join).collect()}
    assert got == brute(texts, join)
    kept = {r.doc_id for r in jaccard.keep_one(docs, join).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_linked_sets_share_a_key():
    """Any two linked sets meet in a key, whichever shingles count as common."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        join = jaccard.Join(3, percent)
        for n in (10, 25, 60, 130, 500, 1800):
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                b = a.copy()
                while True:
                    c = np.unique(np.concatenate([rng.permutation(b)[1:] if rng.random() < 0.5 else b, rng.integers(0, 1 << 63, int(rng.random() < 0.7), dtype=np.uint64)]))
                    both = len(np.intersect1d(a, c))
                    if 100 * both < percent * (len(a) + len(c) - both):
                        break
                    b = c
                common = np.sort(rng.permutation(a)[: int(rng.random() * n)])
                if len(a) != len(b) or (a != b).any():
                    assert np.intersect1d(jaccard.keys_of(a, join, common), jaccard.keys_of(b, join, common)).size


def test_join_of_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 0), (1, "a b c d", "en", "s", 0), (None, "a b c d", "en", "s", 0), (4, "a b c d", "x", "s", 0)], DOCS)
    rows = jaccard.link_documents(docs).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {1}
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect()) == ["1", "None"]
    assert jaccard.link_documents(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_links_through_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(100)]
    late, both = words[:96] + list("abcd"), list("efgh") + words[4:96] + list("abcd")
    texts = {1: " ".join(words), 2: " ".join(late), 3: " ".join(both)}
    want = brute(texts, jaccard.Join(3, 90))
    assert want[3][1] == 1 and brute({1: texts[1], 3: texts[3]}, jaccard.Join(3, 90))[3][1] == 3  # only 2 connects them
    docs = spark.createDataFrame([(None if k == 2 else k, t, "en", "s", 0) for k, t in texts.items()], DOCS)
    rows = jaccard.link_documents(docs, jaccard.Join(3, 90)).collect()
    assert sorted((r.n_shingles, r.component_id) for r in rows) == sorted(want.values())


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, quality = docs.columns, dict(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items()
        if name == "near_duplicates":
            want = brute(before, jaccard.Join(5, 80))
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        else:
            gone = set(before) - set(after)
            assert sum(quality.get(i, 0) for i in gone if len((before[i] or "").split()) >= 50) <= 1 + 0.02 * len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert {(r.doc_id, r.start) for r in corpus_pipeline.run(spark, d).collect()} == {(r.doc_id, r.start) for r in packed}

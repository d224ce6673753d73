"""No caps on what is learnt, and memory that does not grow with languages or with the length of chunks."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import bytebpe, classifier, jaccard, langid, quality, urls
from sunloom.llm.queries import vocabulary

LABELLED = "items array<string>, bad boolean"


def test_a_rule_of_five_tokens(spark):
    """Bad only where all five meet; any four of them are as often good."""
    rng, rows = random.Random(1), []
    five = [f"p:{c}" for c in "abcde"]
    for _ in range(40):
        rows.append((five, True))
        for gone in five:
            rows += [([x for x in five if x != gone] + [f"p:z{rng.randrange(9)}"], False)] * 2
    got = urls.mine_rules(spark.createDataFrame(rows, LABELLED)).collect()
    assert [sorted(r["items"]) for r in got] == [five]


def test_rules_where_most_urls_are_bad(spark):
    rows = [([f"h:{h}"], h < 2) for h in range(3) for _ in range(300)]
    got = urls.mine_rules(spark.createDataFrame(rows, LABELLED)).collect()
    assert sorted(r["items"][0] for r in got) == ["h:0", "h:1"]
    assert urls.least_share(1.0, 2.0) == 1.0 and urls.least_share(0.2, 2.0) == pytest.approx(1 / 3)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


def test_languages_of_one_id_or_without_text(spark):
    """A language whose rows share one id is learnt, one whose texts are null is not."""
    for one in (1, 4, 7, 100, 103):
        rows = [(k, f"alpha beta gamma {k}", "aa", "s", 1, 0.0) for k in range(2000)]
        rows += [(one, f"zzyx qqwv xxzz {k}", "zz", "s", 1, 0.0) for k in range(500)]
        rows += [(k, None, "nn", "s", 1, 0.0) for k in range(300)]
        df = docs(spark, rows)
        fold = df.where(F.col("lang") == "zz").select((langid.crc_of_id() % 4).alias("f")).first().f
        model = langid.train(df)
        assert model.langs == (["aa"] if fold == 2 else ["aa", "zz"])


def test_copies_of_one_text_are_a_language(spark):
    df = docs(spark, [(0, "same words here", "aa", "s", 1, 0.0)] * 3000 + [(k, f"other text {k}", "bb", "s", 1, 0.0) for k in range(3000)])
    assert langid.train(df, langid.Shape(per_language=50)).langs == ["aa", "bb"]


def test_distances_by_languages_one_at_a_time():
    """Equal to whole histograms over all languages' words."""
    rng = np.random.default_rng(3)
    p, q = rng.dirichlet(np.ones(30), 8), np.zeros((5, 30))
    for k in range(5):
        q[k, rng.choice(30, 7, replace=False)] = rng.dirichlet(np.ones(7))
    whole = quality.jensen_shannon(p, q)
    for k in range(5):
        at = np.flatnonzero(q[k])
        part = quality.jensen_shannon(p[:, at], q[k : k + 1, at], 1 - p[:, at].sum(axis=1))[:, 0]
        assert np.allclose(part, whole[:, k])


def test_a_hundred_languages(spark):
    rng = random.Random(0)
    refs = [(f"l{k}", np.full(len(quality.CLASSES) - 1, 1 / (len(quality.CLASSES) - 1)).tolist(), {f"w{k}_{i}": 1 / 64 for i in range(64)}) for k in range(100)]
    text = " ".join(f"w7_{rng.randrange(64)}" for _ in range(200))
    got = quality.judge(docs(spark, [(1, text, "x", "s", 1, 0.0), (2, "zz " * 60, "x", "s", 1, 0.0)]), references=refs).orderBy("doc_id").collect()
    assert got[0].word_distance < 0.4 and got[1].word_distance == 1.0


def test_long_chunks_are_not_remembered():
    bpe = bytebpe.ByteBpe(vocabulary("byte_bpe_50k.json"), max_chars=50_000)
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(3):  # warm
        bpe.encode("word " * 10)
    tracemalloc.start()
    for _ in range(30):
        text = "".join(rng.choices(letters, k=20_000)) + " short words here"
        ids, _ = bpe.encode(text)
        assert bpe.decode(ids).decode() == text
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 3_000_000
    assert all(len(c) <= 256 for c in [*bpe._chunks, *bpe._words, *bpe._older])
    for k in range(20_000):
        bpe.encode(f"number{k} x{k}y")
    assert sum(map(len, bpe._chunks)) < 150_000


def test_long_words_are_not_remembered():
    h = classifier._Hasher(2048)
    words = [b"a" * 1000, b"short", b"a" * 1000]
    assert h(words)[0] == h(words)[2] and list(h.known) == [b"short"]
    jaccard.hash_word(b"q" * 500)
    assert b"q" * 500 not in jaccard._words

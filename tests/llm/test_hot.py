"""Keys that hold a large part of all rows: equal results, spread over tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import jaccard, tokenfile, urls
from sunloom.llm.queries import vocabulary

from test_join import DOCS, brute, corpus


def test_one_id_on_many_rows(spark, tmp_path):
    """Rows of one id, equal or not, are cut into several files, in one order."""
    n, texts = 100_000, ["same words", "other words here", None]
    docs = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(3, "first"), (None, "null id"), (9, "last")], "doc_id long, text string"))
    out = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tables so small become one part
    try:
        tokenfile.write_token_orc(docs, out, vocabulary("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = tokenfile.read_token_orc(spark, out).groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("part").collect()
    assert sum(p.n for p in parts) == n + 3 and len(parts) >= 4 and max(p.n for p in parts) < n / 2
    assert all(a.hi is None or a.hi <= b.lo for a, b in zip(parts, parts[1:], strict=False))
    got = tokenfile.token_digests(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in got[:2]] == [None, 3] and got[-1].doc_id == 9
    lengths = np.array([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *np.cumsum(lengths)[:-1].tolist()]
    assert len({r.ids_crc32 for r in got[2:-1]}) == 3


def test_hot_urls(spark):
    """A null url and a blocked one, a third of all rows each, get the verdict that each row gets alone."""
    n = 4000
    pages = [(k, None if k % 3 == 0 else "http://bad.test/x" if k % 3 == 1 else f"http://{'bad' if k % 2 else 'good'}.test/p{k}/q") for k in range(n)]
    labels = [(k, int(not (u or "").startswith("http://bad"))) for k, u in pages if k % 4 == 0]
    df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in urls.judge_urls(df, known, rules=()).collect()}
    assert got == {k: "block" if (u or "").startswith("http://bad") else "allow" for k, u in pages}
    one = spark.createDataFrame([(None, "http://bad.test/x"), (None, None), (5, "http://good.test/"), (5, "http://good.test/")], df.schema)
    got = sorted((str(r.page_id), r.host, r.verdict) for r in urls.judge_urls(one, known, rules=()).collect())
    assert got == [("5", "good.test", "allow"), ("5", "good.test", "allow"), ("None", "", "allow"), ("None", "bad.test", "allow")]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_an_open_key(spark, block):
    """Texts around few bases, in components that meet in the same keys, whatever part of them meets in a task."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    texts = dict(enumerate(corpus(5, 120)))
    base = [rng.choice(words) for _ in range(120)]
    for k in range(200, 300):
        t = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts[k] = " ".join(t)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs, jaccard.Join(3, 90), block=block).collect()}
    assert got == brute(texts, jaccard.Join(3, 90))


def test_common_shingles_count_as_shared():
    """Rare and common ones together are the least shingles, whichever are common."""
    rng = np.random.default_rng(4)
    join = jaccard.Join(3, 90)
    for n in (12, 60, 400):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.5, 0.97, 1.0):
            common = h[rng.random(n) < share]
            rare, sure = jaccard.least_shingles(h, join, common)
            assert len(rare) + sure == join.least(n) and not np.isin(rare, common).any()
            assert sure == max(0, join.least(n) - (n - len(common)))

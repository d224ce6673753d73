"""Every operator on null ids and texts, repeated rows, a very long text, clashing columns, and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sunloom.llm import bytebpe, classifier, jaccard, langid, packing, quality, sharding, simhash, spelling, syncmers, tokenfile, urls
from sunloom.llm.common import shared_dir
from sunloom.llm.queries import vocabulary

#: Columns that operators might use themselves.
EXTRA = "ids n size level rep score bits lang_pred draw place word key component component_id items fp start shard h law slot tokens text_crc32 sequence_id piece".split()
RNG = random.Random(8)
LONG = " ".join(RNG.choice(["alpha", "beta", "gamma", "delta,", "Über", "x" * 300]) for _ in range(60_000))
TEXTS = [(1, "plain words of a text"), (2, None), (3, ""), (4, LONG), (4, LONG), (5, "same here"), (5, "same here"), (None, "no id at all"), (None, None), (6, " \n\t"), (7, "plain words of a text")]


def table(spark, rows):
    df = spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "s", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in EXTRA})


def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2 if i else None, 0) for i, _ in rows if i is not None] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


def token_orc(docs):
    path = f"{shared_dir(docs.sparkSession)}/edge-orc-{RNG.random()}"
    tokenfile.write_token_orc(docs, path, vocabulary("word_bpe_49k.json"), 2)
    return tokenfile.token_digests(docs.sparkSession, path)


OPERATORS = {
    "op1": lambda docs, _: sharding.shard_documents(docs, 24),
    "op3": lambda docs, _: quality.judge(docs),
    "op4": lambda docs, _: token_orc(docs),
    "op5": lambda docs, _: bytebpe.digest_documents(docs, vocabulary("byte_bpe_50k.json")),
    "op6": lambda docs, lab: classifier.score_documents(docs, classifier.train(docs, lab)),
    "op7": lambda docs, _: syncmers.fingerprint_pairs(docs),
    "op9": lambda docs, _: langid.predict(docs, langid.train(docs)),
    "op10": lambda docs, _: jaccard.link_documents(docs),
    "op12": lambda docs, _: simhash.link_documents(docs),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(spark, name):
    got = OPERATORS[name](table(spark, TEXTS).repartition(3), labels(spark, TEXTS)).toPandas()
    assert sorted(got.doc_id.fillna(-1)) == sorted(-1 if i is None else i for i, _ in TEXTS)
    rest = [c for c in got.columns if c not in ("doc_id", "start", "slot", "near_next", "edited_sha256", "edited_fingerprint", "near_edited")]
    for i in (4, 5):  # repeated rows are judged alike
        same = got[got.doc_id == i][rest].astype(str)
        assert len(same) == 2 and (same.iloc[0] == same.iloc[1]).all()
    assert OPERATORS[name](table(spark, []), labels(spark, [])).count() == 0


def test_pieces_cover_every_row(spark):
    pieces = packing.pack_documents(table(spark, TEXTS), vocabulary("word_bpe_49k.json"), 2, 4096).toPandas()
    whole = pieces.groupby("sequence_id").length.sum()
    assert (whole <= 4096).all() and pieces.length.sum() == sum(g.doc_tokens.iloc[0] * (len(TEXTS) and round(g.length.sum() / g.doc_tokens.iloc[0])) for _, g in pieces.groupby(pieces.doc_id.fillna(-1).astype(str) + "-" + pieces.doc_tokens.astype(str)))
    assert packing.pack_documents(table(spark, []), vocabulary("word_bpe_49k.json"), 2, 4096).count() == 0


def test_urls_of_any_kind(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://A.com/en/x"), (3, ""), (4, "://"), (5, "http://h/" + "a/" * 50_000), (6, "http://x.net/de/1?q")], "page_id long, url string").withColumns({c: F.lit("z") for c in ("html", "items", "rare", "host", "bad", "needs", "rule")})
    got = urls.judge_urls(pages, labels(spark, TEXTS)).collect()
    assert len(got) == 7 and {(r.page_id, r.host, r["rule"], r.verdict) for r in got if r["rule"]} == {(None, "a.com", "com/en/", "block"), (6, "x.net", "net/de/", "allow")}
    assert urls.judge_urls(pages.where("page_id = 99"), labels(spark, [])).count() == 0


def test_words_of_any_rows(spark):
    got = {r.word: r.n for r in spelling.group_variants(table(spark, TEXTS), spelling.Spelling(least=1, modulus=0)).collect()}
    assert got["xxxxxx"[:5] + "x" * 295] == 2 * LONG.count("x" * 300) and "plain" not in got


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 0
    assert corpus_pipeline.quality_rules(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 0
    assert classifier.keep_good(docs, classifier.train(docs, labels(spark, []))).count() == 0

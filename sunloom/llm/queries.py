"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, classifier, jaccard, langid, packing, quality, sharding, simhash, spelling, syncmers, tokenfile, urls, whitening
from .common import documents, shared_dir
from .sql import ORACLE_SQL

#: DuckDB has no models, codecs and hashes of the queries without SQL; they are tested against brute force.
__all__ = ["ORACLE_SQL", "QUERIES"]

END_ID, ROOM, SHARDS = 2, 4096, 24


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS)


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), END_ID, ROOM)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token_orc-{uuid.uuid4().hex}"
    tokenfile.write_token_orc(documents(spark, sf_dir), out, vocabulary("word_bpe_49k.json"), END_ID)
    return tokenfile.token_digests(spark, out)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digest_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classifier.score_documents(docs, classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_pairs(documents(spark, sf_dir))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(documents(spark, sf_dir), jaccard.Join(3, 90))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.on_grid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitening.whiten(rows, whitening.fit(rows, 16))


def op12_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(documents(spark, sf_dir), simhash.Ring(3, 8))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_shard_documents,
        op2_pack_documents,
        op3_quality_rules,
        op4_token_orc,
        op5_byte_bpe,
        op6_quality_classifier,
        op7_syncmer_fingerprints,
        op8_url_rules,
        op9_language_id,
        op10_jaccard_join,
        op11_whitening,
        op12_simhash_links,
        op13_spelling_variants,
    )
}


"""Training-data queries against their DuckDB SQL, and shards against a plain search for the least capacity."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunloom.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, D).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine) == len(theirs) > 0
    columns, key = sorted(mine.columns), mine.columns[0]
    mine, theirs = (x[columns].sort_values(key).reset_index(drop=True).astype(object).where(lambda v: v.notna(), None) for x in (mine, theirs))
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)


def test_shards_have_the_least_capacity(spark):
    """Groups in hash order, and the least capacity over all capacities that a plain walk can keep."""
    got = QUERIES["op1_shard_documents"](spark, D)
    text = F.coalesce("text", F.lit(""))
    names = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", F.xxhash64(text).alias("h"))
    rows = got.join(names, "doc_id").groupBy(F.xxhash64("h", "text_crc32", "size").alias("o")).agg(F.sum("size").alias("s"), F.min("shard").alias("a"), F.max("shard").alias("b")).orderBy("o").collect()
    assert all(r.a == r.b for r in rows) and [r.a for r in rows] == sorted(r.a for r in rows)

    def needed(capacity):
        shards, used = 1, 0
        for r in rows:
            shards, used = (shards, used + r.s) if used + r.s <= capacity else (shards + 1, r.s)
        return shards

    low, high = max(r.s for r in rows), sum(r.s for r in rows)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= 24 else (mid + 1, high)
    assert max(r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()) == low
    slots = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.k == r.m + 1 for r in slots)

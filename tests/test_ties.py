"""Queries and their SQL on rows that leave sums and ranges to chance or state them apart."""

import random
from datetime import datetime, timedelta

import duckdb

from sunloom.queries import ORACLE_SQL, QUERIES


def sql(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.sql(f"create view {t} as select * from '{path}/*.parquet'")
    return con.execute(ORACLE_SQL[name]).fetchall()


def test_bands_whose_mean_lies_halfway_round_up(spark, tmp_path):
    rng, rows = random.Random(5), []
    for supp in range(60):
        cents = [4] * 19 + [5]
        for _ in range(30):  # 81 hundredths in 20 rows
            i, j = rng.sample(range(20), 2)
            if cents[i] < 8 and cents[j] > 0:
                cents[i], cents[j] = cents[i] + 1, cents[j] - 1
        rows += [(supp, 1, c / 100) for c in cents]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_tax double").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["s6_upsert_hists"](spark, str(tmp_path)).collect()}
    assert got == set(sql("s6_upsert_hists", lineitem=f"{tmp_path}/lineitem.parquet"))
    assert {b for i, _, b, n in got if i % 3 == 0} == {0.051}


def test_weights_beyond_one_have_no_bin(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=k), 0, "view", v) for k, v in enumerate([0.0, 10.0, 500.0, 560.0, 499.0, 1.0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["a26_weight_hist"](spark, str(tmp_path)).collect()}
    assert got == set(sql("a26_weight_hist", events=f"{tmp_path}/events.parquet"))
    assert (0, 2) in got and (24, 2) in got and sum(n for _, n in got) == 4

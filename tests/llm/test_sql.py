"""Queries that SQL can express, against DuckDB."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from lawspark.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)

    def rows(df):
        return Counter(tuple(None if pd.isna(v) else v for v in r) for r in df[names].astype(object).itertuples(index=False, name=None))

    assert rows(got) == rows(want)


def test_vectors_that_link(spark, tmp_path):
    """The given small tables have no pair near enough: clusters, equal and odd vectors of a table of our own."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    near = [b + 0.12 * rng.standard_normal(64) for b in base for _ in range(4)]
    rows = [(k, v.tolist()) for k, v in enumerate([*base, *near])] + [(1000, None), (1001, [0.0] * 64), (1002, base[0].tolist()), (1002, base[0].tolist()), (None, base[1].tolist()), (1003, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = c.execute(ORACLE_SQL["op9_near_vectors"]).df()
    assert want.n_links.sum() > 300
    same(QUERIES["op9_near_vectors"](spark, str(tmp_path)).toPandas(), want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_duckdb(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    same(QUERIES[name](spark, sf).toPandas(), c.execute(ORACLE_SQL[name]).df())

"""Every grammar query gives the rows of its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from pegspark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, tables, name):
    got = queries.QUERIES[name](spark, tables).toPandas()
    want = duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "hit", "hit_text"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

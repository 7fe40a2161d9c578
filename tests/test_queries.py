"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [q for q in __spark_entry__.oracle_sql() if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0

"""Registered queries against their oracles, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltline.operators.ranking import distributed_rank
from siltline.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_distributed_rank(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("string").alias("g"), (F.col("id") * 7919 % 501).alias("x"), F.lit(2).alias("n"))
    got = {(r["g"], r["x"], r["rank"]) for r in distributed_rank(df.groupBy("g", "x").agg(F.sum("n").alias("n")), ["g"], [F.col("x").desc()], "n").collect()}
    rows = [(r["g"], r["x"]) for r in df.collect() for _ in range(2)]
    assert got == {(g, x, 1 + sum(1 for a, b in rows if a == g and b > x)) for g, x in set(rows)}

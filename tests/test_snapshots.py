"""Snapshot changes against brute force, and the edge cases of the docstring."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltline.operators.snapshots import baseline_changes, snapshot_changes

SCHEMA = "repo string, snapshot_no int, taken_at timestamp, rule_id string, file string, fingerprint string, line int, title string, note string, loaded_at timestamp"
T0 = datetime(2025, 1, 1)


def brute(rows):
    latest = {}
    for r in sorted(rows, key=lambda r: r[9]):
        latest[r[0], r[1], r[5].lower() if r[5] else None] = (r[3], r[4].replace("\\", "/") if r[4] else None, r[6], r[7], r[8])
    out = set()
    for repo in {k[0] for k in latest}:
        numbers = sorted({k[1] for k in latest if k[0] == repo})
        for before, now in zip(numbers, numbers[1:]):
            old = {k[2]: v for k, v in latest.items() if k[:2] == (repo, before)}
            new = {k[2]: v for k, v in latest.items() if k[:2] == (repo, now)}
            out |= {(repo, now, f, "added") for f in new.keys() - old.keys()} | {(repo, now, f, "removed") for f in old.keys() - new.keys()}
            out |= {(repo, now, f, "changed") for f in new.keys() & old.keys() if new[f] != old[f]}
    return out


@pytest.mark.parametrize("chunk_rows", [1, 4, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, chunk_rows):
    rng = random.Random(seed)
    rows = []
    for repo, size in (("hot", 400), ("a", 30), (None, 20)):
        entries = {f"{rng.getrandbits(64):016x}": ["r1", "src/a.py", 1, "t", None] for _ in range(size)}
        for number in (1, 2, 4, 5):
            for f in rng.sample(sorted(entries), size // 10):
                del entries[f]
            for f in rng.sample(sorted(entries), size // 10):
                entries[f][rng.randrange(5)] = rng.choice([None, "x", "y\\z"]) if rng.random() < 0.9 else "q"
                entries[f][2] = rng.choice([None, 1, 2])
            for _ in range(size // 10):
                entries[f"{rng.getrandbits(64):016x}"] = ["r2", "b\\c.js", 2, "u", "n"]
            for f, v in entries.items():
                row = (repo, number, T0, v[0], v[1], f.upper() if rng.random() < 0.2 else f, v[2], v[3], v[4], T0 + timedelta(hours=number))
                rows += [row] * (2 if rng.random() < 0.05 else 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in baseline_changes(df, chunk_rows).collect()}
    assert got == brute(rows)


def test_nulls_and_versions(spark):
    rows = [("r", 1, None, None, None, None, None, None, None, None), ("r", 2, None, "x", None, None, None, None, None, None), ("r", None, None, "x", None, "f", None, None, None, None)]
    got = [tuple(r) for r in baseline_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [("r", 2, None, "changed")]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert baseline_changes(empty).count() == 0
    rows = [("r", 1, T0, "x", "a", "f1", 1, "t", None, T0), ("r", 2, T0, "x", "a", "f2", 1, "t", "n" * 100_000, T0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("_g", "_v", "_k", "key", "change", "_c", "_now")})
    assert sorted(tuple(r) for r in baseline_changes(df).collect()) == [("r", 2, "f1", "removed"), ("r", 2, "f2", "added")]


def test_conflicting_rows_of_a_key_take_the_latest(spark):
    rows = [("r", 1, T0, "x", "a", "f", 1, "t", None, T0), ("r", 2, T0, "y", "a", "f", 1, "t", None, T0), ("r", 2, T0, "x", "a", "F", 1, "t", None, T0 + timedelta(days=2))]
    assert baseline_changes(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_generic_columns(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "a", 6), (1, 2, "b", 1)], "g int, v int, k string, x int").withColumn("g", F.col("g").cast("string"))
    assert sorted(tuple(r) for r in snapshot_changes(df, "g", "v", "k", ["x"]).collect()) == [("1", 2, "a", "changed"), ("1", 2, "b", "added")]

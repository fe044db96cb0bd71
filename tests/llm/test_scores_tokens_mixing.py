"""Ideal-point ranking, tokenizer encoding and source mixing."""

import math
import os
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm import mixing, scores, tokens

needs_ranks = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/{tokens.BYTE_BPE_50K}"), reason="no rank files")
PATH = f"{tokens.FOLDER}/{tokens.BYTE_BPE_50K}"


def brute(rows, weights):
    """rows: group, key, scores; no winsorising, no nulls."""
    out = {}
    for g in {r[0] for r in rows}:
        part = [r for r in rows if r[0] == g]
        n = len(weights)
        norm = [math.sqrt(sum(r[2 + j] ** 2 for r in part)) or 1 for j in range(n)]
        v = {r[1]: [weights[j] / sum(weights) * r[2 + j] / norm[j] for j in range(n)] for r in part}
        best, worst = ([f(x[j] for x in v.values()) for j in range(n)] for f in (max, min))
        for k, x in v.items():
            up, down = math.dist(x, best), math.dist(x, worst)
            out[g, k] = round(down / (up + down), 9) if up + down else 0.5
    return out


def test_ranking_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, float(rng.randrange(5)), float(rng.randrange(101)), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double, c double").withColumns({x: F.lit(1) for x in ("_n", "rank", "closeness", "_x0", "_q0")})
    got = scores.ideal_point_ranking(df.drop("rank", "closeness"), ["g"], "k", {"a": 1.0, "b": 2.0, "c": 1.0}, tails=(0.0, 1.0)).collect()
    want = brute(rows, [1.0, 2.0, 1.0])
    assert len(got) == 300
    for r in got:
        assert r["closeness"] == pytest.approx(want[r["g"], r["k"]], abs=1e-8)
        assert r["rank"] == 1 + sum(1 for (g, _), c in want.items() if g == r["g"] and c > want[r["g"], r["k"]] + 1e-9)


def test_range_does_not_decide(spark):
    rows = [("g", i, float(i % 2), 1e9 * (i % 3), 0.001 * (i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double, c double")
    one = {r["k"]: r["rank"] for r in scores.ideal_point_ranking(df, ["g"], "k", {"a": 1.0, "b": 1.0, "c": 1.0}).collect()}
    two = {r["k"]: r["rank"] for r in scores.ideal_point_ranking(df.withColumn("b", F.col("b") / 1e12), ["g"], "k", {"a": 1.0, "b": 1.0, "c": 1.0}).collect()}
    assert one == two


def test_ranking_edges(spark):
    schema = "g string, k long, a double, b double"
    weights = {"a": 1.0, "b": 1.0}
    assert scores.ideal_point_ranking(spark.createDataFrame([], schema), ["g"], "k", weights).count() == 0
    rows = [("g", 1, None, None), ("g", 2, None, None), ("h", None, 1.0, 2.0)]
    got = scores.ideal_point_ranking(spark.createDataFrame(rows, schema), ["g"], "k", weights).collect()
    assert {(r["g"], r["closeness"], r["rank"]) for r in got} == {("g", 0.5, 1), ("h", 0.5, 1)} and len(got) == 3


def test_finding_scores(spark):
    t = datetime(2025, 1, 1)
    kind = "finding_id long, scan_id long, repo string, severity string, confidence int, ai struct<confidence:double>, loaded_at timestamp"
    rows = [(1, 1, "r", " High", 90, (0.5,), t), (1, 1, "r", " High", 90, (0.5,), t), (2, 1, "r", None, None, None, t), (3, 2, "r", "odd", 5, (70.0,), None), (4, 9, None, "low", 5, (None,), t)]
    scans = spark.createDataFrame([(1, "0.8"), (2, "0.9")], "scan_id long, tool_version string")
    got = {r["finding_id"]: (r["severity_level"], r["confidence"], r["ai_confidence"]) for r in scores.finding_scores(spark.createDataFrame(rows, kind), scans).collect()}
    assert got == {1: (3.0, 90.0, 50.0), 2: (None, None, None), 3: (None, 5.0, 70.0), 4: (1.0, 5.0, None)}


@needs_ranks
@settings(max_examples=150, deadline=None)
@given(st.text("ab1 '\n.é漢🙂sL", max_size=80))
def test_pieces_do_not_change_ids(text):
    whole = tokens.encoding(PATH).encode_ordinary(text)
    assert [i for p in tokens.pieces(text, 5) for i in tokens.encoding(PATH).encode_ordinary(p)] == whole
    assert tokens.decode_ids(whole, PATH) == text


@needs_ranks
def test_long_runs():
    plain = tokens.encoding(PATH).encode_ordinary
    for run in (" " * 300, "\n" * 300, " \n\t" * 100, "\u00a0 " * 150):
        for before, after in (("", ""), ("a", ""), ("", "b"), ("x.", "1"), ("é\n", "."), ("a", "'s"), ("\x1c", "\x1cz")):
            assert tokens.encode_text(before + run + after, PATH) == plain(before + run + after), (before, run[:3], after)
    for text in (" " * 300_000, "\n \t" * 100_000 + "x", "a" * 300_000, "漢" * 60_000, "!" * 300_000, "ab12" * 50_000):
        assert tokens.decode_ids(tokens.encode_text(text, PATH), PATH) == text


@needs_ranks
def test_encoding_table(spark):
    long = ("word's 12ab, " * 60_000) + "x" * 30_000
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, long), (5, long), (None, " \n\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "_text", "tokens")})
    got = tokens.encode_documents(df).collect()
    assert len(got) == 7
    by = {r["doc_id"]: list(r["ids"]) for r in got}
    assert by[2] == by[3] == [] and 50256 not in by[4]
    assert by[5] == tokens.encoding(PATH).encode_ordinary(long)
    assert all(r["same"] for r in tokens.roundtrip(df).collect())
    assert tokens.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert tokens.decode_ids(None, PATH) is None and tokens.decode_ids([220, 50255], PATH) is not None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50)), max_size=40), st.integers(0, 9))
def test_flight_keeps_count_and_size(units, seed):
    chance, size = [u[0] for u in units], [u[1] for u in units]
    out = mixing.flight(chance, size, random.Random(seed))
    assert sum(1 for p in out if 0 < p < 1 and 1e-9 < p < 1 - 1e-9) <= 2
    assert sum(out) == pytest.approx(sum(chance), abs=1e-6)
    assert sum(p * s for p, s in zip(out, size)) == pytest.approx(sum(p * s for p, s in zip(chance, size)), abs=1e-5)
    landed = mixing.landing(out, size)
    assert all(p in (0.0, 1.0) or p < 1e-8 or p > 1 - 1e-8 for p in landed)
    assert abs(sum(landed) - sum(chance)) <= 2 + 1e-6


@needs_ranks
def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 50)
    rng = random.Random(2)
    docs = [(i, rng.choice("aaab"), "word " * rng.randrange(1, 60)) for i in range(600)] + [(1000, "c", None), (1001, "c", ""), (1002, None, "x"), (0, "a", "word")]
    plans = [("p", "a", 3.0, 2), ("p", "b", 1.0, 5), ("p", "b", 1.0, 5), ("p", "c", 1.0, 1), ("p", "gone", 2.0, 1), ("q", "a", 0.0, 3), ("q", "b", 5.0, None), (None, "a", 1.0, 1), ("z", "a", None, 1)]
    df = spark.createDataFrame(docs[:-1], "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("tokens", "plan", "copies")})
    chosen, shares = mixing.mix(df, spark.createDataFrame(plans, "plan string, source string, weight double, max_repeats int"))
    rows = {(r["plan"], r["source"]): r for r in shares.collect()}
    assert abs(rows["p", "a"]["actual_share"] - 0.75) < 0.002 and abs(rows["p", "b"]["actual_share"] - 0.25) < 0.002
    assert rows["p", "gone"]["reachable_share"] == 0 and rows["p", "c"]["chosen_documents"] == 0 and rows["q", "a"]["chosen_documents"] == 0
    picked = chosen.collect()
    caps = {("p", "a"): 2, ("p", "b"): 5, ("q", "b"): 1}
    assert all(1 <= r["repeats"] <= caps[r["plan"], r["source"]] for r in picked if r["plan"])
    assert len({(r["plan"], r["doc_id"]) for r in picked}) == len(picked)
    again = mixing.mix(df, spark.createDataFrame(plans, "plan string, source string, weight double, max_repeats int"))[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, picked))


@needs_ranks
def test_mix_empty(spark):
    chosen, shares = mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([("p", "a", 1.0, 1)], "plan string, source string, weight double, max_repeats int"))
    assert chosen.count() == 0 and shares.first()["chosen_documents"] == 0

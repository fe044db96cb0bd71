"""Dewey labels and report tables."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.operators import nested

values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab[{\"", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b_c", "D"]), x, max_size=3), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(values)
def test_labels_are_unique_and_parents_exist(value):
    nodes = list(nested.label_nodes(value, frozenset(), lambda p: True))
    labels = [n[0] for n in nodes]
    assert len(set(labels)) == len(labels)
    for label in labels:
        assert label == "0" or label.rpartition(".")[0] in labels


def report(finding, place="findings"):
    return json.dumps({"findings": [finding]} if place == "findings" else {"result": {"findings": [finding]}} if place == "result" else {"scanners": {"x": {"findings": [finding]}}})


def children(spark, rows):
    df = spark.createDataFrame(rows, "scan_id long, report string").withColumns({c: F.lit(1) for c in ("dewey", "kind", "child", "_text")})
    return sorted(tuple(r) for r in nested.report_children(df).collect())


def test_shapes_of_lists(spark):
    rows = [
        (1, report({"findingId": "7", "taintPath": {"file": "a"}, "evidenceChain": "one", "aiAnalysis": {"attackPath": ["x", None, "y"]}})),
        (2, report({"finding_id": 8, "taint_path": json.dumps([{"file": "a"}, {"file": "b"}]), "evidence_chain": None, "ai_analysis": json.dumps({"attack_path": "z"})}, "result")),
        (3, report({"findingId": 9, "evidenceChain": [], "taintPath": [None, {"file": "c"}]}, "scanners")),
        (3, report({"findingId": 9, "evidenceChain": [], "taintPath": [None, {"file": "c"}]}, "scanners")),
        (4, '{"findings": [{"findingId": 1, "evidenceChain": ["a"'),
        (5, None), (6, ""), (7, "null"), (8, "[NaN]"), (None, report({"findingId": 3, "evidenceChain": ["a"]})),
    ]
    got = set(children(spark, [r for r in rows if r[0] is not None]))
    assert got == {(1, 7, "taint_step", 0), (1, 7, "evidence_step", 0), (1, 7, "attack_step", 0), (1, 7, "attack_step", 2), (2, 8, "taint_step", 0), (2, 8, "taint_step", 1), (2, 8, "attack_step", 0), (3, 9, "taint_step", 1)}
    assert children(spark, rows[-1:]) == [(None, 3, "evidence_step", 0)]


def test_empty_deep_and_long(spark):
    assert children(spark, []) == []
    assert children(spark, [(1, "[" * 100_000), (2, "[" * 100_000 + "]" * 100_000)]) == []
    long = report({"findingId": 1, "evidenceChain": ["x" * 500_000] * 3})
    assert len(children(spark, [(1, long)])) == 3


def test_tables_link_to_parents(spark):
    df = spark.createDataFrame([(1, report({"findingId": 7, "id": "R", "line": "12", "evidenceChain": ["a", "b"]}))], "scan_id long, report string")
    tables = nested.report_tables(df)
    finding = tables["findings"].first()
    assert (finding["finding_id"], finding["rule_id"], finding["line"], finding["dewey"], finding["parent_dewey"]) == (7, "R", 12, "0.0.0", "0")
    assert {r["finding_dewey"] for r in tables["steps"].collect()} == {"0.0.0"}
    assert tables["reports"].count() == 1


def test_only_declared_fields_are_unpacked(spark):
    title, note = "[1]", '{ "a":1}'
    text = report({"findingId": 7, "title": title, "note": note, "evidenceChain": ["[2]", json.dumps(json.dumps(["x"]))], "taintPath": [json.dumps({"file": "a"})]})
    df = spark.createDataFrame([(1, text)], "scan_id long, report string")
    nodes = {(r["schema_path"], r["kind"], r["value"]) for r in nested.report_nodes(df).collect()}
    assert ("$.findings[].title", "string", title) in nodes and ("$.findings[].note", "string", note) in nodes
    assert ("$.findings[].evidencechain[]", "string", "[2]") in nodes and not any(p.startswith("$.findings[].title[") for p, _, _ in nodes)
    assert ("$.findings[].taintpath[].file", "string", "a") in nodes
    deep = json.dumps(["end"])
    for _ in range(9):
        deep = json.dumps(deep)
    got = children(spark, [(1, report({"findingId": 7, "evidenceChain": deep}))])
    assert got == [(1, 7, "evidence_step", 0)]


def test_the_latest_delivery_counts(spark):
    old, new = report({"findingId": 7, "evidenceChain": ["a", "b", "c"]}), report({"findingId": 7, "evidenceChain": ["z"], "title": "t"})
    rows = [(1, "2025-01-02 00:00:00", new), (1, "2025-01-01 00:00:00", old), (1, "2025-01-02 00:00:00", new), (2, None, old), (2, None, old)]
    df = spark.createDataFrame(rows, "scan_id long, received_at string, report string").withColumn("received_at", F.to_timestamp("received_at"))
    assert sorted(tuple(r) for r in nested.report_children(df).collect()) == [(1, 7, "evidence_step", 0)] + [(2, 7, "evidence_step", i) for i in range(3)]
    steps = nested.report_steps(df).where("scan_id = 1").collect()
    assert [(r["child_no"], r["value"]) for r in steps] == [(0, "z")]
    assert nested.report_nodes(df).where("schema_path = '$'").count() == 2


def test_any_schema_path_as_a_table(spark):
    df = spark.createDataFrame([("k", json.dumps({"orders": [{"no": 1, "to": {"city": "A"}, "items": [{"id": "x"}, {"id": "y"}]}, {"no": 2, "items": []}]}))], "key string, doc string")
    nodes = nested.shred(df, ["key"], "doc")
    orders = nested.table_of(nodes, ["key"], r"\$\.orders\[\]", {"no": r"\.no", "city": r"\.to\.city"}, 2)
    assert sorted((r["dewey"], r["parent_dewey"], r["no"], r["city"]) for r in orders.collect()) == [("0.0.0", "0", "1", "A"), ("0.0.1", "0", "2", None)]
    items = nested.table_of(nodes, ["key"], r"\$\.orders\[\]\.items\[\]", {"id": r"\.id"}, 2)
    assert sorted((r["dewey"], r["parent_dewey"], r["id"]) for r in items.collect()) == [("0.0.0.2.0", "0.0.0", "x"), ("0.0.0.2.1", "0.0.0", "y")]

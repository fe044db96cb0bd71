"""Classification, scores, baselines and projections of findings."""

import pytest
from pyspark.sql import functions as F

from siltline.operators import findings as O

SCHEMA = O.SCHEMA


def make(spark, *rows):
    fields = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMA)


def finding(**more):
    return {"rule_id": "SEC-001", "scanner": "sast", "category": "Security", "severity": "HIGH", "confidence": 90, "title": "t", "file": "a", "line": 1, "evidence": "e", "seq": 1} | more


@pytest.mark.parametrize(
    "row, kind",
    [
        (finding(category="Malware", rule_id="MAL-006", metadata={"threatIntelMatch": "x"}, confidence=10), "confirmed_malware"),
        (finding(category="Malware", rule_id="MAL-003", confidence=95), "confirmed_malware"),
        (finding(category="Malware", evidence_chain=["a", "b"], confidence=95), "confirmed_malware"),
        (finding(category="Suspicious", confidence=80), "potentially_malicious"),
        (finding(category="Malware Indicator", confidence=50), "suspicious"),
        (finding(confidence=20), "needs_review"),
        (finding(confidence=19), "clean"),
        (finding(confidence=None, category=None), "clean"),
        (finding(classification="clean", category="Malware", rule_id="MAL-003", confidence=99), "clean"),
    ],
)
def test_classify(spark, row, kind):
    assert O.classify(make(spark, row)).first()["classification"] == kind


@pytest.mark.parametrize(
    "rows, score, grade",
    [
        ([], None, None),
        ([finding(severity="CRITICAL", confidence=95), finding(line=2)], 47, "C"),
        ([finding(severity="CRITICAL", confidence=90), finding(severity="CRITICAL", confidence=95, rule_id="SEC-002")], 65, "D"),
        ([finding(severity="CRITICAL", confidence=95), finding(severity="CRITICAL", confidence=95, seq=2)], 33, "B"),
        ([finding(severity="INFO")], 0, "A"),
        ([finding(severity="CRITICAL", line=i) for i in range(9)], 100, "F"),
    ],
)
def test_risk_score(spark, rows, score, grade):
    row = O.risk_score(make(spark, *rows)).first()
    if rows:
        assert (row["score"], row["grade"]) == (score, grade)


def test_first_wins(spark):
    rows = [finding(category="Configuration", seq=9), finding(category="Malware Indicator", seq=2), finding(line=None, seq=5), finding(line=0, seq=4)]
    got = sorted((r["line"] or 0, r["seq"]) for r in O.dedup_first(make(spark, *rows)).collect())
    assert got == [(0, 4), (1, 2)]


def test_baseline(spark):
    df = make(spark, finding(), finding(line=2), finding(title=None, line=None))
    known = O.baseline_entries(df.where("line = 1")).withColumn("fingerprint", F.upper("fingerprint"))
    active, suppressed = O.apply_baseline(df, known)
    assert (active.count(), suppressed.count()) == (2, 1)


def test_summaries_gate_and_reports(spark):
    df = make(spark, finding(severity=" critical "), finding(category="Dependencies"), finding(category="Malware", classification="clean"), finding(severity=None))
    assert O.severity_summary(df).first().asDict() == {"critical": 1, "high": 2, "medium": 0, "low": 0, "info": 0, "total": 4}
    assert O.security_summary(df).first()["dependencies_high"] == 1
    assert O.classification_summary(df).first()["clean"] == 1
    assert O.gate(df, "critical").first()["failed"] is True
    assert O.gate(make(spark, finding(severity="LOW")), "medium").first()["failed"] is False
    assert O.report_rows(make(spark, finding(evidence=None))).first()["evidence"] == []
    assert O.sarif_results(make(spark, finding(line=0))).first()["startLine"] == 1
    assert len(O.model_candidates(make(spark, *[finding(seq=i) for i in range(20)])).collect()) == 15


@pytest.mark.parametrize("args, want", [({"placeholder": True}, 20), ({"test_file": True}, 63), ({"taint": True}, 100), ({"entropy": 5.0}, 100), ({"entropy": 2.0}, 70), ({"test_file": True, "entropy": 2.0}, 43)])
def test_adjusted_confidence(spark, args, want):
    columns = {k: F.lit(v) for k, v in args.items()}
    assert spark.range(1).select(O.adjusted_confidence(F.lit(90), **columns).alias("c")).first()["c"] == want

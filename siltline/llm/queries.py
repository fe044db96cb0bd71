"""Registered queries of the training-data operators, and oracles where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.llm import abuse, credentials, mixing, origin, parsing, scores, tokens
from siltline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda spark, d: parsing.parse_files(table(spark, d, "files")).where("not valid").select("file_id"),
    "p1_verdicts": lambda spark, d: parsing.parse_files(table(spark, d, "files")),
    "p1_rates": lambda spark, d: parsing.parse_rates(parsing.parse_files(table(spark, d, "files"))),
    "p2_found": lambda spark, d: origin.not_handwritten(table(spark, d, "files")),
    "p2_origins": lambda spark, d: origin.file_origins(table(spark, d, "files")),
    "p2_rates": lambda spark, d: origin.origin_rates(origin.file_origins(table(spark, d, "files"))),
    "p3_scan_ranking": lambda spark, d: scores.rank_findings(table(spark, d, "findings"), table(spark, d, "scans"), ["scan_id"]),
    "p3_repo_ranking": lambda spark, d: scores.rank_findings(table(spark, d, "findings"), table(spark, d, "scans"), ["repo"]),
    "p6_found": lambda spark, d: credentials.found_credentials(table(spark, d, "files"), table(spark, d, "findings")),
    "p6_scores": lambda spark, d: credentials.score_credentials(table(spark, d, "files"), table(spark, d, "findings")).drop("value"),
    "p6_redacted": lambda spark, d: credentials.redact_texts(table(spark, d, "files"), table(spark, d, "findings")),
    "p7_ids": lambda spark, d: tokens.encode_documents(table(spark, d, "documents")),
    "p7_roundtrip": lambda spark, d: tokens.roundtrip(table(spark, d, "documents")),
    "p7_source_tokens": lambda spark, d: tokens.encode_documents(table(spark, d, "documents"), keep=("source",), count=True)
    .groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens")),
    "p8_mix": lambda spark, d: mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0],
    "p8_shares": lambda spark, d: mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1],
    "p9_found": lambda spark, d: abuse.found_abuse(table(spark, d, "documents"), table(spark, d, "review_labels")),
    "p9_scores": lambda spark, d: abuse.score_documents(table(spark, d, "documents"), table(spark, d, "review_labels")),
    "p9_rates": lambda spark, d: abuse.abuse_rates(abuse.score_documents(table(spark, d, "documents"), table(spark, d, "review_labels"))),
}

_SCORES = """WITH f AS (SELECT finding_id, scan_id, repo, severity, confidence, ai.confidence AS c FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY loaded_at DESC) = 1),
v AS (SELECT f.*, tool_version FROM f LEFT JOIN (SELECT scan_id, max(tool_version) AS tool_version FROM scans GROUP BY scan_id) s USING (scan_id)),
u AS (SELECT tool_version, max(c) AS most FROM v GROUP BY tool_version),
s AS (SELECT finding_id, scan_id, repo, CASE lower(trim(severity)) WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 WHEN 'info' THEN 0.0 END::DOUBLE AS severity_level, confidence::DOUBLE AS confidence, round(CASE WHEN most <= 1.0 THEN c * 100 ELSE c END, 6) AS ai_confidence FROM v LEFT JOIN u ON v.tool_version IS NOT DISTINCT FROM u.tool_version),
q AS (SELECT quantile_disc(severity_level, [0.01, 0.5, 0.99]) AS a, quantile_disc(confidence, [0.01, 0.5, 0.99]) AS b, quantile_disc(ai_confidence, [0.01, 0.5, 0.99]) AS c FROM s),
x AS (SELECT s.*, greatest(a[1], least(a[3], coalesce(severity_level, a[2]))) AS x1, greatest(b[1], least(b[3], coalesce(confidence, b[2]))) AS x2, greatest(c[1], least(c[3], coalesce(ai_confidence, c[2]))) AS x3 FROM s, q),
n AS (SELECT *, sqrt(sum(x1 * x1) OVER g) * 3 AS l1, sqrt(sum(x2 * x2) OVER g) * 3 AS l2, sqrt(sum(x3 * x3) OVER g) * 3 AS l3, max(x1) OVER g AS b1, max(x2) OVER g AS b2, max(x3) OVER g AS b3, min(x1) OVER g AS w1, min(x2) OVER g AS w2, min(x3) OVER g AS w3 FROM x WINDOW g AS (PARTITION BY {g})),
d AS (SELECT *, sqrt(pow(CASE WHEN l1 > 0 THEN (x1 - b1) / l1 ELSE 0 END, 2) + pow(CASE WHEN l2 > 0 THEN (x2 - b2) / l2 ELSE 0 END, 2) + pow(CASE WHEN l3 > 0 THEN (x3 - b3) / l3 ELSE 0 END, 2)) AS best, sqrt(pow(CASE WHEN l1 > 0 THEN (x1 - w1) / l1 ELSE 0 END, 2) + pow(CASE WHEN l2 > 0 THEN (x2 - w2) / l2 ELSE 0 END, 2) + pow(CASE WHEN l3 > 0 THEN (x3 - w3) / l3 ELSE 0 END, 2)) AS worst FROM n),
e AS (SELECT *, round(CASE WHEN best + worst > 0 THEN worst / (best + worst) ELSE 0.5 END, 9) AS closeness FROM d)
SELECT {g}, finding_id, severity_level, confidence, ai_confidence, closeness, rank() OVER (PARTITION BY {g} ORDER BY closeness DESC) AS rank FROM e"""

ORACLES: dict[str, str] = {"p3_scan_ranking": _SCORES.replace("{g}", "scan_id"), "p3_repo_ranking": _SCORES.replace("{g}", "repo")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

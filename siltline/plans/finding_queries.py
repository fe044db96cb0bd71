"""Queries over the findings of scans: classes, scores, summaries, baselines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions.text import BLOCK_NOTE, KEY_BLOCK, MASKED_SHAPES, escape_html, mask_secret
from siltline.operators import findings as O
from siltline.plans.detection_queries import hidden_contacts, q
from siltline.session import table


def clean_findings(spark: SparkSession, d: str) -> DataFrame:
    """One row a finding (the delivery loaded last), severities in one spelling."""
    rows = table(spark, d, "findings")
    latest = F.max_by(F.struct(*[c for c in rows.columns if c not in ("finding_id", "loaded_at")]), "loaded_at").alias("f")
    return rows.groupBy("finding_id").agg(latest).select("finding_id", "f.*").withColumn("severity", F.upper(F.trim("severity")))


_F = "(SELECT * EXCLUDE (severity), upper(trim(severity)) AS severity FROM (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY loaded_at DESC) = 1))"
_MALWARE = "coalesce(category IN ('Malware', 'Malware Indicator'), false)"
_SUSPICIOUS = "coalesce(category = 'Suspicious', false)"
_SEVERAL = "(coalesce(len(evidence_chain), 0) >= 2 OR coalesce(len(behavior_categories), 0) >= 2)"
_SURE = "coalesce(confidence, 0)"
_CLASS = f"CASE WHEN {_MALWARE} AND ({_SEVERAL} OR coalesce(contains(rule_id, 'MAL-CHAIN') OR regexp_matches(rule_id, '(?:^|-)MAL-003$'), false)) AND {_SURE} >= 95 THEN 'confirmed_malware' WHEN ({_MALWARE} OR {_SUSPICIOUS}) AND ({_SEVERAL} OR {_SURE} >= 80) THEN 'potentially_malicious' WHEN {_MALWARE} OR {_SUSPICIOUS} THEN 'suspicious' WHEN {_SURE} >= 20 THEN 'needs_review' ELSE 'clean' END"
_LIKE = "coalesce(category IN ('Malware', 'Malware Indicator', 'Suspicious'), false)"
_KIND = f"coalesce(classification, CASE WHEN {_LIKE} THEN 'suspicious' ELSE 'needs_review' END)"
_ORDER = ["seq", "finding_id"]
_DEDUP = f"(SELECT * FROM {_F} QUALIFY row_number() OVER (PARTITION BY scan_id, rule_id, file, coalesce(line, 0) ORDER BY seq, finding_id) = 1)"
_PRINT = "sha256(coalesce(rule_id, '') || ':' || coalesce(file, '') || ':' || CAST(coalesce(line, 0) AS VARCHAR) || ':' || coalesce(title, ''))"


def _baseline(spark, d):
    """Entries to suppress: the fingerprints of all findings of category Secrets."""
    return O.baseline_entries(clean_findings(spark, d).where("category = 'Secrets'"))


def _split(part):
    return lambda s, d: O.apply_baseline(clean_findings(s, d), _baseline(s, d))[part].select("finding_id", "rule_id", "file", "line")


_KNOWN = f"(SELECT DISTINCT {_PRINT} AS fp FROM {_F} WHERE category = 'Secrets')"
_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END"


def counted(alias: str, condition: str) -> str:
    return f"count_if(coalesce({condition}, false)) AS {alias}"


QUERIES = {
    "classification": lambda s, d: O.classify(clean_findings(s, d).withColumn("classification", F.lit(None).cast("string"))).select("finding_id", "classification"),
    "classification_summary": lambda s, d: O.classification_summary(clean_findings(s, d), ["scan_id"]),
    "severity_summary": lambda s, d: O.severity_summary(clean_findings(s, d), ["scan_id"]),
    "security_summary": lambda s, d: O.security_summary(clean_findings(s, d), ["repo"]),
    "dedup_first_wins": lambda s, d: O.dedup_first(clean_findings(s, d), ["scan_id"], _ORDER).select("finding_id", "scan_id", "rule_id"),
    "risk_score": lambda s, d: O.risk_score(clean_findings(s, d), ["scan_id"], _ORDER).drop("explanation"),
    "score_explanation": lambda s, d: O.risk_score(clean_findings(s, d), ["scan_id"], _ORDER).select("scan_id", "explanation"),
    "fingerprint": lambda s, d: clean_findings(s, d).select("finding_id", O.fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("title")).alias("fingerprint")),
    "baseline_active": _split(0),
    "baseline_suppressed": _split(1),
    "ci_gate": lambda s, d: O.gate(clean_findings(s, d), "high", ["scan_id"]),
    "severity_threshold": lambda s, d: clean_findings(s, d).where(O.meets(F.col("severity"), "medium")).select("finding_id", O.severity_weight(F.col("severity")).alias("weight")),
    "severity_topk": lambda s, d: O.by_severity(clean_findings(s, d).withColumn("seq", F.col("finding_id"))).limit(50).select("finding_id", "severity"),
    "ai_candidates": lambda s, d: O.model_candidates(clean_findings(s, d), 15, ["scan_id"], _ORDER).select("scan_id", "finding_id", "rule_id", "severity", "evidence"),
    "json_projection": lambda s, d: O.report_rows(clean_findings(s, d).withColumn("seq", F.col("finding_id"))).select(F.col("seq").alias("finding_id"), "file", "severity", "confidence", "rule", "title", F.array_join("evidence", "|").alias("evidence"), F.array_join("detectors", "|").alias("detectors"), "recommendation"),
    "sarif_projection": lambda s, d: O.sarif_results(clean_findings(s, d).withColumn("seq", F.col("finding_id"))),
    "evidence_masked": lambda s, d: clean_findings(s, d).select("finding_id", mask_secret(F.col("evidence")).alias("masked"), escape_html(F.col("title")).alias("html_title")),
    "evidence_sanitized": lambda s, d: clean_findings(s, d).select("finding_id", O.sanitized(F.col("evidence")).alias("evidence")),
    "evidence_for_model": lambda s, d: clean_findings(s, d).select("finding_id", O.redact_for_model(F.col("evidence")).alias("evidence")),
    "adjusted_confidence": lambda s, d: clean_findings(s, d).select(
        "finding_id",
        O.adjusted_confidence(F.coalesce("confidence", F.lit(0)), placeholder=F.coalesce(F.col("title").contains("order"), F.lit(False)), test_file=F.coalesce(F.col("file").startswith("tests/"), F.lit(False)), taint=F.col("taint_path").isNotNull(), entropy=F.length("title") / 8.0).alias("confidence"),
    ),
}

# Masking by SQL: all matches of a shape, one after the other, are replaced by what they become.
_MASK = "CASE WHEN length({v}) = 0 THEN '[REDACTED]' WHEN length({t}) <= 8 THEN '***REDACTED***' ELSE {t}[1:least(4, length({t}) // 4)] || repeat('*', greatest(4, length({t}) - 2 * least(4, length({t}) // 4))) || right({t}, least(4, length({t}) // 4)) END"


def _masked(value: str) -> str:
    return _MASK.format(v=value, t=f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')")


def sanitized_steps(name: str, source: str, column: str) -> str:
    """Common table expressions that end in ``name``: all columns of the source, and the column as ``safe`` without secrets."""
    steps = [f"{name}_0 AS (SELECT *, regexp_replace({column}, {q(KEY_BLOCK)}, {q(BLOCK_NOTE)}, 'g') AS safe FROM {source})"]
    for i, (pattern, group, exact) in enumerate(MASKED_SHAPES, 1):
        shape = q(pattern if exact else "(?i)" + pattern)
        part = lambda n: f"regexp_extract(m, {shape}, {n})"
        new = _masked("m") if group == 0 else f"{part(1)} || {_masked(part(2))} || {part(3)}"
        steps.append(f"{name}_{i} AS (SELECT * REPLACE (CASE WHEN safe IS NULL THEN NULL ELSE list_reduce(list_prepend(safe, list_distinct(regexp_extract_all(safe, {shape}))), lambda s, m: replace(s, m, {new})) END AS safe) FROM {name}_{i - 1})")
    return ", ".join(steps) + f", {name} AS (SELECT * FROM {name}_{len(MASKED_SHAPES)})"


_SCORE = (
    f"WITH w AS (SELECT scan_id, category, severity, round(CASE severity WHEN 'CRITICAL' THEN 35.0 WHEN 'HIGH' THEN 15.0 WHEN 'MEDIUM' THEN 5.0 WHEN 'LOW' THEN 1.5 ELSE 0 END * greatest(0.3, {_SURE} / 100.0) * 1000) AS p FROM {_DEDUP}), "
    "g AS (SELECT scan_id, CAST(least(100, floor(sum(p) / 1000 + 0.5)) AS INTEGER) AS score, "
    + ", ".join(counted(f"n_{x.lower()}", f"severity = '{x}'") for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
    + ", count(*) AS findings, "
    + ", ".join([counted("dependencies", "category = 'Dependencies'"), counted("malware", _LIKE), counted("secrets", "category IN ('Secrets', 'Git History')"), counted("sast", "category = 'Security'"), counted("configuration", "category = 'Configuration'"), counted("permissions", "category = 'Permissions'")])
    + " FROM w GROUP BY scan_id) "
)
_GRADE = "CASE WHEN score > 80 THEN 'F' WHEN score > 60 THEN 'D' WHEN score > 35 THEN 'C' WHEN score > 15 THEN 'B' ELSE 'A' END"
_TAINT = "taint_path IS NOT NULL"

ORACLES = {
    "classification": f"SELECT finding_id, {_CLASS} AS classification FROM {_F}",
    "classification_summary": f"SELECT scan_id, "
    + ", ".join(counted(x, f"{_LIKE} AND {_KIND} = '{x}'") for x in ("confirmed_malware", "potentially_malicious", "suspicious"))
    + f", {counted('needs_review', f'({_LIKE} AND {_KIND} = ' + chr(39) + 'needs_review' + chr(39) + f') OR (NOT {_LIKE} AND {_KIND} <> ' + chr(39) + 'clean' + chr(39) + ')')}, count_if({_KIND} = 'clean') AS clean FROM {_F} GROUP BY scan_id",
    "severity_summary": "SELECT scan_id, " + ", ".join(counted(x.lower(), f"severity = '{x}'") for x in O.SEVERITY_WEIGHT) + f", count(*) AS total FROM {_F} GROUP BY scan_id",
    "security_summary": "SELECT repo, "
    + ", ".join([counted("dependencies", "category = 'Dependencies'"), counted("configuration", "category = 'Configuration'"), counted("permissions", "category = 'Permissions'"), counted("secrets", "category IN ('Secrets', 'Git History')"), counted("sast", "category = 'Security'")])
    + ", "
    + ", ".join(counted(f"dependencies_{x}", f"category = 'Dependencies' AND severity = '{x.upper()}'") for x in ("critical", "high", "medium", "low"))
    + f" FROM {_F} GROUP BY repo",
    "dedup_first_wins": f"SELECT finding_id, scan_id, rule_id FROM {_DEDUP}",
    "risk_score": _SCORE + f"SELECT *, {_GRADE} AS grade FROM g",
    "score_explanation": _SCORE
    + "SELECT scan_id, coalesce(nullif(concat_ws('; ', CASE WHEN n_critical > 0 THEN n_critical || ' critical: act at once' END, CASE WHEN n_high > 0 THEN n_high || ' high: easier to exploit' END, CASE WHEN n_medium > 0 THEN n_medium || ' medium' END, CASE WHEN score = 0 THEN 'nothing of weight found' END), ''), 'little risk') AS explanation FROM g",
    "fingerprint": f"SELECT finding_id, {_PRINT} AS fingerprint FROM {_F}",
    "baseline_active": f"SELECT finding_id, rule_id, file, line FROM {_F} WHERE {_PRINT} NOT IN (SELECT fp FROM {_KNOWN})",
    "baseline_suppressed": f"SELECT finding_id, rule_id, file, line FROM {_F} WHERE {_PRINT} IN (SELECT fp FROM {_KNOWN})",
    "ci_gate": f"SELECT scan_id, bool_or({_WEIGHT} >= 10) AS failed FROM {_F} GROUP BY scan_id",
    "severity_threshold": f"SELECT finding_id, {_WEIGHT} AS weight FROM {_F} WHERE {_WEIGHT} >= 3",
    "severity_topk": f"SELECT finding_id, severity FROM {_F} ORDER BY {_WEIGHT} DESC, finding_id LIMIT 50",
    "ai_candidates": f"WITH {sanitized_steps('x', _F, 'coalesce(redacted_evidence, evidence)')} SELECT scan_id, finding_id, rule_id, severity, coalesce({hidden_contacts('safe')}, '') AS evidence FROM x WHERE severity IN ('CRITICAL', 'HIGH') OR category IN ('Security', 'Malware') QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY seq, finding_id) <= 15",
    "json_projection": f"SELECT finding_id, file, lower(severity) AS severity, confidence, rule_id AS rule, title, CASE WHEN len(evidence_chain) > 0 THEN array_to_string(list_filter(evidence_chain, lambda x: x IS NOT NULL), '|') WHEN evidence IS NOT NULL THEN evidence ELSE '' END AS evidence, concat_ws('|', scanner, detection_method) AS detectors, coalesce(remediation, 'look at it in its context') AS recommendation FROM {_F}",
    "sarif_projection": f"WITH {sanitized_steps('x', _F, 'coalesce(redacted_evidence, evidence)')} SELECT finding_id AS seq, rule_id AS \"ruleId\", CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, title AS message, replace(file, '\\', '/') AS uri, CASE WHEN coalesce(line, 0) = 0 THEN 1 ELSE line END AS \"startLine\", CASE WHEN coalesce(col, 0) = 0 THEN 1 ELSE col END AS \"startColumn\", safe AS snippet FROM x",
    "evidence_masked": f"WITH t AS (SELECT finding_id, title, evidence, regexp_replace(evidence, '^\\s+|\\s+$', '', 'g') AS s FROM {_F}), e AS (SELECT *, length(s) AS n, least(4, length(s) // 4) AS k FROM t) SELECT finding_id, CASE WHEN coalesce(length(evidence), 0) = 0 THEN '[REDACTED]' WHEN n <= 8 THEN '***REDACTED***' ELSE s[1:k] || repeat('*', greatest(4, n - 2 * k)) || right(s, k) END AS masked, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html_title FROM e",
    "evidence_for_model": f"WITH {sanitized_steps('x', _F, 'evidence')} SELECT finding_id, coalesce({hidden_contacts('safe')}, '') AS evidence FROM x",
    "evidence_sanitized": f"WITH {sanitized_steps('x', _F, 'evidence')} SELECT finding_id, safe AS evidence FROM x",
    "adjusted_confidence": f"WITH a AS (SELECT finding_id, title, file, {_TAINT} AS taint, CASE WHEN coalesce(contains(title, 'order'), false) THEN least({_SURE}, 20) ELSE {_SURE} END AS c FROM {_F}), b AS (SELECT *, CASE WHEN coalesce(starts_with(file, 'tests/'), false) THEN CAST(floor(c * CAST(0.7 AS DOUBLE) + 0.5) AS INTEGER) ELSE c END AS c2 FROM a), t AS (SELECT *, CASE WHEN taint THEN least(100, c2 + 15) ELSE c2 END AS c3 FROM b) SELECT finding_id, CAST(greatest(0, least(100, CASE WHEN length(title) / 8.0 > 4.5 THEN least(100, c3 + 10) WHEN length(title) / 8.0 < 3.0 THEN greatest(20, c3 - 20) ELSE c3 END)) AS INTEGER) AS confidence FROM t",
}

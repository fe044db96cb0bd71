"""Operators on findings: classification, first-wins dedup, scores, summaries, baselines, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltline.functions.text import redact_for_model, sanitized

SCHEMA = (
    "rule_id string, scanner string, category string, severity string, confidence int, classification string, title string, file string, line int, col int, evidence string, "
    "redacted_evidence string, evidence_chain array<string>, behavior_categories array<string>, remediation string, cwe array<string>, detection_method string, "
    "taint_path array<struct<file:string,line:int,description:string,code_snippet:string>>, metadata map<string,string>, seq bigint"
)

# Order and weights of the severities, for thresholds and for the risk score.
SEVERITY_WEIGHT = {"CRITICAL": 25, "HIGH": 10, "MEDIUM": 3, "LOW": 1, "INFO": 0}
RISK_WEIGHT = {"CRITICAL": 35.0, "HIGH": 15.0, "MEDIUM": 5.0, "LOW": 1.5, "INFO": 0.0}
MALWARE_LIKE = ("Malware", "Malware Indicator", "Suspicious")


def _map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def severity_weight(severity: Column) -> Column:
    """0 for unknown and null severities."""
    return F.coalesce(F.try_element_at(_map(SEVERITY_WEIGHT), F.upper(F.trim(severity))), F.lit(0))


def meets(severity: Column, threshold: str) -> Column:
    return severity_weight(severity) >= SEVERITY_WEIGHT[threshold.upper()]


def classification(category: Column, confidence: Column, rule_id: Column, chain: Column, behaviours: Column, known_threat: Column) -> Column:
    """The class of a finding that has none yet; null inputs count as absent."""
    malware = F.coalesce(category.isin("Malware", "Malware Indicator"), F.lit(False))
    suspicious = F.coalesce(category == "Suspicious", F.lit(False))
    several = (F.coalesce(F.size(chain), F.lit(0)) >= 2) | (F.coalesce(F.size(behaviours), F.lit(0)) >= 2)
    certainty = F.coalesce(confidence, F.lit(0))
    signature = F.coalesce(rule_id.rlike("MAL-001|MAL-006"), F.lit(False)) & F.coalesce(known_threat, F.lit(False))
    strong = several | F.coalesce(rule_id.contains("MAL-CHAIN") | rule_id.rlike(r"(?:^|-)MAL-003$"), F.lit(False))
    return (
        F.when(signature | (malware & strong & (certainty >= 95)), "confirmed_malware")
        .when((malware | suspicious) & (several | (certainty >= 80)), "potentially_malicious")
        .when(malware | suspicious, "suspicious")
        .when(certainty >= 20, "needs_review")
        .otherwise("clean")
    )


def classify(findings: DataFrame) -> DataFrame:
    """Fills missing classifications only."""
    threat = F.coalesce(F.try_element_at(F.col("metadata"), F.lit("threatIntelMatch")).isNotNull(), F.lit(False))
    given = classification(F.col("category"), F.col("confidence"), F.col("rule_id"), F.col("evidence_chain"), F.col("behavior_categories"), threat)
    return findings.withColumn("classification", F.coalesce("classification", given))


def adjusted_confidence(confidence: Column, placeholder: Column | None = None, test_file: Column | None = None, taint: Column | None = None, entropy: Column | None = None) -> Column:
    """Placeholder at most 20, test files by 0.7, taint +15, high entropy +10, low entropy -20 down to 20; within 0..100."""
    out = confidence
    if placeholder is not None:
        out = F.when(placeholder, F.least(out, F.lit(20))).otherwise(out)
    if test_file is not None:
        out = F.when(test_file, F.floor(out * 0.7 + 0.5).cast("int")).otherwise(out)
    if taint is not None:
        out = F.when(taint, F.least(F.lit(100), out + 15)).otherwise(out)
    if entropy is not None:
        out = F.when(entropy > 4.5, F.least(F.lit(100), out + 10)).when(entropy < 3.0, F.greatest(F.lit(20), out - 20)).otherwise(out)
    return F.greatest(F.lit(0), F.least(F.lit(100), out)).cast("int")


def fingerprint(rule_id: Column, file: Column, line: Column, title: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", part(rule_id), part(file), F.coalesce(line, F.lit(0)).cast("string"), part(title)), 256)


def dedup_first(findings: DataFrame, group: Sequence[str] = (), order: Sequence[str] = ("seq",)) -> DataFrame:
    """One finding per rule, file and line (within the group), the first by the order; missing lines count as line 0.

    An aggregate with the whole row as value, not a window: partial results are combined before the shuffle.
    """
    keys = [*group, "rule_id", "file"]
    row = F.struct(*[F.col(c) for c in findings.columns])
    first = F.min_by(row, F.struct(*[F.coalesce(F.col(c).cast("bigint"), F.lit(2**62)) for c in order], F.xxhash64(*[c for c in findings.columns if not _is_map(findings, c)])))
    return findings.groupBy(*keys, F.coalesce("line", F.lit(0)).alias("_line")).agg(first.alias("_row")).select("_row.*")


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def severity_summary(findings: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    severity = F.upper(F.trim("severity"))
    return findings.groupBy(*group).agg(*[_count(severity == s, s.lower()) for s in SEVERITY_WEIGHT], F.count("*").alias("total"))


def classification_summary(findings: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Five classes for the malware-like categories; every other category counts as clean or as needs_review."""
    like = F.coalesce(F.col("category").isin(*MALWARE_LIKE), F.lit(False))
    kind = F.coalesce("classification", F.when(like, "suspicious").otherwise("needs_review"))
    return findings.groupBy(*group).agg(
        _count(like & (kind == "confirmed_malware"), "confirmed_malware"),
        _count(like & (kind == "potentially_malicious"), "potentially_malicious"),
        _count(like & (kind == "suspicious"), "suspicious"),
        _count((like & (kind == "needs_review")) | (~like & (kind != "clean")), "needs_review"),
        _count(kind == "clean", "clean"),
    )


def security_summary(findings: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    category, severity = F.col("category"), F.upper(F.trim("severity"))
    dependency = category == "Dependencies"
    return findings.groupBy(*group).agg(
        _count(dependency, "dependencies"), _count(category == "Configuration", "configuration"), _count(category == "Permissions", "permissions"),
        _count(category.isin("Secrets", "Git History"), "secrets"), _count(category == "Security", "sast"),
        *[_count(dependency & (severity == s.upper()), f"dependencies_{s}") for s in ("critical", "high", "medium", "low")],
    )


def risk_score(findings: DataFrame, group: Sequence[str] = (), order: Sequence[str] = ("seq",)) -> DataFrame:
    """score 0..100, grade, explanation, contributors and counts of the deduplicated findings, one row a group."""
    severity, category = F.upper(F.trim("severity")), F.col("category")
    weight = F.coalesce(F.try_element_at(_map(RISK_WEIGHT), severity), F.lit(0.0))
    part = weight * F.greatest(F.lit(0.3), F.coalesce(F.col("confidence"), F.lit(0)) / 100.0)
    rows = dedup_first(findings, group, order).groupBy(*group).agg(
        # hundredths keep the sum exact whatever the order of its parts
        F.sum(F.round(part * 1000).cast("bigint")).alias("_raw"), *[_count(severity == s, f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], F.count("*").alias("findings"),
        _count(category == "Dependencies", "dependencies"), _count(category.isin(*MALWARE_LIKE), "malware"), _count(category.isin("Secrets", "Git History"), "secrets"),
        _count(category == "Security", "sast"), _count(category == "Configuration", "configuration"), _count(category == "Permissions", "permissions"),
    )
    score = F.least(F.lit(100), F.floor(F.coalesce("_raw", F.lit(0)) / 1000.0 + 0.5).cast("int"))
    grade = F.when(F.col("score") > 80, "F").when(F.col("score") > 60, "D").when(F.col("score") > 35, "C").when(F.col("score") > 15, "B").otherwise("A")
    said = F.concat_ws(
        "; ",
        F.when(F.col("n_critical") > 0, F.concat("n_critical", F.lit(" critical: act at once"))),
        F.when(F.col("n_high") > 0, F.concat("n_high", F.lit(" high: easier to exploit"))),
        F.when(F.col("n_medium") > 0, F.concat("n_medium", F.lit(" medium"))),
        F.when(F.col("score") == 0, "nothing of weight found"),
    )
    rows = rows.withColumn("score", score).withColumn("grade", grade)
    return rows.withColumn("explanation", F.when(said == "", "little risk").otherwise(said)).drop("_raw")


def baseline_entries(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id", "file", fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("title")).alias("fingerprint"))


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, suppressed) by fingerprint, in either letter case; null fingerprints of the baseline match nothing."""
    known = baseline.select(F.lower("fingerprint").alias("_fp")).where("_fp is not null").distinct()
    keyed = findings.withColumn("_fp", fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("title")))
    return keyed.join(known, "_fp", "left_anti").drop("_fp"), keyed.join(known, "_fp", "left_semi").drop("_fp")


def gate(findings: DataFrame, threshold: str = "high", group: Sequence[str] = ()) -> DataFrame:
    """failed: whether any finding meets the threshold."""
    return findings.groupBy(*group).agg(F.coalesce(F.bool_or(meets(F.col("severity"), threshold)), F.lit(False)).alias("failed"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_weight(F.col("severity")).desc(), "seq")


def model_candidates(findings: DataFrame, most: int = 15, group: Sequence[str] = (), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first so many findings worth a model's opinion, redacted; the number is the report's size."""
    worth = F.col("severity").isin("CRITICAL", "HIGH") | F.col("category").isin("Security", "Malware")
    rows = findings.where(worth)
    if group:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most)
    else:
        rows = rows.orderBy(*order).limit(most)
    return rows.select(*group, *order, "rule_id", "category", "severity", "confidence", "file", "line", redact_for_model(F.coalesce("redacted_evidence", "evidence")).alias("evidence"))


def report_rows(findings: DataFrame) -> DataFrame:
    """The findings as the JSON report has them."""
    chain, evidence = F.col("evidence_chain"), F.col("evidence")
    return findings.select(
        "seq", "file", "classification", F.lower("severity").alias("severity"), "confidence", F.col("rule_id").alias("rule"), "title",
        F.when(F.size(F.coalesce(chain, F.array().cast("array<string>"))) > 0, chain).when(evidence.isNotNull(), F.array(evidence)).otherwise(F.array().cast("array<string>")).alias("evidence"),
        F.filter(F.array("scanner", "detection_method"), lambda x: x.isNotNull()).alias("detectors"), F.coalesce("remediation", F.lit("look at it in its context")).alias("recommendation"), "cwe",
    )


def sarif_level(severity: Column) -> Column:
    name = F.upper(F.trim(severity))
    return F.when(name.isin("CRITICAL", "HIGH"), "error").when(name == "MEDIUM", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding; line and column 0 and null become 1."""
    at_least_one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c)).alias
    return findings.select(
        "seq", F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.col("title").alias("message"), F.translate("file", "\\", "/").alias("uri"),
        at_least_one("line")("startLine"), at_least_one("col")("startColumn"), sanitized(F.coalesce("redacted_evidence", "evidence")).alias("snippet"),
    )

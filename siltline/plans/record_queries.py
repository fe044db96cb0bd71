"""Queries over nested reports and periodic snapshots, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltline.operators import nested, snapshots
from siltline.session import table


def _reports(name):
    return lambda spark, d: nested.report_tables(table(spark, d, "scan_reports"))[name]


QUERIES = {
    "p4_found": lambda spark, d: nested.report_children(table(spark, d, "scan_reports")),
    "p4_reports": _reports("reports"),
    "p4_findings": _reports("findings"),
    "p4_steps": _reports("steps"),
    "p4_contributors": _reports("contributors"),
    "p5_found": lambda spark, d: snapshots.baseline_changes(table(spark, d, "baseline_snapshots")),
    "p5_change_counts": lambda spark, d: snapshots.baseline_changes(table(spark, d, "baseline_snapshots"))
    .groupBy("repo", "snapshot_no", "change")
    .agg(F.count("*").alias("n")),
}

_FINDINGS = """WITH r AS (SELECT DISTINCT scan_id, TRY_CAST(report AS JSON) AS j FROM scan_reports WHERE json_valid(report)),
l AS (SELECT scan_id, unnest(list_concat([json_extract(j, '$.findings'), json_extract(j, '$.result.findings')], json_extract(j, '$.scanners.*.findings'))) AS l FROM r),
f AS (SELECT scan_id, unnest(CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]') ELSE [l] END) AS f FROM l WHERE l IS NOT NULL),
g AS (SELECT scan_id, f, TRY_CAST(coalesce(f->>'$.findingId', f->>'$.finding_id') AS BIGINT) AS finding_id, coalesce(f->'$.aiAnalysis', f->'$.ai_analysis') AS ai0 FROM f WHERE json_type(f) = 'OBJECT'),
"""
_P4 = (
    _FINDINGS
    + """h AS (SELECT scan_id, finding_id, f, CASE WHEN json_type(ai0) = 'VARCHAR' THEN TRY_CAST(ai0->>'$' AS JSON) ELSE ai0 END AS ai FROM g),
c AS (SELECT scan_id, finding_id, 'taint_step' AS child, coalesce(f->'$.taintPath', f->'$.taint_path') AS x FROM h
UNION ALL SELECT scan_id, finding_id, 'evidence_step', coalesce(f->'$.evidenceChain', f->'$.evidence_chain') FROM h
UNION ALL SELECT scan_id, finding_id, 'attack_step', coalesce(ai->'$.attackPath', ai->'$.attack_path') FROM h),
u AS (SELECT scan_id, finding_id, child, CASE WHEN json_type(x) = 'VARCHAR' AND regexp_matches(x->>'$', '^\\s*[\\[{]') AND json_valid(x->>'$') THEN TRY_CAST(x->>'$' AS JSON) ELSE x END AS x FROM c WHERE x IS NOT NULL AND json_type(x) <> 'NULL'),
e AS (SELECT scan_id, finding_id, child, CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') ELSE [x] END AS a FROM u),
p AS (SELECT scan_id, finding_id, child, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS child_no FROM e)
SELECT DISTINCT scan_id, finding_id, child, CAST(child_no AS INTEGER) AS child_no FROM p WHERE json_type(v) <> 'NULL'"""
)

# Labels of the findings: places of the members on the way, from 0.
_AT = "(list_position(json_keys({o}), '{k}') - 1)"
_LABELLED = f"""WITH r AS (SELECT DISTINCT scan_id, TRY_CAST(report AS JSON) AS j FROM scan_reports WHERE json_valid(report)),
s AS (SELECT scan_id, j, unnest(json_keys(j->'$.scanners')) AS k FROM r WHERE json_type(j->'$.scanners') = 'OBJECT'),
l AS (SELECT scan_id, '0.' || {_AT.format(o="j", k="findings")} AS d, j->'$.findings' AS x FROM r
UNION ALL SELECT scan_id, '0.' || {_AT.format(o="j", k="result")} || '.' || {_AT.format(o="j->'$.result'", k="findings")}, j->'$.result.findings' FROM r
UNION ALL SELECT scan_id, '0.' || {_AT.format(o="j", k="scanners")} || '.' || (list_position(json_keys(j->'$.scanners'), k) - 1) || '.' || (list_position(json_keys(json_extract(j, '$.scanners."' || k || '"')), 'findings') - 1), json_extract(j, '$.scanners."' || k || '".findings') FROM s),
m AS (SELECT scan_id, d, unnest(json_extract(x, '$[*]')) AS f, generate_subscripts(json_extract(x, '$[*]'), 1) - 1 AS i FROM l WHERE json_type(x) = 'ARRAY'),
g AS (SELECT scan_id, d || '.' || i AS dewey, f, coalesce(f->'$.aiAnalysis', f->'$.ai_analysis', f->'$.ai') AS ai0 FROM m WHERE json_type(f) = 'OBJECT'),
h AS (SELECT scan_id, dewey, f, CASE WHEN json_type(ai0) = 'VARCHAR' THEN TRY_CAST(ai0->>'$' AS JSON) ELSE ai0 END AS ai, TRY_CAST(coalesce(f->>'$.findingId', f->>'$.finding_id') AS BIGINT) AS finding_id FROM g)
"""
_P4_FINDINGS = _LABELLED + """SELECT scan_id, dewey, regexp_replace(dewey, '\\.\\d+\\.\\d+$', '') AS parent_dewey, finding_id, f->>'$.id' AS rule_id, f->>'$.scanner' AS scanner, f->>'$.category' AS category, f->>'$.severity' AS severity, TRY_CAST(f->>'$.confidence' AS INTEGER) AS confidence, f->>'$.title' AS title, f->>'$.file' AS file, TRY_CAST(f->>'$.line' AS INTEGER) AS line, ai->>'$.verdict' AS ai_verdict, TRY_CAST(ai->>'$.confidence' AS DOUBLE) AS ai_confidence, ai->>'$.severity' AS ai_severity FROM h"""
_P4_STEPS = _LABELLED + """, c AS (SELECT scan_id, finding_id, dewey, 'taint_step' AS child, coalesce(f->'$.taintPath', f->'$.taint_path') AS x FROM h
UNION ALL SELECT scan_id, finding_id, dewey, 'evidence_step', coalesce(f->'$.evidenceChain', f->'$.evidence_chain') FROM h
UNION ALL SELECT scan_id, finding_id, dewey, 'attack_step', coalesce(ai->'$.attackPath', ai->'$.attack_path') FROM h),
u AS (SELECT * REPLACE (CASE WHEN json_type(x) = 'VARCHAR' AND regexp_matches(x->>'$', '^\\s*[\\[{]') AND json_valid(x->>'$') THEN TRY_CAST(x->>'$' AS JSON) ELSE x END AS x) FROM c WHERE x IS NOT NULL AND json_type(x) <> 'NULL'),
e AS (SELECT * REPLACE (CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') ELSE [x] END AS x) FROM u),
p AS (SELECT scan_id, finding_id, dewey, child, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS child_no FROM e)
SELECT scan_id, finding_id, child, CAST(child_no AS INTEGER) AS child_no, dewey AS finding_dewey, CASE WHEN json_type(v) = 'VARCHAR' THEN v->>'$' ELSE CAST(v AS VARCHAR) END AS value FROM p WHERE json_type(v) <> 'NULL'"""
_P4_REPORTS = "WITH r AS (SELECT DISTINCT scan_id, TRY_CAST(report AS JSON) AS j FROM scan_reports WHERE json_valid(report)) SELECT scan_id, j->>'$.tool.name' AS tool_name, j->>'$.tool.version' AS tool_version, j->>'$.target' AS target, TRY_CAST(coalesce(j->>'$.riskScore.score', j->>'$.risk_score.score') AS INTEGER) AS score, '0' AS dewey FROM r"

_P5 = r"""WITH c AS (SELECT repo, snapshot_no, lower(fingerprint) AS fingerprint, rule_id, replace(file, '\', '/') AS file, line, title, note, loaded_at FROM baseline_snapshots WHERE snapshot_no IS NOT NULL),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, fingerprint ORDER BY loaded_at DESC) = 1),
v AS (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT repo, snapshot_no FROM d)),
n AS (SELECT d.*, prev FROM d JOIN v USING (repo, snapshot_no) WHERE prev IS NOT NULL),
o AS (SELECT d.*, v.snapshot_no AS at FROM d JOIN v ON d.repo = v.repo AND d.snapshot_no = v.prev),
x AS (SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.snapshot_no, o.at) AS snapshot_no, coalesce(n.fingerprint, o.fingerprint) AS fingerprint,
CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'removed'
WHEN n.rule_id IS DISTINCT FROM o.rule_id OR n.file IS DISTINCT FROM o.file OR n.line IS DISTINCT FROM o.line OR n.title IS DISTINCT FROM o.title OR n.note IS DISTINCT FROM o.note THEN 'changed' END AS change
FROM n FULL JOIN o ON n.repo = o.repo AND n.snapshot_no = o.at AND n.fingerprint = o.fingerprint)
"""

ORACLES = {
    "p4_found": _P4,
    "p4_reports": _P4_REPORTS,
    "p4_findings": _P4_FINDINGS,
    "p4_steps": _P4_STEPS,
    "p4_contributors": "WITH r AS (SELECT DISTINCT scan_id, TRY_CAST(report AS JSON) AS j FROM scan_reports WHERE json_valid(report)), c AS (SELECT scan_id, coalesce(json_extract(j, '$.riskScore.contributors[*]'), []) || coalesce(json_extract(j, '$.risk_score.contributors[*]'), []) AS a, list_position(list_transform(json_keys(j), lambda k: lower(replace(k, '_', ''))), 'riskscore') - 1 AS n, j FROM r), p AS (SELECT scan_id, n, list_position(json_keys(coalesce(j->'$.riskScore', j->'$.risk_score')), 'contributors') - 1 AS m, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS i FROM c) SELECT scan_id, '0.' || n || '.' || m || '.' || i AS dewey, x->>'$.name' AS name, TRY_CAST(x->>'$.count' AS BIGINT) AS count, '0.' || n AS parent_dewey FROM p",
    "p5_found": _P5 + "SELECT repo, snapshot_no, fingerprint, change FROM x WHERE change IS NOT NULL",
    "p5_change_counts": _P5 + "SELECT repo, snapshot_no, change, count(*) AS n FROM x WHERE change IS NOT NULL GROUP BY ALL",
}

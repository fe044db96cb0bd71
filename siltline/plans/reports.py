"""Sinks: JSON, SARIF, HTML, terminal and tables. Nothing is sent anywhere.

Single documents show the first ``PAGE`` findings and say how many there are; ``write_table`` and ``write_rows`` write
all of them, in parallel. Evidence is redacted before it gets here.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.operators import findings as O
from siltline.plans import rules as R
from siltline.plans.scan import Result

VERSION = "0.1.0"
#: Findings in a document that the driver writes.
PAGE = 50_000


def _page(rows: DataFrame, *order) -> tuple[list, dict]:
    """The first findings in that order, and the numbers of all and of those shown."""
    shown = rows.orderBy(*order).limit(PAGE).collect()
    return shown, {"total": len(shown) if len(shown) < PAGE else rows.count(), "shown": len(shown)}


def json_report(result: Result) -> str:
    """The report as JSON; findings as report_rows has them."""
    rows, page = _page(O.report_rows(result.findings).select("seq", F.to_json(F.struct("*")).alias("row")), "seq", "row")
    findings = [{k: v for k, v in json.loads(r["row"]).items() if k != "seq"} for r in rows]
    return json.dumps({"tool": {"name": "siltline", "version": VERSION}, **result.report(), "page": page, "findings": findings}, indent=2, default=str)


def sarif_report(result: Result) -> str:
    """SARIF 2.1.0 with every declared rule."""
    rules = [{"id": r.rule_id, "name": r.title, "shortDescription": {"text": r.title}, "defaultConfiguration": {"level": {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning"}.get(r.severity, "note")}} for r in R.registry()]
    results = []
    rows, page = _page(O.sarif_results(result.findings), "seq", "ruleId", "uri")
    for r in rows:
        region = {"startLine": r["startLine"], "startColumn": r["startColumn"]} | ({"snippet": {"text": r["snippet"]}} if r["snippet"] else {})
        results.append({"ruleId": r["ruleId"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"], "uriBaseId": "%SRCROOT%"}, "region": region}}]})
    log = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "siltline", "version": VERSION, "rules": rules}}, "results": results, "properties": page}]}
    return json.dumps(log, indent=2)


def html_report(result: Result) -> str:
    """One page without outside resources; every value is escaped, none is put into a script."""
    risk = result.report()["risk"] or {"score": 0, "grade": "A"}
    cells = ("severity", "rule_id", "title", "file", "line", "redacted_evidence")
    shown, page = _page(result.findings.select(*cells, "seq"), O.severity_weight(F.col("severity")).desc(), "seq")
    text = lambda v: html.escape(str(v if v is not None else ""))
    rows = "".join(f"<tr data-severity='{text(r['severity'])}'>" + "".join(f"<td>{text(r[c])}</td>" for c in cells) + "</tr>" for r in shown)
    head = "".join(f"<th>{c}</th>" for c in cells)
    options = "".join(f"<option>{s}</option>" for s in ("ALL", *O.SEVERITY_WEIGHT))
    script = (
        "const q=document.getElementById('q'),s=document.getElementById('s');"
        "q.oninput=s.onchange=()=>document.querySelectorAll('tbody tr').forEach(r=>{r.hidden=!r.textContent.toLowerCase().includes(q.value.toLowerCase())||s.value!=='ALL'&&r.dataset.severity!==s.value});"
    )
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>siltline</title></head><body><h1>Score {risk['score']}, grade {risk['grade']}</h1><p>{page['shown']} of {page['total']} findings</p>"
        f"<input id='q' placeholder='filter'><select id='s'>{options}</select><table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table><script>{script}</script></body></html>"
    )


def terminal_report(result: Result) -> str:
    report = result.report()
    risk, summary = report["risk"] or {"score": 0, "grade": "A", "explanation": ""}, report["summary"] or {}
    counts = {r["scanner"]: r["count"] for r in result.findings.groupBy("scanner").count().collect()}  # a row a scanner
    lines = ["coverage"]
    for run in result.runs:
        sign = {"completed": "+", "skipped": "-", "planned": "-"}.get(run["status"], "!")
        lines.append(f"  {sign} {run['scanner']:<14} {run['status']}" + (f", {counts[run['scanner']]} findings" if run["scanner"] in counts else "") + (f" ({run['message']})" if run.get("message") else ""))
    lines += [f"score {risk['score']}  grade {risk['grade']}  {risk.get('explanation', '')}", "  ".join(f"{k} {v}" for k, v in summary.items())]
    shown, page = _page(result.findings.select("severity", "rule_id", "file", "line", "title", "seq"), O.severity_weight(F.col("severity")).desc(), "seq")
    lines += [f"{r['severity']:<8} {r['rule_id']:<13} {r['file']}:{r['line'] or ''}  {r['title']}" for r in shown]
    return "\n".join(lines + [f"{page['shown']} of {page['total']} findings shown"] * (page["shown"] < page["total"]))


def fix_list(result: Result) -> DataFrame:
    return result.findings.select("file", "line", "rule_id", F.coalesce("remediation", F.lit("look at it in its context")).alias("remediation"))


def write_baseline(result: Result, path: str) -> None:
    O.baseline_entries(result.findings).distinct().write.mode("overwrite").json(path)


def write_table(result: Result, path: str) -> None:
    """The findings as Parquet; only where a caller names a place."""
    result.findings.write.mode("overwrite").parquet(path)


def write_rows(result: Result, path: str) -> None:
    """The findings as lines of JSON, as report_rows has them, written in parallel."""
    O.report_rows(result.findings).write.mode("overwrite").json(path)

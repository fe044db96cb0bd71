"""Command line: ``python -m siltline.cli scan [target]`` and ``doctor``."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.sql import SparkSession

from siltline.session import local_session

CONFIG_FILES = ("siltline.config.json", ".siltlinerc.json", ".siltlinerc")
SEVERITIES = ("critical", "high", "medium", "low")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siltline", description="Security scan of a project tree on Spark")
    out.add_argument("words", nargs="*", help="[scan] [target], or doctor")
    for flag in ("deep", "security", "malware", "secrets", "deps", "config", "full", "json", "ci", "fix", "offline", "verbose", "quiet", "no-deps", "no-git", "ai", "sandbox", "yara", "clamav"):
        out.add_argument(f"--{flag}", action="store_true")
    out.add_argument("--html", nargs="?", const="siltline-report.html")
    out.add_argument("--sarif", nargs="?", const="siltline.sarif")
    out.add_argument("--table", help="write the findings as Parquet to this place")
    out.add_argument("--rows", help="write the findings as lines of JSON to this place")
    out.add_argument("--advisories", help="table of advisories (Parquet or JSON): ecosystem, name, version, advisory_id, summary, aliases, scores, fixed")
    out.add_argument("--threats", help="table of known hashes (Parquet or JSON): sha256, name")
    out.add_argument("--yara-rules", help="rule file of the signature scanner")
    out.add_argument("--fail-on", choices=SEVERITIES, type=str.lower)
    out.add_argument("-o", "--output")
    out.add_argument("--baseline")
    out.add_argument("--baseline-create")
    out.add_argument("--ignore", nargs="+", default=[])
    return out


def user_config(target: str) -> dict:
    """The first configuration file of the target that parses."""
    for name in CONFIG_FILES:
        try:
            with open(os.path.join(target, name), encoding="utf-8") as file:
                found = json.load(file)
                if isinstance(found, dict):
                    return found
        except (OSError, ValueError):
            continue
    return {}


def in_container() -> bool:
    """By the mark of a container runtime or the variables of hosted workspaces and build services."""
    return os.path.exists("/.dockerenv") or any(os.environ.get(name) == "true" for name in ("CODESPACES", "REMOTE_CONTAINERS", "GITHUB_ACTIONS"))


def doctor(checkpoints: str | None = None, advisories: str | None = None) -> list[tuple[str, str]]:
    """(check, status) of what a scan needs or can use.

    checkpoints: the folder of spark.checkpoint.dir, unset in local runs; advisories: a table's place.
    """
    have = lambda ok, missing="optional_missing": "ok" if ok else missing
    import importlib.util as u
    import tempfile

    folder = checkpoints or tempfile.gettempdir()
    return [
        ("python", have(sys.version_info >= (3, 10), "error")), ("java", have(shutil.which("java") or os.environ.get("JAVA_HOME"), "error")), ("pyspark", have(u.find_spec("pyspark"), "error")),
        ("pyarrow", have(u.find_spec("pyarrow"), "error")), ("pandas", have(u.find_spec("pandas"), "error")), ("git", have(shutil.which("git"))), ("yara", have(shutil.which("yara"))),
        ("docker", have(shutil.which("docker"))), ("clamav", have(shutil.which("clamscan") or shutil.which("clamdscan"))), ("training-data operators", have(u.find_spec("siltline.llm"))),
        ("checkpoint folder", have("://" in folder or os.access(folder, os.W_OK), "error")), ("advisory table", have(advisories and ("://" in advisories or os.path.exists(advisories)))),
    ]


def read_table(spark: SparkSession, place: str | None):
    """Parquet, or JSON by the name's end; None for no place."""
    return None if not place else spark.read.json(place) if place.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(place)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, 1 if the gate fails, 2 for a wrong target or baseline."""
    options = parser().parse_args(argv)
    if options.words[:1] == ["doctor"]:
        checks = doctor(spark.sparkContext.getConf().get("spark.checkpoint.dir", None) if spark else None, options.advisories)
        print("\n".join(f"{name:<24} {status}" for name, status in checks))
        return int(any(status == "error" for _, status in checks))
    words = options.words[1:] if options.words[:1] == ["scan"] else options.words
    target = words[0] if words else "."
    if not os.path.isdir(target):
        print(f"no such directory: {target}", file=sys.stderr)
        return 2
    for what, place in (("baseline", options.baseline), ("advisories", options.advisories), ("threats", options.threats), ("rules", options.yara_rules)):
        if place and "://" not in place and not os.path.exists(place):
            print(f"no such {what}: {place}", file=sys.stderr)
            return 2
    from siltline.plans import reports
    from siltline.plans.scan import Config, candidates_for_model, exit_code, scan

    settings = user_config(target)
    scanners = {"binary": "binaries", "archive": "archives"}
    off = tuple(scanners.get(k, k) for k, v in (settings.get("scanners") or {}).items() if v is False)
    config = Config(
        deep=options.deep, full=options.full, security=options.security, malware=options.malware, secrets=options.secrets, deps=options.deps, config=options.config, no_deps=options.no_deps, no_git=options.no_git,
        disabled=off, ignore=tuple(settings.get("ignore") or options.ignore), in_container=in_container(),
        offline=options.offline, yara_rules=options.yara_rules, asked=tuple(x for x in ("yara", "sandbox", "clamav") if getattr(options, x)),
    )
    spark = spark or local_session()
    baseline = spark.read.json(options.baseline) if options.baseline else None
    result = scan(spark, target, config, baseline, read_table(spark, options.advisories), read_table(spark, options.threats))
    if options.baseline_create:
        reports.write_baseline(result, options.baseline_create)
    if options.table:
        reports.write_table(result, options.table)
    if options.rows:
        reports.write_rows(result, options.rows)
    for place, make in ((options.html, reports.html_report), (options.sarif, reports.sarif_report)):
        if place:
            with open(place, "w", encoding="utf-8") as file:
                file.write(make(result))
    text = reports.json_report(result) if options.json else reports.terminal_report(result)
    if options.output:
        with open(options.output, "w", encoding="utf-8") as file:
            file.write(text)
    elif not options.quiet or options.json:
        print(text)
    if options.ai:  # what a model would be asked about; nothing is sent
        for row in candidates_for_model(result):
            print(f"candidate {row['rule_id']} {row['file']}:{row['line'] or ''} {row['evidence']}")
    if options.fix:
        for row in reports.fix_list(result).limit(reports.PAGE).collect():
            print(f"{row['file']}:{row['line'] or ''} {row['rule_id']}: {row['remediation']}")
    threshold = options.fail_on or settings.get("failOn") or "high"
    return exit_code(result, threshold) if options.ci or options.fail_on else 0


if __name__ == "__main__":
    sys.exit(main())

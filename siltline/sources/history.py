"""Commit history as text: commits, files and added lines, and the secrets among them."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltline.functions.text import is_placeholder
from siltline.operators import detect
from siltline.plans import rules as R


def git_log(root: str, commits: int = 30, timeout: float = 15, limit: int = 10 * 2**20) -> str | None:
    """The log with patches of the last commits; None if git fails, takes too long or prints more than the limit."""
    return read_log(root, commits, timeout, limit)[1]


def read_log(root: str, commits: int = 30, timeout: float = 15, limit: int = 10 * 2**20) -> tuple[dict, str | None]:
    """(run, log): how the reading fared, as a row of a scan's runs, and the log."""
    run = {"scanner": "git", "status": "completed", "commits": commits}
    try:
        done = subprocess.run(["git", "-C", root, "log", "-p", "-n", str(commits), "--no-color"], capture_output=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError) as error:
        return run | {"status": "skipped", "message": f"no history: {type(error).__name__}"}, None
    if len(done.stdout) > limit:
        return run | {"status": "incomplete", "message": f"history of {len(done.stdout)} bytes is above the limit of {limit} and was left out"}, None
    return run, done.stdout.decode("utf-8", "replace")


def log_frame(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.createDataFrame([("log", text)] if text else [], "log string, text string")


def added_lines(logs: DataFrame, keys: Sequence[str] = ("log",), text: str = "text") -> DataFrame:
    """(keys, commit, file, line, text) of the added lines; commit and file are those of the last headers above.

    ``line`` counts the lines of the log. One window per log carries the headers forward.
    """
    lines = detect.to_lines(logs.select(*keys, F.col(text).alias("text")), keys)
    t = F.col("text")
    commit, file = F.when(t.startswith("commit "), F.substring(t, 8, 8)), F.when(t.startswith("+++ b/"), F.expr("substring(text, 7)"))
    above = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("commit", F.last(commit, True).over(above)).withColumn("file", F.last(file, True).over(above))
    return rows.where(t.startswith("+") & ~t.startswith("+++")).select(*keys, "commit", "file", "line", F.expr("substring(text, 2)").alias("text"))


def history_secrets(added: DataFrame, keys: Sequence[str] = ("log",)) -> DataFrame:
    """All secret rules on added lines, with fixed confidence and without an entropy test."""
    rules = R.SECRETS
    found = detect.secret_values(added, (*keys, "commit", "file", "line"), rules)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_order") + 1)
    found = found.withColumns({"rule_id": pick([r.rule_id for r in rules]), "severity": pick([r.severity for r in rules])})
    return found.where((F.length("value") >= 6) & ~is_placeholder(F.col("value"))).select(*keys, "rule_id", "severity", F.lit("Git History").alias("category"), F.lit(90).alias("confidence"), "commit", "file", "line", "value")

"""Signature scanner as an outside program, where it is installed and rules are given."""

from __future__ import annotations

import os
import re
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession


def yara_matches(spark: SparkSession, rules: str, target: str, timeout: float = 60) -> tuple[str, DataFrame]:
    """(status, matches): rule and rel_path of each output line; unavailable without the program, error if it fails."""
    schema = "rule string, rel_path string"
    program = shutil.which("yara")
    if program is None:
        return "unavailable", spark.createDataFrame([], schema)
    try:
        done = subprocess.run([program, "-r", rules, target], capture_output=True, timeout=timeout, check=True, text=True)
    except (OSError, subprocess.SubprocessError):
        return "error", spark.createDataFrame([], schema)
    return "completed", parse_matches(spark, done.stdout, target)


def parse_matches(spark: SparkSession, output: str, target: str = "") -> DataFrame:
    """rule and rel_path of the lines that are a rule's name, blanks and a path; paths below the target become relative."""
    found = (re.match(r"(\w+)\s+(.+)$", line) for line in output.splitlines())
    rows = [(m[1], os.path.relpath(m[2], target).replace(os.sep, "/") if target and m[2].startswith(target) else m[2]) for m in found if m]
    return spark.createDataFrame(rows, "rule string, rel_path string")

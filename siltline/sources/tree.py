"""Project trees as a files table.

Spark's own file sources hide names that begin with a dot or underscore, so the driver lists the tree (pruning ignored
directories) and the tasks read the contents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import binary, paths
from siltline.operators.detect import text_of


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 10 * 2**20
    total_bytes: int = 500 * 2**20
    files: int = 50_000
    depth: int = 30


def ignore_patterns(root: str, names: Sequence[str] = paths.IGNORE_FILES) -> list[str]:
    """Lines of the ignore files at the root, without blank ones and comments."""
    out: list[str] = []
    for name in names:
        try:
            with open(os.path.join(root, name), encoding="utf-8", errors="replace") as file:
                out += [line.strip() for line in file if line.strip() and not line.strip().startswith("#")]
        except OSError:
            continue
    return out


@dataclass
class Coverage:
    """What a walk took, and what its limits cut off."""

    files: int = 0
    bytes: int = 0
    too_large: int = 0
    too_deep: int = 0
    stopped: str | None = None

    def run(self) -> dict:
        """The walk as a row of a scan's runs: incomplete if anything was cut off."""
        cuts = [f"{self.too_large} files above the size limit"] * bool(self.too_large) + [f"{self.too_deep} folders below the depth limit"] * bool(self.too_deep) + [f"stopped at the limit of {self.stopped}"] * bool(self.stopped)
        return {"scanner": "walk", "status": "incomplete" if cuts else "completed", "files": self.files, "bytes": self.bytes} | ({"message": "; ".join(cuts)} if cuts else {})


def walk(root: str, patterns: Sequence[str] = (), limits: Limits = Limits(), coverage: Coverage | None = None) -> Iterator[tuple[str, str, int, int]]:
    """(path, rel_path, size, mode) in directory order; symbolic links are never followed.

    The caps on number and sum stop the walk after the file that reaches them; larger files than the limit are left
    out. ``coverage`` is filled with what was taken and what was cut off.
    """
    rules = [*ignore_patterns(root), *patterns]
    seen = coverage if coverage is not None else Coverage()
    for folder, folders, names in os.walk(root, followlinks=False):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        depth = 0 if rel == "." else rel.count("/") + 1
        prefix = "" if rel == "." else rel + "/"
        folders[:] = sorted(f for f in folders if not os.path.islink(os.path.join(folder, f)) and not paths.ignores(prefix + f, rules))
        if depth >= limits.depth:
            seen.too_deep += len(folders)
            folders.clear()
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.islink(path) or not os.path.isfile(path) or paths.ignores(prefix + name, rules):
                continue
            info = os.stat(path)
            if info.st_size > limits.file_bytes:
                seen.too_large += 1
                continue
            yield path, prefix + name, info.st_size, info.st_mode & 0o777
            seen.files, seen.bytes = seen.files + 1, seen.bytes + info.st_size
            reached = "files" if seen.files >= limits.files else "bytes" if seen.bytes >= limits.total_bytes else None
            if reached:
                seen.stopped = reached
                return


_FILES = "path string, rel_path string, size bigint, mode int, content binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for path in batch["path"]:
            try:
                with open(path, "rb") as file:
                    contents.append(file.read())
            except OSError:
                contents.append(None)
        yield batch.assign(content=pd.Series(contents, dtype=object))


def describe(files: DataFrame) -> DataFrame:
    """Adds ext, language, type, flags, sha256 and the text of non-binary files to path, rel_path, size, mode, content."""
    out = files.withColumn("_m", binary.sniff(F.coalesce("content", F.lit(b"")))).withColumn("ext", paths.extension(F.col("rel_path")))
    return out.select(
        "path", "rel_path", "size", "mode", "content", "ext", paths.language(F.col("rel_path")).alias("language"), F.col("_m.type").alias("type"), F.col("_m.is_binary").alias("is_binary"), F.col("_m.is_archive").alias("is_archive"),
        F.col("_m.is_executable").alias("is_executable"), binary.is_disguised(F.col("_m.is_executable"), F.col("ext")).alias("is_disguised"), F.sha2("content", 256).alias("sha256"),
        F.when(~F.col("_m.is_binary"), text_of(F.col("content"))).alias("text"),
    )


def read_tree(spark: SparkSession, root: str, patterns: Sequence[str] = (), limits: Limits = Limits(), coverage: Coverage | None = None) -> DataFrame:
    """The described files below a root; unreadable files are left out, a missing root gives an empty table.

    Tasks read the files by the paths that the driver lists: on a cluster the root must be a folder that all mount.
    """
    rows = list(walk(root, patterns, limits, coverage))
    if not rows:
        return describe(spark.createDataFrame([], _FILES))
    listed = spark.createDataFrame(rows, "path string, rel_path string, size bigint, mode int").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))
    return describe(listed.mapInPandas(_read, _FILES).where("content is not null"))

"""Source files that do not parse: packrat grammars over whole files, with cause, place and rates."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.languages import EXTENSIONS, JUDGED, NAMES, language

#: Frames of a parse at most, some 0.4 kB each; about 15 a bracket of depth.
FRAMES = 1_000_000
_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$")


def decoded(content: bytes) -> str:
    """The text without byte order mark and with plain line ends; bytes that don't decode become U+FFFD."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = content.decode("utf-16", "replace")
    else:
        text = content.decode("utf-8", "replace")
    if text[:1] == "﻿":
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def judge(name: str, content: bytes) -> tuple[bool | None, int | None, int | None, int | None, str | None]:
    """(valid, furthest offset, line, column, cause) of one file; offset, line and column are null if it is valid.

    A file nested too deep for the parser's stack is neither valid nor invalid: valid is null, the cause undecided.
    """
    text = decoded(content)
    lang = language(name)
    try:
        kinds = lang.kinds(text)
        if lang.grammar.accepts(kinds):
            return True, None, None, None, None
        offset = min(lang.offset(text, lang.grammar.furthest(kinds)), len(text))
    except RecursionError:
        return None, None, None, None, "undecided"
    line = text.count("\n", 0, offset) + 1
    return False, offset, line, offset - text.rfind("\n", 0, offset), _cause(text, offset)


def _cause(text: str, offset: int) -> str:
    marks = {m[0][0] for m in _CONFLICT.finditer(text)}
    if {"<", ">"} <= marks or "=" in marks and marks & {"<", ">"}:
        return "conflict"
    if not text.strip():
        return "empty"
    if "\x00" in text:
        return "null bytes"
    if not text[offset:].strip():
        return "truncated"
    if offset <= len(text) - len(text.lstrip()) + 80 and text.count("\n", 0, offset) < 3:
        return "other content"
    return "syntax"


def judged_language(path: Column, named: Column) -> Column:
    """The language that path and language say; null where it isn't judged. The language column wins over the extension."""
    pairs = [(k, v) for k, v in (NAMES | {j: j for j in JUDGED}).items()]
    by_name = F.create_map(*[F.lit(x) for p in pairs for x in p])
    by_extension = F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p])
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    extension = F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))
    return F.when(named.isNotNull() & (F.trim(named) != ""), F.try_element_at(by_name, F.lower(F.trim(named)))).otherwise(F.try_element_at(by_extension, extension))


def parse_files(files: DataFrame) -> DataFrame:
    """file_id, repo, language, valid, error_offset, error_line, error_column and cause of every judged file.

    Judged are non-binary files (a null flag counts as non-binary) of the languages above, told by path and language.
    A file delivered several times counts once, by its latest delivery. A null content is judged as an empty file;
    an empty file is valid where the grammar takes no tokens. Other columns are ignored.
    """
    rows = files.where(~F.coalesce("is_binary", F.lit(False))).withColumn("_language", judged_language(F.col("path"), F.col("language")))
    rows = rows.where(F.col("_language").isNotNull())
    found = "repo string, language string, valid boolean, error_offset int, error_line int, error_column int, cause string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
        for batch in batches:
            results = list(map(judge, batch["_language"], batch["content"]))
            got = pd.DataFrame(results, columns=["valid", "error_offset", "error_line", "error_column", "cause"])
            got = got.astype({"error_offset": "Int64", "error_line": "Int64", "error_column": "Int64"})
            got.insert(0, "file_id", batch["file_id"].to_numpy())
            got.insert(1, "at", batch["at"])
            got.insert(2, "repo", batch["repo"].to_numpy())
            got.insert(3, "language", batch["_language"].to_numpy())
            yield got

    # contents are judged where they are read; only verdicts are shuffled to drop deliveries of the same file
    at = F.coalesce(F.unix_micros("discovered_at"), F.lit(-(2**62))).alias("at")
    judged = rows.select("file_id", at, "repo", "_language", F.coalesce("content", F.lit(b"")).alias("content"))
    judged = judged.mapInPandas(run, f"file_id long, at long, {found}")
    columns = [c.split()[0] for c in found.split(", ")]
    latest = F.max_by(F.struct(*columns), F.struct("at", F.xxhash64(*columns))).alias("f")
    return judged.groupBy("file_id").agg(latest).select("file_id", "f.*")


#: Levels of the rates by the columns that are summed over.
LEVELS = {0: "repo and language", 1: "repo", 2: "language", 3: "all"}


def parse_rates(judged: DataFrame) -> DataFrame:
    """level, repo, language, files, invalid, undecided, conflicts and rate: per repository and language, with totals.

    ``level`` says what a row sums up; the columns summed over are null, as is the repo of files without one. The rate
    is that of the decided files; null where none is.
    """
    rows = judged.cube("repo", "language").agg(
        F.grouping_id("repo", "language").alias("_level"), F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("valid").isNull()).alias("undecided"), F.count_if(F.col("cause") == "conflict").alias("conflicts"),
    )
    names = F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p])
    rate = F.try_divide(F.col("invalid"), F.col("files") - F.col("undecided"))
    return rows.select(names[F.col("_level").cast("int")].alias("level"), "repo", "language", "files", "invalid", "undecided", "conflicts", rate.alias("rate"))

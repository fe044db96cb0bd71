"""Dependencies out of manifests and lock files, and their join with a table of advisories.

Every parser takes files (keys, rel_path, text) and gives (keys, name, version, ecosystem, manifest). Broken manifests
and null texts give nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltline.functions.paths import basename
from siltline.operators.detect import to_lines
from siltline.plans import rules as R

_STRINGS = "map<string,string>"
_NAME = r"@?[a-zA-Z0-9_.-]+(?:/[a-zA-Z0-9_.-]+)?"


def _named(files: DataFrame, *names: str) -> DataFrame:
    return files.where(basename(F.col("rel_path")).isin(*names) & F.col("text").isNotNull())


def _out(df: DataFrame, keys: Sequence[str], ecosystem: str) -> DataFrame:
    return df.select(*keys, "name", "version", F.lit(ecosystem).alias("ecosystem"), F.col("rel_path").alias("manifest"))


def _carried(keys: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*keys, "rel_path"]))


def _json_map(text: Column, field: str) -> Column:
    """A field of a JSON object as a map; empty where it is missing or of another shape."""
    return F.coalesce(F.from_json(F.get_json_object(text, f"$.{field}"), _STRINGS), F.create_map().cast(_STRINGS))


def package_json(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """Dependencies, overridden by devDependencies, overridden by optionalDependencies; versions without range signs."""
    text = F.col("text")
    later = F.array(*[F.map_entries(_json_map(text, f)) for f in ("optionalDependencies", "devDependencies", "dependencies")])
    entries = _named(files, "package.json").select(*_carried(keys), F.posexplode(later).alias("_rank", "_entries")).select(*_carried(keys), "_rank", F.explode("_entries").alias("_e"))
    first = entries.groupBy(*_carried(keys), F.col("_e.key").alias("name")).agg(F.min_by("_e.value", "_rank").alias("_v"))
    rows = first.select(*_carried(keys), "name", F.regexp_replace("_v", "[\\^~>=<]", "").alias("version")).where(F.col("version").rlike(r"^\s*[0-9]+\.[0-9]+"))
    return _out(rows.withColumn("version", F.trim("version")), keys, "npm")


def install_hooks(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """hook and command of the life-cycle scripts of package.json."""
    scripts = _json_map(F.col("text"), "scripts")
    return _named(files, "package.json").select(*_carried(keys), F.explode(scripts).alias("hook", "command")).where(F.col("hook").isin("preinstall", "install", "postinstall", "preuninstall") & F.col("command").isNotNull())


def hook_findings(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """Hooks that run a shell or downloader, and hooks that download code."""
    from siltline.operators.detect import _finding

    hooks = install_hooks(files, keys)
    evidence = F.concat(F.lit('"'), F.col("hook"), F.lit('": "'), F.col("command"), F.lit('"'))
    shell = hooks.where(F.col("command").rlike(r"(?i)(?:curl|wget|powershell|bash|sh|node\s+-e)\s+") & ~F.col("command").contains("node-gyp") & ~F.col("command").contains("patch-package"))
    loads = hooks.where((F.col("hook") != "preuninstall") & F.col("command").rlike(r"(?i)(?:curl|wget).*\|\s*(?:ba)?sh|node\s+-e\s+[\"'].*(?:Buffer|fetch|http|exec)"))
    return shell.select(*keys, *_finding(R.by_id("SUSP-004"), evidence)).unionByName(loads.select(*keys, *_finding(R.by_id("DEP-002"), evidence)))


def yarn_lock(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """The first version line after each header line."""
    carried = _carried(keys)
    lines = to_lines(_named(files, "yarn.lock").select(*carried, "text"), carried)
    text = F.trim("text")
    header = F.when(text.rlike(rf'^"?{_NAME}@') & ~F.col("text").rlike(r"^\s"), F.regexp_extract(text, rf'^"?({_NAME})@', 1))
    file = Window.partitionBy(*carried).orderBy("line")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(*carried, "line", text.alias("_t"), header.alias("_h")).withColumn("name", F.last("_h", True).over(upto)).withColumn("_block", F.count("_h").over(upto))
    found = rows.where(F.col("_t").rlike(r'^version:?\s*"?[0-9a-zA-Z_.-]+"?') & F.col("name").isNotNull())
    first = found.groupBy(*carried, "_block").agg(F.min_by(F.struct("name", F.regexp_extract("_t", r'^version:?\s*"?([0-9a-zA-Z_.-]+)"?', 1).alias("version")), "line").alias("_f"))
    return _out(first.select(*carried, "_f.name", "_f.version"), keys, "npm")


def _by_line(files: DataFrame, keys: Sequence[str], name: str, pattern: str, ecosystem: str) -> DataFrame:
    carried = _carried(keys)
    lines = to_lines(_named(files, name).select(*carried, "text"), carried).where(F.col("text").rlike(pattern))
    rows = lines.select(*carried, F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("version"))
    return _out(rows, keys, ecosystem)


def pnpm_lock(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    return _by_line(files, keys, "pnpm-lock.yaml", rf"^\s*['\"]?/({_NAME})[@/]([0-9]+\.[0-9]+\.[0-9]+[^:'\"]*)['\"]?:", "npm")


def requirements(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    return _by_line(files, keys, "requirements.txt", r"^\s*([a-zA-Z0-9_.-]+)\s*==\s*([0-9a-zA-Z_.-]+)", "PyPI")


def go_mod(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    return _by_line(files, keys, "go.mod", r"^(?:require\s+|\t)([a-zA-Z0-9._/-]+)\s+v?([0-9a-zA-Z.-]+)", "Go")


def package_lock(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """``packages`` of lock version 2 and above, without the root and entries without version; else ``dependencies``."""
    kind = "map<string,struct<version:string>>"
    text = F.col("text")
    packages, old = F.from_json(F.get_json_object(text, "$.packages"), kind), F.from_json(F.get_json_object(text, "$.dependencies"), kind)
    rows = _named(files, "package-lock.json").select(*_carried(keys), F.explode(F.coalesce(packages, old)).alias("_n", "_v"))
    rows = rows.where((F.col("_n") != "") & F.col("_v.version").isNotNull()).select(*_carried(keys), F.regexp_replace("_n", "^node_modules/", "").alias("name"), F.col("_v.version").alias("version"))
    return _out(rows, keys, "npm")


def composer_lock(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    rows = _named(files, "composer.lock").select(*_carried(keys), F.explode(F.from_json(F.get_json_object("text", "$.packages"), "array<struct<name:string,version:string>>")).alias("_p"))
    rows = rows.where("_p.name is not null and _p.version is not null").select(*_carried(keys), F.col("_p.name").alias("name"), F.regexp_replace("_p.version", "^v", "").alias("version"))
    return _out(rows, keys, "Packagist")


PARSERS = (package_json, package_lock, yarn_lock, pnpm_lock, requirements, composer_lock, go_mod)


def dependencies(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    out = PARSERS[0](files, keys)
    for parse in PARSERS[1:]:
        out = out.unionByName(parse(files, keys))
    return out


def distinct_packages(deps: DataFrame) -> DataFrame:
    """What is looked up: each ecosystem, name (in small letters) and version once."""
    return deps.select(F.lower("ecosystem").alias("ecosystem"), F.lower("name").alias("name"), "version").distinct()


# -- advisories ----------------------------------------------------------------------------------------------------------


def cvss_severity(scores: Column) -> Column:
    """HIGH, or what the last numeric score says; vector texts and nulls say nothing."""

    def step(severity: Column, score: Column) -> Column:
        value = score.try_cast("double")
        return F.when(value.isNull(), severity).when(value >= 9, "CRITICAL").when(value >= 7, "HIGH").when(value >= 4, "MEDIUM").otherwise("LOW")

    return F.aggregate(F.coalesce(scores, F.array().cast("array<string>")), F.lit("HIGH"), step)


def fixed_version(fixed: Column) -> Column:
    """``fixed`` holds the fixed versions of each range: the first of the last range that has one."""
    firsts = F.filter(F.transform(fixed, lambda r: F.try_element_at(F.filter(r, lambda v: v.isNotNull()), F.lit(1))), lambda v: v.isNotNull())
    return F.try_element_at(firsts, F.lit(-1))


def cve_ids(aliases: Column) -> Column:
    return F.filter(aliases, lambda a: a.startswith("CVE-"))


def ghsa_ids(aliases: Column, advisory_id: Column) -> Column:
    """From the aliases; the advisory's own id only if there are no aliases at all."""
    return F.when(aliases.isNull(), F.filter(F.array(advisory_id), lambda a: a.startswith("GHSA-"))).otherwise(F.filter(aliases, lambda a: a.startswith("GHSA-")))


def vulnerable(deps: DataFrame, advisories: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """Dependencies with the advisories of exactly their version, with folded severity and fix."""
    key = [F.lower("ecosystem").alias("_e"), F.lower("name").alias("_n"), F.col("version").alias("_v")]
    left = deps.select(*keys, "name", "version", "ecosystem", "manifest", *key)
    right = advisories.select(*key, "advisory_id", "summary", "aliases", "scores", "fixed")
    hits = left.join(right, ["_e", "_n", "_v"])
    return hits.select(
        *keys, "name", "version", "ecosystem", "manifest", "advisory_id", "summary", cvss_severity(F.col("scores")).alias("severity"), F.lit(95).alias("confidence"),
        fixed_version(F.col("fixed")).alias("fixed_version"), cve_ids(F.col("aliases")).alias("cve"), ghsa_ids(F.col("aliases"), F.col("advisory_id")).alias("ghsa"),
    )

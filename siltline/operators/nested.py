"""Deeply nested records as flat tables, by Dewey labels.

Every node of a record gets the ordinal path from the root as its label (``0.3.1``), so the parent of a node is its
label less the last component, and the nodes of one schema path make up one table. Only the nodes of wanted schema
paths leave the parser.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.session import cut

NODE_SCHEMA = "dewey string, schema_path string, kind string, value string"


def _strict(name: str):
    raise ValueError(name)


def parse_json(text: str | None) -> tuple[bool, object]:
    """(valid, value); NaN, Infinity and nesting beyond the parser's depth are invalid."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_strict)
    except (ValueError, RecursionError):
        return False, None


def plain_name(name: str) -> str:
    """Field names of all spellings alike: taint_path, taintPath and TaintPath are taintpath."""
    return name.replace("_", "").replace("-", "").lower()


def _unpacked(value: object) -> object:
    """A list or object given as JSON text, itself quoted any number of times, is that list or object."""
    inner = value
    while isinstance(inner, str) and inner.lstrip()[:1] in ("[", "{", '"'):
        ok, inner = parse_json(inner)
        if not ok:
            return value
    return inner if isinstance(inner, (dict, list)) else value


def label_nodes(root: object, lists: frozenset[str], wanted: Callable[[str], bool | str], packed: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, str, str | None]]:
    """(dewey, schema_path, kind, value) of the wanted nodes, parents first.

    In a schema path names are plain and list elements are ``[]``. A field of ``lists`` that holds a lone value is
    taken as a list of one; null is no list. JSON text is unpacked in the fields of ``packed`` only (``x[]`` means the
    elements of x); any other string stays as it is, whatever it begins with. Values of objects and lists are their
    JSON text, or null where ``wanted`` says "label".
    """
    stack: list[tuple[object, str, str, str]] = [(root, "0", "$", "")]
    while stack:
        value, dewey, path, name = stack.pop()
        if name in packed:
            value = _unpacked(value)
        if name in lists and value is not None and not isinstance(value, list):
            value = [value]
        kind = "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        want = wanted(path)
        if want:
            text = None if kind == "null" or want == "label" else value if kind == "string" else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
            yield dewey, path, kind, text
        if kind == "object":
            # an object's members are numbered in the order in which they stand
            stack.extend(reversed([(v, f"{dewey}.{i}", f"{path}.{plain_name(k)}", plain_name(k)) for i, (k, v) in enumerate(value.items())]))
        elif kind == "list":
            stack.extend(reversed([(v, f"{dewey}.{i}", f"{path}[]", f"{name}[]") for i, v in enumerate(value)]))


def dewey_parent(dewey: Column, levels: int = 1) -> Column:
    """The label cut by so many components; empty above the root."""
    return F.substring(dewey, F.lit(1), F.length(dewey) - F.length(F.substring_index(dewey, ".", -levels)) - 1) if levels else dewey


def dewey_ordinal(dewey: Column) -> Column:
    return F.substring_index(dewey, ".", -1).cast("int")


def shred(
    df: DataFrame, keys: Sequence[str], text: str, lists: Sequence[str] = (), wanted: str = ".", packed: Sequence[str] = (), latest_by: str | None = None, distinct: bool = True, valued: str = "."
) -> DataFrame:
    """One row per wanted node of each record: the keys, then dewey, schema_path, kind, value.

    ``wanted`` is a regular expression searched in schema paths, as is ``valued``: other nodes have no value. ``packed`` names the fields that may be JSON text.
    Of several deliveries with the same keys the one with the greatest ``latest_by`` counts (ties, and without
    ``latest_by``: the one whose text has the greatest hash). Null and invalid texts give no rows, but an invalid
    latest delivery stands for its record. Texts are parsed where they are read; deliveries are told apart by keys and
    hashes. Exact copies of a delivery give each node once, or without ``distinct`` once each, for callers that
    aggregate anyway.
    """
    names, inside = frozenset(map(plain_name, lists)), frozenset(map(plain_name, packed))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _hash long, " + NODE_SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, bool | str] = {}
        pattern, with_value = re.compile(wanted), re.compile(valued)

        def want(path: str) -> bool | str:
            if path not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[path] = pattern.search(path) is not None and (with_value.search(path) is not None or "label")
            return seen[path]

        for batch in batches:
            owners: list[int] = []
            nodes: list[tuple] = []
            for i, report in enumerate(batch["_text"]):
                ok, root = parse_json(report)
                if ok:
                    nodes.extend(label_nodes(root, names, want, inside))
                    owners.extend([i] * (len(nodes) - len(owners)))
            out = pd.DataFrame(nodes, columns=["dewey", "schema_path", "kind", "value"])
            for i, k in enumerate([*keys, "_hash"]):
                out.insert(i, k, batch.iloc[:, i].take(owners).array)
            yield out

    delivered = df.where(F.col(text).isNotNull()).select(*keys, F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("_text"), (F.col(latest_by) if latest_by else F.lit(0)).alias("_at"))
    newest = delivered.groupBy(*keys).agg(F.max_by("_hash", F.struct(F.col("_at").isNotNull(), "_at", "_hash")).alias("_hash"))
    nodes = delivered.select(*keys, "_hash", "_text").mapInPandas(run, schema)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"l.{c}")) for c in [*keys, "_hash"]]
    nodes = nodes.alias("n").join(newest.alias("l"), reduce(Column.__and__, same), "left_semi").drop("_hash")
    return nodes.dropDuplicates([*keys, "dewey"]) if distinct else nodes


def table_of(nodes: DataFrame, keys: Sequence[str], path: str, fields: Mapping[str, str], levels: int = 1) -> DataFrame:
    """The nodes of one schema path as a table: keys, dewey, parent_dewey and a column of text for each field.

    ``path`` is a regular expression of the whole schema path of the table's rows, a field's one of the path below it.
    A row is a node with any of the fields; its label is that of the field less one component a step, and its parent's
    label is its own less ``levels`` components. Of equal fields of a row the greatest value counts.
    """
    at = F.col("schema_path")
    row, columns = F.lit(None).cast("string"), []
    for name, below in fields.items():
        here = at.rlike(f"^{path}{below}$")
        row = F.when(here, dewey_parent(F.col("dewey"), len(re.findall(r"\\\.|\[\\?\]", below)) or 1)).otherwise(row)
        columns.append(F.max(F.when(here, F.col("value"))).alias(name))
    rows = nodes.withColumn("_row", row).where(F.col("_row").isNotNull()).groupBy(*keys, F.col("_row").alias("dewey")).agg(*columns)
    return rows.select(*keys, "dewey", dewey_parent(F.col("dewey"), levels).alias("parent_dewey"), *fields)


# -- reports of the scanner --------------------------------------------------------------------------------------------

REPORT_LISTS = ("findings", "taintPath", "evidenceChain", "attackPath")
#: Fields, and elements of lists, that may be given as JSON text.
REPORT_PACKED = (*REPORT_LISTS, "findings[]", "taintPath[]", "ai", "aiAnalysis", "riskScore", "contributors", "contributors[]", "result", "scanners", "tool")
_FINDING = r"\$\.(?:.*\.)?findings\[\]"
_AI = r"\.(?:ai|aianalysis)"
#: Schema path of each child list's elements below a finding, and the levels from an element up to its finding.
CHILDREN = {"taint_step": (r"\.taintpath\[\]", 2), "evidence_step": (r"\.evidencechain\[\]", 2), "attack_step": (_AI + r"\.attackpath\[\]", 3)}
_FINDING_FIELDS = {
    "finding_id": r"\.findingid", "rule_id": r"\.id", "scanner": r"\.scanner", "category": r"\.category", "severity": r"\.severity", "confidence": r"\.confidence", "title": r"\.title",
    "file": r"\.file", "line": r"\.line", "ai_verdict": _AI + r"\.verdict", "ai_confidence": _AI + r"\.confidence", "ai_severity": _AI + r"\.severity",
}
_HEAD_FIELDS = {"tool_name": r"\.tool\.name", "tool_version": r"\.tool\.version", "target": r"\.target", "score": r"\.riskscore\.score"}
_PART, _PART_FIELDS = r"\$\.riskscore\.contributors\[\]", {"name": r"\.name", "count": r"\.count"}


def report_nodes(reports: DataFrame, wanted: str = ".", distinct: bool = True, valued: str = ".") -> DataFrame:
    """The nodes of the report received last of each scan."""
    return shred(reports, ["scan_id"], "report", REPORT_LISTS, wanted, REPORT_PACKED, "received_at" if "received_at" in reports.columns else None, distinct, valued)


_STEPS = "|".join([rf"^{_FINDING}\.findingid$", *(rf"^{_FINDING}{p}$" for p, _ in CHILDREN.values())])


def _steps(nodes: DataFrame) -> DataFrame:
    # the parser took wanted paths only, so the last name tells an id or an element of which list a node is
    path = F.col("schema_path")
    child, owner = F.lit(None).cast("string"), F.when(path.endswith(".findingid"), dewey_parent(F.col("dewey"), 1))
    for name, (below, levels) in CHILDREN.items():
        here = path.endswith("." + re.sub(r"^.*\\\.|\\", "", below))
        child, owner = F.when(here, name).otherwise(child), F.when(here, dewey_parent(F.col("dewey"), levels)).otherwise(owner)
    steps = nodes.select("scan_id", owner.alias("finding_dewey"), child.alias("child"), dewey_ordinal(F.col("dewey")).alias("child_no"), "kind", "value").where("finding_dewey is not null")
    # ids and steps of a finding meet by its label: one aggregate over (scan, label), no join of the table with itself
    found = F.expr("try_cast(trim(value) as bigint)")
    grouped = steps.groupBy("scan_id", "finding_dewey").agg(
        F.max(F.when(F.col("child").isNull(), found)).alias("finding_id"),
        F.collect_set(F.when(F.col("child").isNotNull() & (F.col("kind") != "null"), F.struct("child", "child_no", "value"))).alias("steps"),
    )
    return grouped.select("scan_id", "finding_id", "finding_dewey", F.explode("steps").alias("s")).select(
        "scan_id", "finding_id", "s.child", "s.child_no", "finding_dewey", "s.value"
    )


def report_steps(reports: DataFrame) -> DataFrame:
    """(scan_id, finding_id, child, child_no, finding_dewey, value): the elements of all child lists; null elements keep their position but are no rows."""
    return _steps(report_nodes(reports, _STEPS, distinct=False))


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """Flat tables with parent keys: reports, findings, steps, contributors. Reports are parsed once for all of them.

    reports and findings carry (scan_id, dewey); the rows below carry the label of their parent.
    """
    paths = [r"^\$$", *(rf"^\${p}$" for p in _HEAD_FIELDS.values()), *(f"^{_FINDING}{p}$" for p in _FINDING_FIELDS.values()), *(f"^{_PART}{p}$" for p in _PART_FIELDS.values()), _STEPS]
    nodes = cut(report_nodes(reports, "|".join(paths), distinct=False))
    findings = table_of(nodes, ["scan_id"], _FINDING, _FINDING_FIELDS, 2)
    for name, kind in (("finding_id", "bigint"), ("confidence", "int"), ("line", "int"), ("ai_confidence", "double")):
        findings = findings.withColumn(name, F.expr(f"try_cast({name} as {kind})"))
    path = F.col("schema_path")
    heads = nodes.groupBy("scan_id").agg(
        F.count_if(path == "$").alias("_n"), *[F.max(F.when(path.rlike(rf"^\${p}$"), F.col("value"))).alias(n) for n, p in _HEAD_FIELDS.items()]
    ).where("_n > 0").drop("_n").withColumn("score", F.expr("try_cast(score as int)")).withColumn("dewey", F.lit("0"))
    parts = table_of(nodes, ["scan_id"], _PART, _PART_FIELDS, 2).withColumn("count", F.expr("try_cast(count as bigint)"))
    return {"reports": heads, "findings": findings, "steps": _steps(nodes), "contributors": parts}


def report_children(reports: DataFrame) -> DataFrame:
    """(scan_id, finding_id, child, child_no) of every step, distinct."""
    nodes = report_nodes(reports, _STEPS, distinct=False, valued=r"\.findingid$")  # the values of steps aren't asked for
    return _steps(nodes).select("scan_id", "finding_id", "child", "child_no").distinct()

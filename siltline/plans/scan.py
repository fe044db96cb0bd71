"""A scan: files in, classified findings, scores and summaries out."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions.javascript import script_findings
from siltline.functions.text import mask_secret
from siltline.operators import detect
from siltline.operators import findings as O
from siltline.session import cut
from siltline.sources import history, manifests
from siltline.sources.signatures import yara_matches
from siltline.sources.tree import Coverage, Limits, read_tree


log = logging.getLogger("siltline")


@dataclass
class Config:
    """What to run. Focus flags restrict the scanners, ``disabled`` takes single ones out.

    ``offline`` consults no advisories, ``yara_rules`` is the rule file of the signature scanner, ``asked`` names the
    optional engines whose status a report shall tell (yara, sandbox, clamav).
    """

    deep: bool = False
    full: bool = False
    security: bool = False
    malware: bool = False
    secrets: bool = False
    deps: bool = False
    config: bool = False
    no_deps: bool = False
    no_git: bool = False
    in_container: bool = False
    offline: bool = False
    yara_rules: str | None = None
    asked: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    limits: Limits = field(default_factory=Limits)

    def enabled(self, scanner: str) -> bool:
        """The off switches come first, then full, then the focus, then the configuration."""
        if scanner == "dependencies" and self.no_deps or scanner == "git" and self.no_git:
            return False
        if self.full:
            return True
        focus = {
            "secrets": self.secrets, "sast": self.security, "malware": self.malware, "suspicious": self.malware, "dependencies": self.deps, "configuration": self.config,
            "yara": self.malware or self.security, "binaries": self.malware or self.security, "archives": self.malware or self.security, "git": self.secrets,
        }
        if self.security or self.malware or self.secrets or self.deps or self.config:
            return focus.get(scanner, False)
        return scanner not in self.disabled or scanner in ("suspicious", "permissions")


@dataclass
class Result:
    findings: DataFrame
    suppressed: DataFrame | None
    files: DataFrame
    runs: list[dict]
    seconds: float

    def report(self) -> dict:
        """Summaries of the whole scan, a few numbers on the driver."""
        every = self.findings if self.suppressed is None else self.findings.unionByName(self.suppressed)
        first = lambda df: (df.first() or {}) and df.first().asDict()
        return {
            "summary": first(O.severity_summary(every)), "risk": first(O.risk_score(every)), "active_risk": first(O.risk_score(self.findings)), "classes": first(O.classification_summary(every)),
            "security": first(O.security_summary(every)), "languages": {r["language"]: r["count"] for r in self.files.where("language is not null").groupBy("language").count().collect()},
            "scanners": self.runs, "seconds": self.seconds,
        }


Detector = Callable[[DataFrame, DataFrame, Config], DataFrame]


def _sast(files: DataFrame, lines: DataFrame, config: Config) -> DataFrame:
    return script_findings(files, ("rel_path",)).unionByName(detect.chain_findings(files))


def _configuration(files, lines, config):
    return reduce(DataFrame.unionByName, [detect.environment_files(files), detect.root_images(lines), detect.workflow_checkouts(lines), detect.open_ports(lines)])


def _suspicious(files, lines, config):
    hooks = manifests.hook_findings(files).where("scanner = 'suspicious'")
    return detect.decoded_evaluation(files).unionByName(detect.large_literals(files)).unionByName(hooks)


#: Detectors by scanner, in arrival order; more can be registered. The line rules of all scanners run apart, in one pass.
REGISTRY: dict[str, Detector] = {
    "secrets": lambda files, lines, config: detect.masked_values(detect.secret_findings(lines).drop("entropy")).unionByName(detect.key_block_findings(files)),
    "sast": _sast,
    "dependencies": lambda files, lines, config: manifests.hook_findings(files).where("scanner = 'dependencies'"),
    "malware": lambda files, lines, config: detect.disguised_files(files),
    "suspicious": _suspicious,
    "configuration": _configuration,
    "binaries": lambda files, lines, config: detect.binary_findings(files),
    "archives": lambda files, lines, config: detect.archive_findings(files),
    "permissions": lambda files, lines, config: detect.writable_files(files, in_container=config.in_container),
}


def register(scanner: str, detector: Detector) -> None:
    """Adds a detector: (files, lines, config) to findings with the columns of detect._finding and rel_path."""
    REGISTRY[scanner] = detector
    if scanner not in detect.SCANNERS:
        detect.SCANNERS = (*detect.SCANNERS, scanner)


def _advisory_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """A finding for each dependency with an advisory of its very version; the advisory's id is the rule."""
    hits = manifests.vulnerable(manifests.dependencies(files), advisories)
    rule = detect.R.Rule("DEP-001", "dependencies", "Dependencies", "HIGH", 95, "affected release", cwe=("CWE-1395",))
    evidence = F.concat_ws(" ", "name", "version", F.concat(F.lit("fixed in "), F.col("fixed_version")))
    columns = [c for c in detect._finding(rule, evidence) if c._jc.toString().rsplit(" AS ", 1)[-1] not in ("rule_id", "severity")]
    return hits.select("rel_path", F.col("advisory_id").alias("rule_id"), "severity", *columns)


def parts_of(files: DataFrame, config: Config = Config(), registry: dict[str, Detector] | None = None, advisories: DataFrame | None = None, threats: DataFrame | None = None) -> tuple[dict[str, DataFrame], list[dict]]:
    """The findings of each enabled scanner, and of all line rules together, as plans; and the runs known so far.

    A scanner whose plan can't be built is an error that takes no other with it.
    """
    lines = detect.to_lines(files)
    chosen = registry or REGISTRY
    parts: dict[str, DataFrame] = {}
    runs: list[dict] = []
    rules = tuple(r for r in detect.R.LINE_RULES if r.scanner in chosen and config.enabled(r.scanner))
    made = {s: (lambda d=d: d(files, lines, config)) for s, d in chosen.items() if config.enabled(s)}
    made |= {"line rules": lambda: detect.line_findings(lines, ("rel_path",), rules)} if rules else {}
    if advisories is not None and config.enabled("dependencies") and not config.offline:
        made["advisories"] = lambda: _advisory_findings(files, advisories)
    if threats is not None and config.enabled("malware"):
        made["threats"] = lambda: detect.known_hashes(files, threats)
    for scanner, make in made.items():
        try:
            parts[scanner] = O.classify(detect.complete(make()).withColumnRenamed("rel_path", "file"))
        except Exception as error:  # one scanner must not take the others with it
            runs.append({"scanner": scanner, "status": "error", "message": str(error)[:200]})
    runs += [{"scanner": s, "status": "skipped"} for s in chosen if not config.enabled(s)]
    if "advisories" not in made:
        runs.append({"scanner": "advisories", "status": "skipped", "message": "offline" if config.offline else "no table of advisories"})
    for scanner, reason in (("sandbox", "nothing is executed"), ("clamav", "not built in")):
        if scanner == "sandbox" or scanner in config.asked:
            runs.append({"scanner": scanner, "status": "unavailable", "message": reason})
    return parts, runs


def _joined(parts: Sequence[DataFrame], files: DataFrame) -> DataFrame:
    if not parts:
        return O.classify(detect.complete(detect.disguised_files(files)).limit(0).withColumnRenamed("rel_path", "file"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def findings_of(files: DataFrame, config: Config = Config(), registry: dict[str, Detector] | None = None, advisories: DataFrame | None = None, threats: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """All findings of described files, classified, as one plan that hasn't run; and the runs, "planned" where nothing else is known.

    advisories: ecosystem, name, version, advisory_id, summary, aliases, scores, fixed. threats: sha256, name.
    """
    parts, runs = parts_of(files, config, registry, advisories, threats)
    return _joined(list(parts.values()), files), [{"scanner": s, "status": "planned"} for s in parts] + runs


def _executed(parts: dict[str, DataFrame], files: DataFrame) -> tuple[DataFrame, list[dict]]:
    """The findings, cut, and how each scanner fared. All run together; only if that fails they run one by one."""
    try:
        return cut(_joined(list(parts.values()), files)), [{"scanner": s, "status": "completed"} for s in parts]
    except Exception as together:
        log.warning("scanners run one by one: %s", str(together)[:200])
    done, runs = [], []
    for scanner, part in parts.items():
        try:
            done.append(cut(part))
            runs.append({"scanner": scanner, "status": "completed"})
        except Exception as error:  # the others go on
            runs.append({"scanner": scanner, "status": "error", "message": str(error)[:200]})
    return cut(_joined(done, files)), runs


def _history_findings(spark: SparkSession, text: str) -> DataFrame:
    past = history.history_secrets(history.added_lines(history.log_frame(spark, text)))
    return past.select(
        F.col("file"), "rule_id", F.lit("git").alias("scanner"), "category", "severity", "confidence", F.lit("needs_review").alias("classification"), F.concat(F.lit("secret in commit "), F.coalesce("commit", F.lit("?"))).alias("title"), "line",
        mask_secret(F.col("value")).alias("evidence"), mask_secret(F.col("value")).alias("redacted_evidence"), (F.lit(8_000_000_000) + F.col("line")).cast("bigint").alias("seq"),
    )


def scan(spark: SparkSession, root: str, config: Config = Config(), baseline: DataFrame | None = None, advisories: DataFrame | None = None, threats: DataFrame | None = None) -> Result:
    """Reads the tree once, runs the enabled scanners, takes what the baseline knows out of the active findings."""
    began = time.time()
    coverage = Coverage()
    files = cut(read_tree(spark, root, config.ignore, config.limits, coverage))
    parts, runs = parts_of(files, config, advisories=advisories, threats=threats)
    if config.enabled("git") and (config.deep or config.full or config.secrets):
        run, text = history.read_log(root)
        if text:
            parts["git"] = _history_findings(spark, text)
        else:
            runs.append(run)
    if config.yara_rules and config.enabled("yara"):
        status, matches = yara_matches(spark, config.yara_rules, root)
        if status == "completed":
            parts["yara"] = O.classify(detect.complete(detect.signature_findings(matches)).withColumnRenamed("rel_path", "file"))
        else:
            runs.append({"scanner": "yara", "status": status})
    else:
        runs.append({"scanner": "yara", "status": "unavailable", "message": "no rules"})
    found, done = _executed(parts, files)
    runs = [coverage.run(), *done, *runs]
    for run in runs:
        log.info("%s: %s", run["scanner"], run["status"])
    active, suppressed = O.apply_baseline(found, baseline) if baseline is not None else (found, None)
    return Result(active, suppressed, files, runs, time.time() - began)


def exit_code(result: Result, threshold: str = "high") -> int:
    row = O.gate(result.findings, threshold).first()
    return int(bool(row and row["failed"]))


def candidates_for_model(result: Result, most: int = 15) -> Sequence:
    return O.model_candidates(result.findings, most).collect()

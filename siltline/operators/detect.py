"""Detectors: files and lines in, findings out, as column expressions.

``files`` has rel_path, language, content or text; ``lines`` has rel_path, language, line and text. Extra key columns
are carried through by ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltline.functions.paths import basename
from siltline.functions.text import is_placeholder, mask_secret, sanitized, shannon_entropy, split_lines, trimmed
from siltline.operators.findings import adjusted_confidence
from siltline.plans import rules as R

#: Arrival order of the scanners, which decides which of equal findings comes first.
SCANNERS = ("secrets", "sast", "dependencies", "malware", "suspicious", "configuration", "binaries", "archives", "git", "permissions", "yara")
_LINE_SPACE, _RULE_SPACE = 10_000_000, 100

_TEXTS = "array<string>"


def text_of(content: Column) -> Column:
    """Lossy text: bytes that aren't UTF-8 become U+FFFD."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def to_lines(files: DataFrame, keys: Sequence[str] = ("rel_path",), text: str = "text") -> DataFrame:
    """One row per line, numbered from 1; null texts have no lines."""
    carried = [*keys, *(["language"] if "language" in files.columns else [])]
    return files.where(F.col(text).isNotNull()).select(*carried, F.posexplode(split_lines(F.col(text))).alias("_pos", "line_text")).select(
        *carried, (F.col("_pos") + 1).alias("line"), F.col("line_text").alias("text")
    )


def _finding(rule: R.Rule, evidence: Column, confidence: Column | int | None = None, line: Column | None = None, title: Column | None = None, order: int = 0, **more: Column) -> list[Column]:
    """The columns of one rule's findings."""
    line = F.lit(None).cast("int") if line is None else line.cast("int")
    seq = F.lit(SCANNERS.index(rule.scanner)).cast("bigint") * _LINE_SPACE * _RULE_SPACE + F.coalesce(line, F.lit(0)).cast("bigint") * _RULE_SPACE + order
    null = lambda kind: F.lit(None).cast(kind)
    return [
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.scanner).alias("scanner"), F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"),
        (F.lit(rule.confidence) if confidence is None else F.lit(confidence) if isinstance(confidence, int) else confidence).cast("int").alias("confidence"),
        F.lit(rule.classification).cast("string").alias("classification"), (F.lit(rule.title) if title is None else title).alias("title"), line.alias("line"),
        more.get("col", null("int")).cast("int").alias("col"), evidence.alias("evidence"), more.get("chain", null(_TEXTS)).alias("evidence_chain"), more.get("behaviours", null(_TEXTS)).alias("behavior_categories"),
        F.array(*[F.lit(c) for c in rule.cwe]).cast(_TEXTS).alias("cwe"), more.get("taint", null("array<struct<file:string,line:int,description:string,code_snippet:string>>")).alias("taint_path"),
        more.get("metadata", null("map<string,string>")).alias("metadata"), seq.alias("seq"),
    ]


def _commented(language: Column, text: Column) -> Column:
    """Lines that are comments, by the rules of the language's analysis."""
    return F.when(language == "python", text.startswith("#")).when(language == "dockerfile", text.startswith("#")).when(language == "php", text.rlike(r"^(?:#|//|/\*)")).otherwise(text.rlike("^(?:#|//)"))


def line_findings(lines: DataFrame, keys: Sequence[str] = ("rel_path",), rules: Sequence[R.Rule] = R.LINE_RULES) -> DataFrame:
    """One finding per line and rule, for all line rules in one pass over the lines.

    Patterns are literals of the plan: each line is trimmed once and tested against each rule of its language; only
    lines with a hit leave the scan.
    """
    text, language = F.col("_t"), F.coalesce(F.col("language"), F.lit(""))
    hits = []
    for order, rule in enumerate(rules):
        test = text.rlike(rule.pattern)
        if rule.languages:
            test = language.isin(*rule.languages) & test
        elif rule.scanner == "sast":
            test = (language != "") & test
        if rule.excluded:
            test = test & ~text.contains(rule.excluded)
        hits.append(F.when(test, F.struct(F.lit(order).alias("order"))))
    rows = lines.withColumn("_t", trimmed(F.col("text")))
    found = rows.select(*keys, "language", "line", "_t", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("_hits")).where((F.size("_hits") > 0) & ~_commented(language, text))
    found = found.select(*keys, "line", "_t", F.explode("_hits.order").alias("_order"))
    pick = lambda value, kind: F.element_at(F.array(*[F.lit(value(r)).cast(kind) for r in rules]), F.col("_order") + 1)
    php_input = (pick(lambda r: r.languages == ("php",) and r.rule_id == "SEC-001", "boolean")) & F.col("_t").rlike(r"(?i)\$_(?:GET|POST|REQUEST|COOKIE|SERVER)")
    line = F.col("line").cast("int")
    seq = pick(lambda r: SCANNERS.index(r.scanner), "bigint") * _LINE_SPACE * _RULE_SPACE + line.cast("bigint") * _RULE_SPACE + F.col("_order")
    columns = _finding(rules[0], F.col("_t"), line=line)
    named = {c._jc.toString().rsplit(" AS ", 1)[-1]: c for c in columns}
    named |= {
        "rule_id": pick(lambda r: r.rule_id, "string"), "scanner": pick(lambda r: r.scanner, "string"), "category": pick(lambda r: r.category, "string"), "severity": pick(lambda r: r.severity, "string"),
        "confidence": F.when(php_input, 98).otherwise(pick(lambda r: r.confidence, "int")), "classification": pick(lambda r: r.classification, "string"),
        "title": F.when(php_input, "shell command with request data").otherwise(pick(lambda r: r.title, "string")), "cwe": F.element_at(F.array(*[F.array(*[F.lit(c) for c in r.cwe]) for r in rules]), F.col("_order") + 1), "seq": seq,
    }
    return found.select(*keys, *[c.alias(n) for n, c in named.items()])


def secret_values(lines: DataFrame, columns: Sequence[str], rules: Sequence[R.Rule] = R.SECRETS) -> DataFrame:
    """The columns, the rule's number as ``_order`` and each ``value`` that the rule finds in ``text``.

    A rule's pattern runs only on lines with one of its hints; lines without any leave first.
    """
    text = F.col("text")
    hinted = [reduce(Column.__or__, [text.contains(h) for h in r.hints or (":", "=")]) for r in rules]
    hinted = [h if r.hints else h & text.rlike(r.pattern) for h, r in zip(hinted, rules)]
    none = F.array().cast(_TEXTS)
    each = F.array(*[F.struct(F.lit(i).alias("order"), F.when(h, F.regexp_extract_all(F.col("text"), F.lit(r.pattern), F.lit(r.group))).otherwise(none).alias("values")) for i, (r, h) in enumerate(zip(rules, hinted))])
    kept = F.filter(each, lambda m: F.size(m["values"]) > 0)
    return lines.where(reduce(Column.__or__, hinted)).select(*columns, F.explode(kept).alias("_m")).select(*columns, F.col("_m.order").alias("_order"), F.explode("_m.values").alias("value"))


def secret_findings(lines: DataFrame, keys: Sequence[str] = ("rel_path",), rules: Sequence[R.Rule] = R.SECRETS, minimum: int = 6, adjust: bool = True) -> DataFrame:
    """Every match of every secret rule in every line: value, entropy and confidence.

    Values shorter than the minimum, placeholders and values below a rule's entropy are left out.
    """
    found = secret_values(lines, (*keys, "line"), rules)
    pick = lambda value, kind: F.element_at(F.array(*[F.lit(value(r)).cast(kind) for r in rules]), F.col("_order") + 1)
    found = found.where((F.length("value") >= minimum) & ~is_placeholder(F.col("value"))).withColumn("entropy", shannon_entropy(F.col("value")))
    least = pick(lambda r: r.min_entropy, "double")
    found = found.where(least.isNull() | (F.col("entropy") >= least))
    base = pick(lambda r: r.confidence, "int")
    test_file = F.col(keys[-1]).cast("string").rlike(r"(?i)(?:^|/)tests?/|[._-](?:test|spec)\.")
    line = F.col("line").cast("int")
    return found.select(
        *keys, pick(lambda r: r.rule_id, "string").alias("rule_id"), F.lit("secrets").alias("scanner"), F.lit("Secrets").alias("category"), pick(lambda r: r.severity, "string").alias("severity"),
        (adjusted_confidence(base, test_file=test_file, entropy=F.col("entropy")) if adjust else base).alias("confidence"), F.lit(None).cast("string").alias("classification"),
        pick(lambda r: r.title, "string").alias("title"), line.alias("line"), F.lit(None).cast("int").alias("col"), F.col("value").alias("evidence"), F.lit(None).cast(_TEXTS).alias("evidence_chain"),
        F.lit(None).cast(_TEXTS).alias("behavior_categories"), F.array(F.lit("CWE-798")).alias("cwe"),
        F.lit(None).cast("array<struct<file:string,line:int,description:string,code_snippet:string>>").alias("taint_path"), F.lit(None).cast("map<string,string>").alias("metadata"),
        (line.cast("bigint") * _RULE_SPACE + F.col("_order")).alias("seq"), F.round("entropy", 6).alias("entropy"),
    )


def key_block_findings(files: DataFrame, keys: Sequence[str] = ("rel_path",), text: str = "text") -> DataFrame:
    """Private key blocks in whole texts, with the line on which each begins."""
    rule = R.KEY_BLOCK
    hits = files.where(F.col(text).contains("PRIVATE KEY-----")).select(*keys, F.col(text).alias("_text"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))).alias("_n", "_block"))
    line = F.size(F.split(F.expr("substring(_text, 1, position(_block in _text) - 1)"), "\n", -1))
    return hits.select(*keys, *_finding(rule, F.lit("-----BEGIN PRIVATE KEY-----"), line=line, order=99))


# -- whole files ---------------------------------------------------------------------------------------------------------

# Parts of a behaviour chain in scripts.
_CREDENTIAL_PLACES = r"(?i)\.ssh|\.aws|\.npmrc|\.git-credentials|id_rsa|process\.env|\.env\b|credentials|keychain|Login Data|wallet"
_READS = r"(?i)(?:readFileSync|readFile|createReadStream|JSON\.stringify\(process\.env\))"
_ENCODES = r"(?i)(?:toString\(['\"]base64['\"]\)|Buffer\.from\([^)]+['\"]base64['\"]\)|btoa\(|String\.fromCharCode)"
_SENDS = r"(?i)(?:fetch\s*\(|axios\.(?:post|put)|https?\.request|net\.connect|new\s+WebSocket|https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"
_RUNS = r"(?i)(?:child_process\.exec|execSync|spawnSync|eval\s*\(|new\s+Function)"


def chain_findings(files: DataFrame, keys: Sequence[str] = ("rel_path",), text: str = "text") -> DataFrame:
    """Scripts that read credentials and talk to the network: the steps seen, in the order of the chain."""
    t = F.col(text)
    steps = (("reads credentials", t.rlike(_CREDENTIAL_PLACES) & t.rlike(_READS)), ("encodes them", t.rlike(_ENCODES)), ("talks to the network", t.rlike(_SENDS)), ("runs code", t.rlike(_RUNS)))
    seen = F.filter(F.array(*[F.when(test, name) for name, test in steps]), lambda x: x.isNotNull())
    rows = files.where(F.col("language").isin("javascript", "typescript")).select(*keys, seen.alias("_steps"))
    rows = rows.where(F.array_contains("_steps", steps[0][0]) & F.array_contains("_steps", steps[2][0]))
    chain = F.transform(F.col("_steps"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    confidence = F.when(F.array_contains("_steps", steps[3][0]), 99).otherwise(96)
    return rows.select(*keys, *_finding(R.by_id("MAL-CHAIN-001"), F.array_join(chain, "; "), confidence, F.lit(1), order=90, chain=chain, behaviours=F.col("_steps")))


def environment_files(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    base = basename(F.col("rel_path"))
    return files.where(base.startswith(".env") & ~base.rlike(r"\.(?:example|sample|template)")).select(*keys, *_finding(R.by_id("CONFIG-007"), base))


def root_images(lines: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """Image files of more than three lines whose last stage sets no user but root; users with the digit 0 count as root."""
    text = trimmed(F.col("text"))
    rows = lines.where("language = 'dockerfile'").select(*keys, "line", F.when(text.startswith("#"), "").otherwise(text).alias("_t"))
    from_line, user = F.col("_t").rlike(r"(?i)^FROM\s+"), F.col("_t").rlike(r"(?i)^USER\s+") & ~F.col("_t").rlike("root|0")
    grouped = rows.groupBy(*keys).agg(F.max(F.when(from_line, F.col("line"))).alias("_from"), F.max(F.when(user, F.col("line"))).alias("_user"), F.count("*").alias("_n"))
    bad = grouped.where((F.col("_n") > 3) & (F.col("_user").isNull() | (F.col("_user") < F.coalesce("_from", F.lit(0)))))
    return bad.select(*keys, *_finding(R.by_id("CONFIG-001"), F.lit("no other user in the last stage"), line=F.coalesce("_from", F.lit(1))))


def workflow_checkouts(lines: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """The first checkout after a pull_request_target line, in workflows that name a pull request's head."""
    file = Window.partitionBy(*keys)
    text = trimmed(F.col("text"))
    rows = lines.where(F.translate("rel_path", "\\", "/").contains(".github/workflows")).select(*keys, "line", text.alias("_t"))
    rows = rows.withColumn("_seen", F.max(F.col("_t").rlike(r"(?i)pull_request_target\s*:") | (F.col("_t") == "pull_request_target")).over(file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_head", F.max(F.col("_t").rlike(r"(?i)ref:\s*\$\{\{\s*github\.event\.pull_request\.head")).over(file))
    hits = rows.where(F.col("_seen") & F.col("_head") & F.col("_t").rlike(r"(?i)actions/checkout"))
    first = hits.groupBy(*keys).agg(F.min(F.struct("line", "_t")).alias("_f"))
    return first.select(*keys, *_finding(R.by_id("CONFIG-004"), F.col("_f._t"), line=F.col("_f.line")))


def open_ports(lines: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """The first rule open to all addresses, in infrastructure files that name port 22 or 3389 anywhere."""
    rows = lines.where("language = 'terraform'").select(*keys, "line", trimmed(F.col("text")).alias("_t"))
    hit = F.when(F.col("_t").rlike(r"(?i)cidr_blocks\s*=\s*\[\s*[\"']0\.0\.0\.0/0[\"']\s*\]"), F.struct("line", "_t"))
    grouped = rows.groupBy(*keys).agg(F.min(hit).alias("_f"), F.bool_or(F.col("_t").rlike("22|3389")).alias("_port"))
    return grouped.where("_port and _f is not null").select(*keys, *_finding(R.by_id("CONFIG-006"), F.col("_f._t"), line=F.col("_f.line")))


def disguised_files(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    return files.where("is_disguised").select(*keys, *_finding(R.by_id("MAL-005"), F.concat(F.lit("program named "), basename(F.col("rel_path")))))


def known_hashes(files: DataFrame, threats: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """Files whose SHA-256 stands in the table of threats (sha256, name); computed from the content where it is missing."""
    sha = F.lower(F.coalesce(F.col("sha256"), F.sha2("content", 256)))
    hits = files.select(*keys, sha.alias("_sha")).join(threats.select(F.lower("sha256").alias("_sha"), F.col("name").alias("_threat")).distinct(), "_sha")
    return hits.select(*keys, *_finding(R.by_id("MAL-006"), F.col("_sha"), metadata=F.create_map(F.lit("threatIntelMatch"), F.col("_threat"))))


def decoded_evaluation(files: DataFrame, keys: Sequence[str] = ("rel_path",), text: str = "text") -> DataFrame:
    t = F.col(text)
    test = t.rlike(r"(?i)eval\s*\(\s*(?:String\.fromCharCode|atob|Buffer\.from\s*\([^)]*['\"]base64['\"]\))") | t.rlike(r"(?i)\b(?:Function|eval)\s*\(\s*[\"']\\x[0-9a-fA-F]{2}") | (t.contains("String.fromCharCode") & t.rlike(r"\beval\s*\("))
    return _readable(files).where(test).select(*keys, *_finding(R.by_id("SUSP-001"), F.lit("decoded text is evaluated")))


def _readable(files: DataFrame) -> DataFrame:
    return files.where(~basename(F.col("rel_path")).rlike(r"\.min\.js$|\.bundle\.js$|\.min\.css$"))


def large_literals(files: DataFrame, keys: Sequence[str] = ("rel_path",), text: str = "text") -> DataFrame:
    """The first quoted literal of 400 or more characters whose entropy is above 5.5."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"['\"`]([A-Za-z0-9+/=]{400,})['\"`]"), F.lit(1))
    rows = _readable(files).where(F.col("language").isin("javascript", "typescript", "python") & F.col(text).rlike(r"['\"`][A-Za-z0-9+/=]{400,}['\"`]"))
    first = rows.select(*keys, F.try_element_at(F.filter(found, lambda x: shannon_entropy(x) > 5.5), F.lit(1)).alias("_v")).where("_v is not null")
    return first.select(*keys, *_finding(R.by_id("SUSP-002"), F.concat(F.substring("_v", 1, 30), F.lit("... ["), F.length("_v").cast("string"), F.lit(" characters]"))))


def writable_files(files: DataFrame, keys: Sequence[str] = ("rel_path",), in_container: bool = False) -> DataFrame:
    """Files that all may write: secret ones, and, outside of containers, programs and scripts."""
    path, base = F.col("rel_path"), basename(F.col("rel_path"))
    template = path.rlike(r"(?i)\.(?:example|sample|template|dist|default|test)$|(?:example|sample|template)\.env$")
    secret = base.rlike(r"(?i)^\.env(?:\.(?:local|production|prod|development|dev|staging|stage|secret|vault))?$") | path.contains("id_rsa") | base.rlike(r"\.(?:key|pem)$") | (base == ".npmrc")
    writable = (F.col("mode").bitwiseAND(2) != 0) & ~template
    runs = (F.col("mode").bitwiseAND(1) != 0) | base.rlike(r"\.(?:sh|bash|py|pl|rb|js|ps1)$")
    mode = F.concat(F.lit("mode "), F.conv(F.col("mode").bitwiseAND(0o777).cast("string"), 10, 8))
    first = files.where(writable & secret).select(*keys, *_finding(R.by_id("PERM-001"), mode))
    if in_container:
        return first
    return first.unionByName(files.where(writable & ~secret & runs).select(*keys, *_finding(R.by_id("PERM-002"), mode, order=1)))


def binary_findings(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """Programs in the tree, and commands among their printable strings."""
    from siltline.functions.binary import printable_strings

    universe = files.where("is_binary or is_executable")
    low = R.Rule("MAL-005", "binaries", "Binary", "LOW", 60, "program in the tree", classification="needs_review", cwe=("CWE-506",))
    high = R.Rule("MAL-001", "binaries", "Binary", "CRITICAL", 90, "command inside a program", classification="potentially_malicious", cwe=("CWE-506",))
    base = basename(F.col("rel_path"))
    a = universe.where(F.col("is_binary") & base.rlike(r"(?i)\.(?:exe|dll|so|dylib|bin)$")).select(*keys, *_finding(low, base))
    text = F.array_join(printable_strings(F.col("content")), "\n")
    command = r"(?i)powershell.*-(?:enc|encodedcommand)|IEX\s*\(New-Object|cmd\.exe\s*/c|nc\s+-e\s+/bin/sh|/bin/bash\s+-i|HKEY_LOCAL_MACHINE\\Software\\Microsoft\\Windows\\CurrentVersion\\Run"
    b = universe.where(text.rlike(command)).select(*keys, *_finding(high, F.regexp_extract(text, command, 0), order=1))
    return a.unionByName(b)


def signature_findings(matches: DataFrame) -> DataFrame:
    """One finding for each match (rule, rel_path) of the outside signature scanner."""
    rule = R.Rule("MAL-001", "yara", "Malware Indicator", "HIGH", 90, "signature matched", cwe=("CWE-506",))
    return matches.select("rel_path", *_finding(rule, F.concat(F.lit("signature "), F.col("rule")), title=F.concat(F.lit("signature matched: "), F.col("rule"))))


def archive_findings(files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """ZIP archives that unpack to far more than their size, or outside of their folder."""
    from siltline.functions.binary import zip_report

    zips = files.where(F.hex(F.substring("content", 1, 2)) == "504B").select(*keys, zip_report("content").alias("z"))
    bomb = R.Rule("MAL-005", "archives", "Archive", "HIGH", 90, "archive unpacks to far more than its size", cwe=("CWE-409",))
    outside = R.Rule("SEC-005", "archives", "Archive", "CRITICAL", 95, "archive entry leaves its folder", cwe=("CWE-22",))
    note = F.array_join(F.col("z.notes"), "; ")
    return zips.where("z.bomb").select(*keys, *_finding(bomb, note)).unionByName(zips.where("z.traversal").select(*keys, *_finding(outside, note, order=1)))


def masked_values(secrets: DataFrame) -> DataFrame:
    """Findings whose evidence is a bare secret, with all but its ends starred."""
    return secrets.withColumn("evidence", mask_secret(F.col("evidence")))


def complete(findings: DataFrame) -> DataFrame:
    """All columns of a finding. Evidence leaves the detectors redacted: no sink sees what was found in clear."""
    out = findings.drop("entropy") if "entropy" in findings.columns else findings
    return out.withColumn("evidence", sanitized(F.col("evidence"))).withColumn("redacted_evidence", F.col("evidence")).withColumn("remediation", F.lit(None).cast("string")).withColumn("detection_method", F.lit(None).cast("string"))

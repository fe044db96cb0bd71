"""Text, path and binary functions."""

import io
import math
import struct
import zipfile
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.functions import binary, paths, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_entropy(spark):
    samples = ["", "a", "aab", "AKIA" * 5, "zü漢" * 3, None]
    rows = spark.createDataFrame([(s,) for s in samples], "x string").select("x", text.shannon_entropy(F.col("x")).alias("e")).collect()
    for r in rows:
        want = None if r["x"] is None else -sum(n / len(r["x"]) * math.log2(n / len(r["x"])) for n in Counter(r["x"]).values()) if r["x"] else 0.0
        assert r["e"] == pytest.approx(want) if want is not None else r["e"] is None


def test_masks_agree(spark):
    samples = ["", "short", "12345678", "123456789", "  abcdefghijklmnop \n", "x" * 200]
    rows = spark.createDataFrame([(s,) for s in samples], "x string").select("x", text.mask_secret(F.col("x")).alias("m")).collect()
    assert all(r["m"] == text.mask_text(r["x"]) for r in rows)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_mask_never_shows_more_than_eight(value):
    masked = text.mask_text(value)
    assert masked in ("[REDACTED]", "***REDACTED***") or (len(masked) >= 9 and "****" in masked and len(masked.replace("*", "")) <= 8 + value.count("*"))


def test_sanitize_and_redact(spark):
    token = "gh" + "p_" + "aB3" * 12
    line = f'api_key = "{token}" and postgres://u:longpassword@h/db mail a@b.org ip 10.1.2.3 and 127.0.0.1'
    out = one(spark, text.redact_for_model, line)
    assert token not in out and "longpassword" not in out and "a@b.org" not in out and "10.1.2.3" not in out and "127.0.0.1" in out
    assert one(spark, text.redact_for_model, None) == ""
    block = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert "abc" not in text.sanitize_text(block)
    assert one(spark, text.escape_html, "<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, text.octal_mode, 0o100755, "int") == "755"


@pytest.mark.parametrize(
    "path, ext, language",
    [("a/b.TS", "ts", "typescript"), ("C:\\x\\y.py", "py", "python"), (".env", "", "dotenv"), ("Dockerfile.dev", "dev", "dockerfile"), ("Makefile", "", "makefile"), ("x/README", "", None), ("a.tar.gz", "gz", None), (".env.local", "local", "dotenv")],
)
def test_paths(spark, path, ext, language):
    assert (one(spark, paths.extension, path), one(spark, paths.language, path)) == (ext, language)


@pytest.mark.parametrize(
    "path, ignored",
    [("src/a.ts", False), ("node_modules/x/a.js", True), ("a/node_modules/b", True), ("dist/a.js", True), ("src/dist.js", False), ("a/b.pyc", True), ("sub/dist", True), ("vendors/a.c", False), ("docs/x", True), ("x.log", True), ("keep/x.txt", False)],
)
def test_ignores(spark, path, ignored):
    patterns = ["docs/", "*.log", "# note", "", "/only/**"]
    assert paths.ignores(path, patterns) == ignored
    assert one(spark, lambda c: paths.ignored(c, patterns), path) == ignored


def test_project_types(spark):
    kinds = one(spark, paths.project_type, "a/package.json"), one(spark, paths.project_type, "Dockerfile"), one(spark, paths.project_type, "x.tf"), one(spark, paths.project_type, "x")
    assert kinds == (["nodejs"], ["docker"], ["terraform"], [])


@pytest.mark.parametrize(
    "data, kind, program, is_binary",
    [(b"MZ\x00", "PE", True, True), (b"\x7fELF", "ELF", True, True), (b"\xca\xfe\xba\xbe", "MACHO", True, True), (b"PK\x03\x04", "ZIP", False, True), (b"\x89PNG", "PNG", False, True), (b"text", "UNKNOWN", False, False), (b"\x00" * 10, "UNKNOWN", False, True), (b"", "UNKNOWN", False, False)],
)
def test_sniff(spark, data, kind, program, is_binary):
    row = one(spark, binary.sniff, data, "binary")
    assert (row["type"], row["is_executable"], row["is_binary"]) == (kind, program, is_binary)


def archive(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_zip():
    assert binary.inspect_zip(archive(("a.txt", "x")))[:5] == (True, 1, 1, False, False)
    assert binary.inspect_zip(archive(("../a.exe", "x")))[3] is True
    assert binary.inspect_zip(archive(("a", b"\0" * 30_000_000)))[4] is True
    assert binary.inspect_zip(b"PK" + b"\0" * 50)[:2] == (True, 0)
    assert binary.inspect_zip(None)[0] is False
    broken = archive(("a.txt", "x"))[:-22] + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 1, 5, 0, 10**9, 0)
    assert binary.inspect_zip(broken)[:3] == (True, 5, 0)


def test_strings(spark):
    assert one(spark, binary.printable_strings, b"\x00hello\x01ab\xffworld!!", "binary") == ["hello", "world!!"]


def test_script_positions():
    from siltline.functions.javascript import analyse
    from siltline.plans.detection_queries import _SCRIPTS

    for code, want in _SCRIPTS:
        got = [(f[0], f[1], f[2], f[4], f[5], 2 if f[7] else 0) for f in analyse(code)]
        assert got == ([want] if want else []), code
    long_type = "const v: { " + " ".join(f"a{i}: string;" for i in range(60)) + " } = req.body;\nexec(v);"
    assert [f[2] for f in analyse(long_type)] == [98]
    far = "x" * 600 + ";eval(" + "y" * 600 + ")"
    assert analyse(far)[0][4:7] == (1, 601, far)
    assert [f[0] for f in analyse("/a/.exec(x); eval")] == ["SEC-001"] and analyse("exec(a") and analyse(")]}exec") == []


def test_masking_table():
    from siltline.functions.text import sanitize_text

    block = "-----BEGIN RSA PRIVATE" + " KEY-----\nabc\n-----END RSA PRIVATE" + " KEY-----"
    assert sanitize_text(f"x {block} y") == "x -----BEGIN PRIVATE KEY-----\n[REDACTED PRIVATE KEY DATA]\n-----END PRIVATE KEY----- y"
    assert sanitize_text("password = 'longenough1'") == "password = 'lo*******h1'"
    assert sanitize_text("k = AKIA" + "Q" * 16) == "k = AKIA" + "*" * 12 + "QQQQ"
    assert sanitize_text(None) is None and sanitize_text("") == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["const a", "let {b}", " = ", "req.query", "(", ")", "[", "]", "{", "}", ";", ",", "\n", "exec", "a.b", ".query", "`${x}`", "`", "'", "new ", "Function", "<T>", ": ", "?.", "?", "+", "innerHTML", "=>", "eval(", "spawn('a', [], {shell: true})", "/x/", "/*", "//", "a"]), max_size=25))
def test_scripts_of_any_shape(parts):
    from siltline.functions.javascript import analyse

    code = "".join(parts)
    for found in analyse(code):
        line = code.split("\n")[found[4] - 1]
        assert 0 <= found[5] < len(line) and found[6] is not None

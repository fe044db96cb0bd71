"""Packrat grammars and the files operator."""

import ast
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm.languages import JUDGED, language
from siltline.llm.packrat import END, Grammar
from siltline.llm.parsing import judge, parse_files, parse_rates

sys.setrecursionlimit(60_000)

VALID = {
    "python": ["", "# only\n", "def f(a, *, b=1, **k) -> int:\n    '''doc'''\n    return a if b else [x for x in k if x]\n", "class A(B, metaclass=M):\n    @property\n    def x(self): return self._x\n", "x = (1,\n  2)\nif x:\n\tpass\nelse:\n\tpass\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **k}: pass\n", "async def f():\n    async with a as b, c: await d\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\n", "lambda *a, b=1: (yield)\n", "f'{x!r:>{w}}' rb'q'\nprint(*a, **b, sep='')\n", "x: int = 3; y = z = 1\n", "with (open(a) as b, c): pass\n", "type X[T] = list[T]\n", "a[1:2, ::3] @= b\n"],
    "javascript": ["", "#!/usr/bin/env node\nlet a = 1\nlet b = 2\n", "export default class A extends B { static #x = 1; async *f() { yield* g() } get y() { return this.#x } }", "const f = async ({a, b = 2}, ...c) => { for await (const x of c) await x }", "if (a) b(); else c\nfor (;;) { break }", "x = /[/\\]]+/g.test(y) ? `a${b}` : a?.b?.[c] ?? d", "label: for (const k in o) continue label", "import a, {b as c} from 'm'; export * from 'n'", "switch (x) { case 1: case 2: y(); default: }", "return_ = a\n  .b()\n  .c()", "var o = {a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, ...f}"],
    "typescript": ["interface A<T> extends B { readonly x?: T[]; f(a: string): void; [k: string]: any }", "type U = 'a' | 'b' | { c: number }[]", "export abstract class C<T extends D = E> implements F { private constructor(readonly a: string, public b?: number) { super() } }", "const x = y as unknown as Z; let q = w!; function f(this: A, b?: string): b is string { return true }", "enum E { A = 1, B }", "declare module 'm' { }", "export const f = <T,>(a: T): T => a"],
    "java": ["", "package a.b; import static c.D.*; @A(b = 1) public final class E<T extends F & G> extends H implements I { int[] a = {1, 2}; E() { this(1); } <U> U f(List<? super T> x) throws J { return (U) x.get(0); } }", "enum A { B(1) { void f() {} }, C; private final int x; A(int... x) {} }", "record P(int x, int y) { P { if (x < 0) throw new E(); } }", "interface A { default void f() { Runnable r = () -> {}; var s = String::valueOf; int y = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }", "class A { void f() { for (int i = 0, j = 1; i < j; i++) { } for (var x : y) synchronized (z) { } try (var r = a()) { } catch (B | C e) { } finally { } String t = \"\"\"\n x \"\"\"; } }"],
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x := f(); x {\n\t}\n\tfor i := range c {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch t := y.(type) {\n\tcase int, string:\n\t}\n\tselect {\n\tcase <-ch:\n\tdefault:\n\t}\n\treturn\n}\n", "package a\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tF() error\n\t~int | string\n}\n\nvar x = map[string][]int{\"a\": {1, 2}}\n\nconst (\n\tA = iota\n\tB\n)\n"],
    "c": ["", "#include <a.h>\n#define X(a) \\\n  do { } while (0)\nstatic const char *const a[] = { [0] = \"x\" \"y\", };\nint (*f(int a, ...))(void);\nstruct s { int a : 3; union { int b; }; } x;\nint main(void) { for (int i = 0; i < 3; i++) { if (a) goto e; } e: return sizeof(struct s) * (int)b; }\n", "typedef enum { A, B = 2 } e_t; e_t f(e_t *p) { return p->x ? *p : (e_t){0}; }\n"],
    "php": ["", "plain text", "<?php\nnamespace A\\B;\nuse C\\{D, E as F};\n#[Attr(1)]\nfinal class X extends Y implements Z { use T; const A = 1; public function __construct(private readonly ?int $a = null, string ...$b) {} public static function f(): ?static { return fn(int $x) => $x ** 2; } }\n", "<?php if ($a): ?>x<?php elseif ($b): ?>y<?php else: ?>z<?php endif; ?>", "<?= $x ?? 'a' ?>\n", "<?php\n$a = [1, 'b' => [...$c], &$d]; foreach ($a as $k => [$x, $y]) echo \"v $x {$y['z']}\", PHP_EOL; $s = <<<EOT\n text\n EOT;\nmatch(true) { $a > 1, $b => 2, default => throw new E() };"],
    "shell": ["", "#!/bin/bash\nset -eu\nf() { local a=\"$1\"; echo \"${a:-x}\" | grep -v 'it''s' >&2 || return 1; }\n", "if [ -z \"$x\" ]; then a; elif [[ $y == z* && -f q ]]; then b; else c; fi\n", "case \"$1\" in\n  a|b) x ;;\n  *) y ;;\nesac\n", "for i in 1 2; do (cd $i && ls); done < f\nwhile read -r l; do :; done\n", "cat <<EOF\nit's \"open\nEOF\na=(1 2 $(b \"c)\"))\n(( i++ ))\n", "x=$(a `b` | c) && { d; } &\n"],
    "json": ["1", "[]", '{"a": [1, -2.5e+3, true, null, "\\u00e9"]}', ' \n{"a":{}} '],
    "yaml": ["", "# c\n", "a: 1\nb:\n  - c: d\n    e: f\n  -\n    - g\n", "a: [1, 2,\n  3]\nb: {c: d, e: [f]}\n", "t: |\n  text: x\n    more\nu: >-\n  y\n", "---\na: 'it''s'\n...\n---\n- &x {a: b}\n- *x\n", "plain words\nover lines\n", "\"a b\": c # d\nurl: http://x:80/y#z\n", "a:\n- b\n- c\n", "k: v\n  continued\n"],
    "xml": ["<a/>", '<?xml version="1.0"?><!-- c --><!DOCTYPE a><a b="1" c=\'2\'>t &amp; &#10;<b></b><![CDATA[<x>]]><?p i?></a>\n'],
}
INVALID = {
    "python": ["print 'x'\n", "def f(:\n", "  x = 1\n", "if x:\npass\n", "x = 'open\n", "def f():\n    a\n   b\n", "<<<<<<< HEAD\n", "x = 1 +\n", "a b\n", "0777\n", "x\x00\n", "return)\n", "'''open\n"],
    "javascript": ["let a = ;", "function f( {", "a b", "let s = 'open\n", "/* open", "if (a { }", "}", "const = 1", "package main\n", "<html><body></body></html>", "<<<<<<< HEAD\na()\n", "try { }", "var x = 1 2"],
    "typescript": ["interface A { x: }", "let a: = 1", "class { x( }", "package net.x;"],
    "java": ["class A {", "import a", "class A { int x }", "class A { void f() { return 1 } }", "def f():\n  pass", "}"],
    "go": ["func f() {}", "package a\nfunc f() {\n", "package a\nfunc f( {\n}\n", "package a\nx := 1\n", "package a.b;\n", "package a\nfunc f() { if x { }\n}}\n", ""],
    "c": ["int main() {", "int x = ;", "int f() { return 1 }", "}", "/* open", "import os\n", "char *s = \"open\n;"],
    "php": ["<?php function f( {", "<?php $a = ;", "<?php if ($a) {", "<?php 'open", "<?php }", "<?php $a = 1 2;"],
    "shell": ["if a; then b\n", "f() {\n", "case x in\n", "echo \"open\n", "a ) b\n", "for i in; done\n", "fi\n", "x = $(a\n", "<html>\n", "a (b)\n", "}\n", "do x\n"],
    "json": ["", "{", "{'a': 1}", "[1,]", "NaN", "01", '{"a": 1} x', '"a\nb"', "// c\n1", "[1 2]"],
    "yaml": ["a: [1\nb: 2\n", "a: 'open\n", "a:\n\tb: 1\n", "a: b: c\n", "a:\n    b: 1\n  c: 2\n", "a: 1\n<<<<<<< HEAD\nb: 2\n", "- a\nb: c\n", "a: }\n", "@x: y\n"],
    "xml": ["", "<a>", "<a></b>", "<a b=1/>", "<a/><b/>", "text", "<a>&nbsp;</a>", "<a b='1' b='2'/>", "<a><b></a></b>", "<a>x < y</a>"],
}


@pytest.mark.parametrize("name", JUDGED)
def test_valid(name):
    for text in VALID[name]:
        for body in (text, "﻿" + text, text.replace("\n", "\r\n")):
            assert judge(name, body.encode())[0], (text, judge(name, body.encode()))


@pytest.mark.parametrize("name", JUDGED)
def test_invalid(name):
    for text in INVALID[name]:
        ok, offset, line, column, cause = judge(name, text.encode())
        assert not ok, text
        assert 0 <= offset <= len(text) and line == text.count("\n", 0, offset) + 1 and column >= 1 and cause


def test_python_agrees_with_its_own_parser():
    import inspect
    import json
    import textwrap

    for module in (json.decoder, textwrap, ast, inspect):
        source = inspect.getsource(module)
        assert judge("python", source.encode())[0], module
        for cut in range(200, len(source), max(1, len(source) // 25)):
            part = source[:cut]
            try:
                ast.parse(part)
                valid = True
            except SyntaxError:
                valid = False
            assert judge("python", part.encode())[0] == valid, part[-80:]


@settings(max_examples=150, deadline=None)
@given(st.text("ab1+*() ", max_size=12))
def test_fused_and_plain_parsers_agree(text):
    g = Grammar("s <- sum END\nsum <- NAME ('+' NAME)* &END / product ('+' product)*\nproduct <- atom ('*' atom)*\natom <- NAME / NUM / '(' sum ')'", ("NAME", "NUM"))
    kinds = "".join(g.kinds.of_class["NAME"] if c in "ab" else g.kinds.of_class["NUM"] if c == "1" else g.kinds.of_text.get(c, "?") for c in text if c != " ") + END
    assert g.parse_fast(kinds)[0] == g.parse_exact(kinds)[0]
    try:
        ast.parse(text.replace(" ", ""), mode="eval")
        valid = "**" not in text.replace(" ", "") and "()" not in text.replace(" ", "")
    except SyntaxError:
        valid = False
    spaced = text.replace(" ", "")
    tokens_are_single = not any(x.isalnum() and y.isalnum() for x, y in zip(spaced, spaced[1:])) and not any(x in "ab1)" and y == "(" for x, y in zip(spaced, spaced[1:])) and not spaced.startswith("+") and "(+" not in spaced and "++" not in spaced and "*+" not in spaced
    if tokens_are_single:
        assert g.accepts(kinds) == valid


def test_furthest_failure_and_cause():
    assert judge("json", b'{"a": 1,\n "b" 2}')[1:4] == (14, 2, 6)
    assert judge("python", b"x = 1\n<<<<<<< ours\ny\n=======\nz\n>>>>>>> theirs\n")[4] == "conflict"
    assert judge("json", b"{")[4] == "truncated" and judge("json", b"  ")[4] == "empty" and judge("json", b"[1,\x00\n\n\n\n]")[4] == "null bytes"


def test_deep_and_long():
    assert judge("json", b"[" * 5000 + b"]" * 5000)[0]
    assert not judge("json", b"[" * 5000)[0]
    assert judge("python", b"x = 1\n" * 20_000)[0] and judge("javascript", ("f(" * 300 + ")" * 300).encode())[0]


SCHEMA = "file_id long, repo string, path string, language string, is_binary boolean, content binary, discovered_at timestamp"


def test_files(spark):
    from datetime import datetime

    t1, t2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [
        (1, "r", "a.json", "json", False, b"{", t1), (1, "r", "a.json", "json", False, b"{}", t2), (2, "r", "b.json", None, None, b"[", t1), (3, "r", "c.md", "markdown", False, b"[", t1), (4, None, "d.py", "Python3", False, None, None),
        (5, "r", "e.json", "json", True, b"[", t1), (6, "r", "x/Y.JSON", None, False, b"", t1), (7, "r", None, None, False, b"[", t1), (None, "r", "f.json", "json", False, b"1", t1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("valid", "_language", "at", "cause")})
    got = {r["file_id"]: r["valid"] for r in parse_files(df).collect()}
    assert got == {1: True, 2: False, 4: True, 6: False, None: True}
    assert parse_files(spark.createDataFrame([], SCHEMA)).count() == 0
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"]) for r in parse_rates(parse_files(df)).collect()}
    assert rates[("r", "json")] == (4, 2)
    language("json")


ORDERS_AND_TARGETS = [
    'f(a=1, b)', 'f(a, b=1)', 'f(*a, b)', 'f(**k, *a)', 'f(**k, a=1)', 'f(a=1, *b)', 'f(**k, b)', 'f(x for x in y)', 'f(x for x in y, 1)', 'f(1, x for x in y)', 'f(,)', 'f(a,)', 'f(a=1,)',
    'f(**k,)', 'f(a := 1)', 'f(a=b := 1)', 'def f(a=1, b): pass', 'def f(a, b=1): pass', 'def f(a=1, *, b): pass', 'def f(*): pass', 'def f(*, a): pass', 'def f(*, **k): pass',
    'def f(a, /, b): pass', 'def f(a, /, b, /): pass', 'def f(/, a): pass', 'def f(a=1, /, b=2): pass', 'def f(a=1, /, b): pass', 'def f(*a, **k): pass', 'def f(**k, a): pass',
    'def f(*a, *b): pass', 'def f(a, *, b, c=1, **k,): pass', 'def f(a, b: int = 3, *args: int) -> int: pass', 'def f(a,): pass', 'def f(,): pass', 'def f(*args: *Ts): pass', 'lambda: 1',
    'lambda a=1, b: 1', 'lambda *, a: 1', 'lambda *: 1', 'lambda a, /, b=2, *c, d, **e: 1', 'lambda a,: 1', '1 = x', 'f() = x', 'a.b = x', 'a[1] = x', 'f().a = x', 'f()[1] = x',
    '(a, b) = x', '[a, *b] = x', 'a = b = c', 'a = f() = c', 'a = b = yield', 'x = yield y', '*a, b = c', 'a, b = c, d', '(a) = 1', '(a): int = 1', 'a.b: int', 'f(): int', 'a, b: int = 1',
    'a += 1', 'f() += 1', 'a, b += 1', 'a.b[1] += 1', '(a) += 1', 'x: int = yield', 'None = 1', 'a + b = c', '-a = 1', 'a if b else c = 1', '"s" = 1', '"s".x = 1', '[] = x', '() = x',
    'a = *b, c', 'a == b', 'a = b == c', 'await_ = 1', 'print = 3', 'match = 1', 'match.a = 1', 'type = 1', 'type X = int', 'case = 2', 'a = (yield)', 'for x in y: pass',
    'for f() in y: pass', 'for x, y in z: pass', 'for x.a in y: pass', 'for x[0] in y: pass', 'for (x, y) in z: pass', 'for *x, y in z: pass', 'for 1 in y: pass', 'for x in *a, b: pass',
    'del a', 'del a, b', 'del f()', 'del a[0], b.c', 'del (a, b)', 'del', 'with a as b: pass', 'with a as f(): pass', 'with a as (b, c): pass', 'with a as b.c, d as e[0]: pass',
    'with (a as b, c as d): pass', '[x for x in y]', '[x for f() in y]', '{a: b for a, b in c}', 'x = [i for i, in y]', 'a = lambda: (yield)', '@f(a=1)\ndef g(): pass', 'a.b.c(d)[e].f = g',
    '(a.b) = 1', 'a = b; c = d', 'a = b,', 'f(a)(b) = 1', 'not a = 1', 'a = not b', 'x = a, = b', 'print(a, *b, c=1, **d)', 'f(a)(b)(c=1)(**d)', 'x[a, *b] = 1', 'x[a:b, c] = 1',
    'a = b = c = d', 'async def f():\n  await x = 1', 'async def f():\n  x = await y\n  async for a.b in c: pass\n  async with d as e: pass', 'global x', 'x = yield = 1',
    'class A(b, c=1): x: int = 3', 'class A(b=1, c): pass', 'assert a, b', 'raise a from b', 'return', 'x: int, y: int', 'a: b = c = d', 'a: b += 1', 'a = b: int', 'f(a for a in b)(c)',
    'f(*a for a in b)', 'f(a=1 for a in b)',
]
FORMATTED = [
    'f"{a}"', 'f"{a!r}"', 'f"{a!x}"', 'f"{a:>{w}}"', 'f"{a:{w}.{p}f}"', 'f"{a=}"', 'f"{a = !r:>5}"', 'f"{}"', 'f"{ }"', 'f"{a"', 'f"a}"', 'f"{{}}"', 'f"{{a}"', 'f"{a b}"', 'f"{a[\'k\']}"',
    'f"{(lambda x: 1)}"', 'f"{x != y}"', 'f"{x == y:b}"', 'f"{a if b else c}"', 'f"{d[\'a:b\']:x}"', 'rf"\\d{a}"', 'f"\\N{DIGIT ONE}{a}"', 'f"{*a,}"', 'f"{a:%H:%M}"', 'f"{a!r:^{b}}"',
    'f"{lambda x: 1}"', 'f"{a:{b}}}"', 'f"{a+}"', 'f"{x:=5}"', 'f"{\',\'.join(x)}"', 'f"{x!r}}}"', 'f"{{{x}}}"',
]
# Quotes inside fields that enclose the literal are new in 3.12; the running parser may be older.
NESTED_QUOTES = ['f"{a["k"]}"', "f'{f\"{x}\"}'", 'f"{a["b"]["c"]}" + f"{d}"', "f'{f' {d}' if d else ''}x'"]


@pytest.mark.parametrize("text", [*ORDERS_AND_TARGETS, *FORMATTED])
def test_python_orders_targets_and_fields(text):
    try:
        ast.parse(text + "\n")
        valid = True
    except SyntaxError:
        valid = False
    assert judge("python", (text + "\n").encode())[0] == valid


def test_python_nested_quotes():
    for text in NESTED_QUOTES:
        assert judge("python", (text + "\n").encode())[0], text


@pytest.mark.parametrize("name", ["javascript", "typescript"])
def test_template_substitutions(name):
    for text in ("`a`", "`${a}`", "`a${b + 1}c${d.e(f, `${g}`)}`", "`${ {a: 1}.a }`", "`\\${ if }`", "`${a ? `x${b}` : 'y}'}`", "`${f(/[a}]/)}`", "`${() => { return 1 }}`", "tag`${a}`", "`$ {a b} $`", "`${a /* } */}`"):
        assert judge(name, f"x = {text};".encode())[0], text
    for text in ("`${}`", "`${a b}`", "`${if}`", "`${a +}`", "`${f(}`", "`a${b"):
        assert not judge(name, f"x = {text};".encode())[0], text
    assert judge("typescript", b"type A = `a${string}b${infer_}`; type B<T> = T extends `${infer H}-${Uppercase<T>}` ? H : never;")[0]


def test_depth_beyond_the_parser_is_undecided():
    before = sys.getrecursionlimit()
    deep = lambda n: ("x = " + "(" * n + "1" + ")" * n + "\n").encode()
    try:
        sys.setrecursionlimit(1_000_000)
        assert judge("javascript", deep(15_000)) == judge("python", deep(8_000)) == (True, None, None, None, None)
        assert judge("javascript", deep(15_000).replace(b")", b"", 1))[0] is False
        sys.setrecursionlimit(2_000)
        assert judge("javascript", deep(5_000)) == (None, None, None, None, "undecided")
    finally:
        sys.setrecursionlimit(before)


def test_rates_with_totals(spark):
    rows = [(1, "a", "python", True, None), (2, "a", "python", False, "conflict"), (3, "a", "json", None, "undecided"), (4, None, "json", False, "syntax")]
    rates = {(r["level"], r["repo"], r["language"]): r for r in parse_rates(spark.createDataFrame(rows, "file_id long, repo string, language string, valid boolean, cause string")).collect()}
    assert len(rates) == 3 + 2 + 2 + 1
    total = rates["all", None, None]
    assert (total["files"], total["invalid"], total["undecided"], total["conflicts"], round(total["rate"], 4)) == (4, 2, 1, 1, 0.6667)
    assert rates["repo", None, None]["files"] == 1 and rates["language", None, "json"]["files"] == 2 and rates["repo and language", "a", "json"]["rate"] is None


def test_shell_substitutions():
    for text in ("x=$(a b)", "x=$()", "x=$(if a; then b; fi)", 'x="$(a "$(b c)")"', "echo '$(a | )'", "x=$(( 1 + (2) ))", "x=$(<f)", "x=$(a)$(b)", "x=$( (a; b) | c )", "x=$(a\nb)", "x=$({ a; })", "x=${y:-$(a)}", "x=$(case a in a) b;; esac)", 'echo "it\'s $(a | b)"'):
        assert judge("shell", (text + "\n").encode())[0], text
    for text in ("x=$(a | )", "x=$(a", "x=$(if a; then b)", 'x="$(fi)"', "x=$(a && )", "x=${y:-$(a | )}", "x=$(for i in 1; do a)", "x=$(a;; b)", "x=$(&)", 'x="$(a "$(b | )")"'):
        assert not judge("shell", (text + "\n").encode())[0], text

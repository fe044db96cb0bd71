"""Unsafe calls in JavaScript and TypeScript, found in the token stream.

There is no parser here: tokens know strings, templates, comments and regular expressions, calls are matched with their
arguments by bracket depth, and a finding stands where its expression begins: a call at the head of its chain, an
assignment at its left side, ``new`` at that word. Tainted names are kept by name, in source order, without scopes.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions.text import sanitize_text
from siltline.operators.detect import SCANNERS
from siltline.plans import rules as R

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|$))|(?P<text>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<template>`(?:[^`\\]|\\[\s\S])*(?:`|$))"
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|===|!==|==|!=|<=|>=|\*\*=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|\.\.\.|[^\s\w])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_SOURCE = re.compile(r"(?i)req\.(?:query|body|params|headers|cookies)|location\.(?:search|hash)|window\.location")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => && || ?? return typeof case == === != !== += -= *= /= %= **= &= |= ^= &&= ||= ??= **".split())


class Token:
    __slots__ = ("kind", "text", "at", "end")

    def __init__(self, kind: str, text: str, at: int, end: int):
        self.kind, self.text, self.at, self.end = kind, text, at, end


def tokens(code: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(code):
        if code[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX):
            m = _REGEX.match(code, at)
            if m:
                out.append(Token("regex", m[0], at, m.end()))
                at = m.end()
                continue
        m = _TOKEN.match(code, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], m.start(), at))
    return out


_OPENING, _CLOSING = frozenset("([{"), frozenset(")]}")
_WORDS_BEFORE_VALUES = frozenset("return typeof case in of instanceof new delete void throw else do await yield".split())
_ASSIGNMENTS = frozenset("= += -= *= /= %= **= &= |= ^= &&= ||= ??= <<= >>= >>>=".split())
_NOT_BINARY = frozenset("? => && || ??".split()) | _ASSIGNMENTS
#: Binary operators by how loosely they bind, the loosest first.
_BINARY = ("|", "^", "&", "== != === !==", "< > <= >= in instanceof", "<< >> >>>", "+ -", "* / %", "**")
_LOOSENESS = {sign: i for i, level in enumerate(_BINARY) for sign in level.split()}
_BEFORE_MEMBERS = frozenset("{ } ; async public private protected static override abstract get set *".split())


def _ends_value(t: Token) -> bool:
    """Whether an operand may end with this token, so that an operator or a new statement may follow."""
    return t.kind in ("text", "template", "number", "regex") or t.text in _CLOSING or t.kind == "name" and t.text not in _WORDS_BEFORE_VALUES


def _closing(toks: list[Token], opening: int) -> int:
    """The place of the bracket that closes the one at ``opening``, or the end."""
    depth = 0
    for i in range(opening, len(toks)):
        if toks[i].kind == "sign":
            depth += (toks[i].text in _OPENING) - (toks[i].text in _CLOSING)
            if depth <= 0:
                return i
    return len(toks)


def _past(toks: list[Token], i: int) -> int:
    """Behind the token at ``i`` and, if it opens a bracket, what that holds."""
    return min(len(toks), _closing(toks, i) + 1) if toks[i].kind == "sign" and toks[i].text in _OPENING else i + 1


def _opening(toks: list[Token], closing: int) -> int:
    depth = 0
    for i in range(closing, -1, -1):
        if toks[i].kind == "sign":
            depth += (toks[i].text in _CLOSING) - (toks[i].text in _OPENING)
            if depth <= 0:
                return i
    return 0


def _arguments(toks: list[Token], opening: int) -> tuple[list[tuple[int, int]], int]:
    """Token ranges of the arguments of the call whose bracket stands at ``opening``, and the place of its end."""
    end = _closing(toks, opening)
    parts, start, i = [], opening + 1, opening + 1
    while i < end:
        if toks[i].kind == "sign" and toks[i].text in _OPENING:
            i = _closing(toks, i)
        elif toks[i].text == "," and toks[i].kind == "sign":
            parts.append((start, i))
            start = i + 1
        i += 1
    if end > start:
        parts.append((start, end))
    return parts, end


def _call_bracket(toks: list[Token], i: int) -> int | None:
    """The opening bracket of a call of the name at ``i``, behind type arguments if there are any."""
    j = i + 1
    if j < len(toks) and toks[j].text == "<" and toks[j].kind == "sign":
        depth = 0
        while j < len(toks) and (toks[j].kind in ("name", "text", "number") or toks[j].text in "<>,.[]|&{}:;?()=>"):
            depth += (toks[j].text == "<") - (toks[j].text == ">")
            j += 1
            if depth == 0:
                break
        if depth:
            return None
    return j if j < len(toks) and toks[j].text == "(" and toks[j].kind == "sign" else None


def _chain(toks: list[Token], i: int) -> tuple[int, bool, bool]:
    """(head, optional, constructed) of the member chain that ends with the name at ``i``.

    optional: the chain holds ``?.``; constructed: ``new`` stands before it and takes the bracket behind it.
    """
    optional, called = False, False
    while i >= 2 and toks[i - 1].text in (".", "?."):
        optional |= toks[i - 1].text == "?."
        i -= 2
        while toks[i].text in (")", "]") and toks[i].kind == "sign":
            called |= toks[i].text == ")"
            i = _opening(toks, i)
            before = toks[i - 1] if i else None
            if before is None or not _ends_value(before):
                break
            i -= 1
    if i and toks[i - 1].text == "new" and toks[i - 1].kind == "name":
        return (i - 1, optional, False) if called else (i, optional, True)
    return i, optional, False


def _operator(toks: list[Token], a: int, b: int) -> str | None:
    """The operator of the tokens as a binary expression, None if they are something else."""
    found = None
    i = a
    while i < b:
        t = toks[i]
        if t.kind == "sign" and t.text in _OPENING:
            i = _closing(toks, i) + 1
            continue
        if t.text in _NOT_BINARY and t.kind == "sign" or t.text in ("as", "satisfies") and t.kind == "name" and i > a:
            return None
        if t.text in _LOOSENESS and i > a and _ends_value(toks[i - 1]) and (found is None or _LOOSENESS[t.text] <= _LOOSENESS[found]):
            found = t.text
        i += 1
    return found


def _is_definition(toks: list[Token], i: int, end: int, parts: list[tuple[int, int]]) -> bool:
    """Whether the name at ``i`` with its brackets is a method or signature rather than a call."""
    after = toks[end + 1].text if end + 1 < len(toks) else ""
    if after == "{":
        return True
    typed = any(b - a >= 3 and toks[a].kind == "name" and toks[a + 1].text in (":", "?") and toks[a + 1].kind == "sign" and _operator(toks, a, b) is None and "?" not in [x.text for x in toks[a + 2 : b]] for a, b in parts)
    return typed or after == ":" and i > 0 and toks[i - 1].text in _BEFORE_MEMBERS


def _declared(toks: list[Token], i: int, code: str) -> Iterator[tuple[int, int, int]]:
    """(name, begin, end) of the plain names that a declaration at ``i`` sets, with the token range of their values."""
    at = i + 1
    while at < len(toks):
        name = at if toks[at].kind == "name" else None
        at = at + 1 if name is not None else _past(toks, at) if toks[at].text in _OPENING else len(toks)
        if at < len(toks) and toks[at].text == "!":
            at += 1
        if at < len(toks) and toks[at].text == ":":  # a type goes on to the value
            at += 1
            while at < len(toks) and toks[at].text not in ("=", ";", ",", ")") and not (_new_statement(toks, at, code)):
                at = _past(toks, at)
        if at < len(toks) and toks[at].text == "=":
            begin = at + 1
            at = begin
            while at < len(toks) and toks[at].text not in (";", ",") and toks[at].text not in _CLOSING and not (at > begin and _new_statement(toks, at, code)):
                at = _past(toks, at)
            if name is not None and at > begin:
                yield name, begin, at
        if at >= len(toks) or toks[at].text != ",":
            return
        at += 1


def _new_statement(toks: list[Token], i: int, code: str) -> bool:
    """Whether a statement begins here without a semicolon before it."""
    t, before = toks[i], toks[i - 1]
    return t.kind in ("name", "text", "number") and t.text not in ("in", "instanceof", "as", "satisfies") and _ends_value(before) and "\n" in code[before.end : t.at]


def analyse(code: str) -> list[tuple]:
    """(rule_id, severity, confidence, title, line, col, evidence, taint) of each unsafe call; line from 1, column from 0.

    ``taint`` is the line and name of the source, where the first argument is a tainted name. Calls by way of ``?.``
    are left out, as are methods and signatures that only bear such a name.
    """
    toks = tokens(code)
    tainted: dict[str, int] = {}
    found: list[tuple] = []
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    text_of = lambda a, b: code[toks[a].at : toks[b - 1].end] if b > a else ""
    line_of = lambda at: bisect.bisect_right(starts, at)

    def put(rule_id: str, confidence: int, title: str, i: int, taint: tuple | None = None, severity: str | None = None) -> None:
        line = line_of(toks[i].at)
        begin = starts[line - 1]
        text = code[begin : starts[line] - 1 if line < len(starts) else len(code)].strip()
        found.append((rule_id, severity or R.by_id(rule_id).severity, confidence, title, line, toks[i].at - begin, sanitize_text(text), taint))

    for i, t in enumerate(toks):
        if t.kind != "name":
            continue
        before, after = toks[i - 1].text if i else "", toks[i + 1].text if i + 1 < len(toks) else ""
        member = before in (".", "?.")
        if t.text in ("const", "let", "var") and not member:
            for name, a, b in _declared(toks, i, code):
                if _SOURCE.search(text_of(a, b)) or b == a + 1 and toks[a].kind == "name" and toks[a].text in tainted:
                    tainted[toks[name].text] = line_of(toks[name].at)
        if t.text == "innerHTML" and member and after in _ASSIGNMENTS:
            put("SEC-004", 85, "markup set from text", _chain(toks, i)[0])
        elif t.text == "dangerouslySetInnerHTML" and not member and after == "=":
            put("SEC-004", 90, "markup set from text in a component", i)
        elif t.text == "Function" and before == "new":
            put("SEC-002", 95, "code made from text", i - 1)
        if t.text not in _CALLED or before == "function":
            continue
        opening = _call_bracket(toks, i)
        if opening is None:
            continue
        head, optional, constructed = _chain(toks, i)
        parts, end = _arguments(toks, opening)
        if optional or constructed or not member and _is_definition(toks, i, end, parts):
            continue
        owner = toks[i - 2] if member else None
        # a named object is a plain name; anything else (a call, a member, this) has none
        named = owner.text if owner is not None and owner.kind == "name" and owner.text not in ("this", "super") and head == i - 2 else None
        a, b = parts[0] if parts else (0, 0)
        filled = b == a + 1 and toks[a].kind == "template" and "${" in toks[a].text
        if t.text == "eval" and not member:
            put("SEC-002", 95, "text evaluated as code", head)
        elif t.text in ("exec", "execSync") and parts and (not member or named in (None, "child_process", "cp")):
            name = toks[a].text if b == a + 1 and toks[a].kind == "name" and toks[a].text not in ("this", "null", "true", "false") else None
            taint = (tainted[name], name) if name in tainted else None
            confidence = 98 if taint else 90 if name or filled or _operator(toks, a, b) else 70
            put("SEC-001", confidence, "shell command from input" if taint else "shell command put together" if confidence == 90 else "shell command", head, taint)
        elif t.text in ("spawn", "spawnSync") and member and len(parts) >= 3:
            if re.search(r"shell\s*:\s*true", text_of(*parts[2])):
                put("SEC-001", 85, "process started through a shell", head, severity="HIGH")
        elif (t.text in ("query", "raw") if member else t.text in ("query", "dbQuery")) and parts:
            if filled or _operator(toks, a, b) == "+":
                put("SEC-003", 90, "query text put together", head)
        elif t.text == "createCipher" and named == "crypto":
            put("SEC-008", 95, "weak cipher", head)
    return found


_CALLED = frozenset("eval exec execSync spawn spawnSync query raw dbQuery createCipher".split())


def script_findings(files: DataFrame, keys: tuple[str, ...] = ("rel_path",), text: str = "text") -> DataFrame:
    """Findings of all JavaScript and TypeScript files, with a two-step taint path where input reaches a shell."""
    rows = files.where(F.col("language").isin("javascript", "typescript") & F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = f"{kinds}, rule_id string, severity string, confidence int, title string, line int, col int, evidence string, source_line int, source_name string, n int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, owner = [], []
            for i, code in enumerate(batch["_text"]):
                for n, f in enumerate(analyse(code)):
                    made.append((*f[:7], f[7][0] if f[7] else None, f[7][1] if f[7] else None, n))
                    owner.append(i)
            frame = pd.DataFrame(made, columns=["rule_id", "severity", "confidence", "title", "line", "col", "evidence", "source_line", "source_name", "n"]).astype({"source_line": "Int64"})
            for k, key in enumerate(keys):
                frame.insert(k, key, batch.iloc[:, k].take(owner).array)
            yield frame

    found = rows.mapInPandas(run, out)
    category, cwe = F.lit(R.by_id("SEC-001").category), F.create_map(*[F.lit(x) for r in ("SEC-001", "SEC-002", "SEC-003", "SEC-004", "SEC-008") for x in (r, R.by_id(r).cwe[0])])
    path = F.col(keys[-1]).cast("string")
    step = lambda line, what, code: F.struct(path.alias("file"), line.cast("int").alias("line"), F.lit(what).alias("description"), code.alias("code_snippet"))
    taint = F.when(F.col("source_name").isNotNull(), F.array(step(F.col("source_line"), "input is read", F.col("source_name")), step(F.col("line"), "input reaches a shell", F.col("evidence"))))
    seq = F.lit(SCANNERS.index("sast")).cast("bigint") * 1_000_000_000 + F.col("line").cast("bigint") * 100 + F.least(F.col("n"), F.lit(99))
    return found.select(
        *keys, "rule_id", F.lit("sast").alias("scanner"), category.alias("category"), "severity", "confidence", F.lit(None).cast("string").alias("classification"), "title", "line", "col", "evidence",
        F.lit(None).cast("array<string>").alias("evidence_chain"), F.lit(None).cast("array<string>").alias("behavior_categories"), F.array(cwe[F.col("rule_id")]).alias("cwe"), taint.alias("taint_path"),
        F.lit(None).cast("map<string,string>").alias("metadata"), seq.alias("seq"),
    )

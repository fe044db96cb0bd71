"""Packrat parsers compiled from parsing-expression grammars over token kinds.

A lexer turns a text into a string with one character per token (its kind). A grammar is text, one rule a line:

    stmt <- 'if' '(' expr ')' stmt ('else' stmt)? / expr ';'

``'x'`` is the token x, an upper-case name a token class or set of tokens, a lower-case name a rule; ``/ * + ? ! &``
have their usual meaning. Rules become Python functions with a memo per position. Subexpressions without rules are
fused into one regular expression with atomic groups and possessive repeats, which matches exactly what the parsing
expression matches. A second parser without fusing finds the furthest failure of texts that don't parse.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

END = "\0"
_TOKEN = re.compile(r"'((?:[^'\\]|\\.)+)'|([A-Z][A-Z_0-9]*)|([a-z][a-z_0-9]*)|([()/*+?!&])|\s+")


class Kinds:
    """Characters for token texts and classes."""

    def __init__(self, classes: Iterable[str]):
        self.of_class = {name: chr(0xE000 + i) for i, name in enumerate(classes)}
        self.of_text: dict[str, str] = {}

    def text(self, token: str) -> str:
        return self.of_text.setdefault(token, chr(0xE100 + len(self.of_text)))


def _parse_rule(source: str) -> tuple:
    tokens = [(m.lastindex, m[0] if m.lastindex != 1 else re.sub(r"\\(.)", r"\1", m[1])) for m in _TOKEN.finditer(source) if m.lastindex]
    at = 0

    def peek() -> tuple:
        return tokens[at] if at < len(tokens) else (0, "")

    def choice() -> tuple:
        nonlocal at
        options = [sequence()]
        while peek() == (4, "/"):
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence() -> tuple:
        items = []
        while peek()[0] and peek() not in ((4, "/"), (4, ")")):
            items.append(prefixed())
        return items[0] if len(items) == 1 else ("seq", *items)

    def prefixed() -> tuple:
        nonlocal at
        if peek() in ((4, "!"), (4, "&")):
            op = peek()[1]
            at += 1
            return ("not" if op == "!" else "and", prefixed())
        item = atom()
        while peek() in ((4, "*"), (4, "+"), (4, "?")):
            item = ({"*": "star", "+": "plus", "?": "opt"}[peek()[1]], item)
            at += 1
        return item

    def atom() -> tuple:
        nonlocal at
        kind, value = peek()
        at += 1
        if (kind, value) == (4, "("):
            inner = choice()
            if peek() != (4, ")"):
                raise ValueError(f"missing ) in {source}")
            at += 1
            return inner
        if kind in (1, 2, 3):
            return ({1: "lit", 2: "set", 3: "rule"}[kind], value)
        raise ValueError(f"unexpected {value!r} in {source}")

    tree = choice()
    if at != len(tokens):
        raise ValueError(f"rest {tokens[at:]} in {source}")
    return tree


class Grammar:
    """rules: the grammar's text; the first rule is the start and must consume all input up to END."""

    def __init__(self, rules: str, classes: Iterable[str], sets: dict[str, str] | None = None):
        self.kinds = Kinds(classes)
        self.rules: dict[str, tuple] = {}
        lines = re.sub(r"\n[ \t]+", " ", rules.strip())
        for line in lines.splitlines():
            if line.strip() and not line.startswith("#"):
                name, _, body = line.partition("<-")
                self.rules[name.strip()] = _parse_rule(body)
        sets = dict(sets or {})
        for tree in self.rules.values():
            self._literals(tree)
        for members in sets.values():
            for token in members.split():
                if token not in self.kinds.of_class and token not in sets:
                    self.kinds.text(token)
        words = "".join(k for t, k in self.kinds.of_text.items() if t[0].isalpha() or t[0] in "_@")
        self.sets = {"END": END, "ANY": None, "WORD": self.kinds.of_class.get("NAME", "") + words} | dict(self.kinds.of_class)
        for name, members in sets.items():
            self.sets[name] = "".join(self.sets[t] if self.sets.get(t) and t not in self.kinds.of_text else self.kinds.text(t) for t in members.split())
        self.start = next(iter(self.rules))
        self._first: dict[str, tuple[frozenset, bool]] = {}
        self.parse_fast = self._compile(fuse=True)
        self.parse_exact = self._compile(fuse=False)

    def _literals(self, tree: tuple) -> None:
        if tree[0] == "lit":
            self.kinds.text(tree[1])
        elif tree[0] not in ("set", "rule"):
            for x in tree[1:]:
                self._literals(x)

    def _chars(self, tree: tuple) -> str | None:
        """The characters that a single-token expression takes; None for any."""
        return self.kinds.text(tree[1]) if tree[0] == "lit" else self.sets[tree[1]]

    def _terminal(self, tree: tuple) -> bool:
        return tree[0] in ("lit", "set") or tree[0] != "rule" and all(self._terminal(x) for x in tree[1:])

    def _regex(self, tree: tuple) -> str:
        op = tree[0]
        if op in ("lit", "set"):
            chars = self._chars(tree)
            return f"[^{END}]" if chars is None else re.escape(chars) if len(chars) == 1 else f"[{''.join(map(re.escape, chars))}]"
        inner = [self._regex(x) for x in tree[1:]]
        if op == "seq":
            return f"(?:{''.join(inner)})"
        if op == "alt":
            return f"(?>{'|'.join(inner)})"
        return {"star": "(?:%s)*+", "plus": "(?:%s)++", "opt": "(?:%s)?+", "not": "(?!%s)", "and": "(?=%s)"}[op] % inner[0]

    def _firsts(self, tree: tuple, open_rules: frozenset = frozenset()) -> tuple[frozenset, bool] | None:
        """Characters that may come first, and whether the expression may match nothing; None if unknown."""
        op = tree[0]
        if op in ("lit", "set"):
            chars = self._chars(tree)
            return None if chars is None else (frozenset(chars), False)
        if op == "rule":
            if tree[1] in self._first:
                return self._first[tree[1]]
            if tree[1] in open_rules:
                return None
            found = self._firsts(self.rules[tree[1]], open_rules | {tree[1]})
            if found is not None:
                self._first[tree[1]] = found
            return found
        if op in ("not", "and"):
            return frozenset(), True
        parts = []
        for x in tree[1:]:
            parts.append(self._firsts(x, open_rules))
            if parts[-1] is None:
                return None
            if op == "seq" and not parts[-1][1]:
                break
        chars = frozenset().union(*(p[0] for p in parts))
        nothing = op in ("star", "opt") or (all if op == "seq" else any)(p[1] for p in parts)
        return chars, nothing

    def _compile(self, fuse: bool) -> Callable[[str], tuple[int, int]]:
        space: dict[str, object] = {}
        count = iter(range(10**9))
        lines: list[str] = []

        def put(level: int, text: str) -> None:
            lines.append("    " * level + text)

        def failed(level: int, src: str) -> None:
            put(level, f"if {src} > far: far = {src}")

        def emit(tree: tuple, src: str, dst: str, level: int) -> None:
            op = tree[0]
            if op in ("lit", "set"):
                chars = self._chars(tree)
                test = f"s[{src}] != {END!r}" if chars is None else f"s[{src}] == {chars!r}" if len(chars) == 1 else f"s[{src}] in {chars!r}"
                put(level, f"if {test}: {dst} = {src} + 1")
                put(level, "else:")
                put(level + 1, f"{dst} = -1")
                failed(level + 1, src)
            elif op == "rule":
                put(level, f"{dst} = r_{tree[1]}({src})")
            elif fuse and self._terminal(tree):
                name = f"x{next(count)}"
                space[name] = re.compile(self._regex(tree)).match
                put(level, f"m = {name}(s, {src})")
                put(level, f"if m: {dst} = m.end()")
                put(level, "else:")
                put(level + 1, f"{dst} = -1")
                failed(level + 1, src)
            elif op == "seq":
                items, here = list(tree[1:]), src
                if fuse:  # neighbouring terminals become one
                    merged: list[tuple] = []
                    for x in items:
                        if merged and self._terminal(x) and self._terminal(merged[-1]):
                            merged[-1] = ("seq", *(merged[-1][1:] if merged[-1][0] == "seq" else [merged[-1]]), x)
                        else:
                            merged.append(x)
                    items = merged
                for i, x in enumerate(items):
                    there = dst if i == len(items) - 1 else f"v{next(count)}"
                    emit(x, here, there, level)
                    if i < len(items) - 1:
                        put(level, f"if {there} < 0: {dst} = -1")
                        put(level, "else:")
                        level += 1
                    here = there
            elif op == "alt":
                put(level, f"{dst} = -1")
                for i, x in enumerate(tree[1:]):
                    first = self._firsts(x)
                    guard = [f"{dst} < 0"] * bool(i)
                    if first is not None and not first[1] and len(first[0]) < 400:
                        guard.append(f"s[{src}] in {''.join(sorted(first[0]))!r}")
                    put(level, f"if {' and '.join(guard) or 'True'}:")
                    emit(x, src, dst, level + 1)
                put(level, f"if {dst} < 0 and {src} > far: far = {src}")
            elif op in ("star", "plus"):
                here, step = f"v{next(count)}", f"v{next(count)}"
                first = self._firsts(tree[1])
                test = f"s[{here}] in {''.join(sorted(first[0]))!r}" if first is not None and not first[1] else "True"
                put(level, f"{here} = {src}")
                put(level, f"while {test}:")
                emit(tree[1], here, step, level + 1)
                put(level + 1, f"if {step} <= {here}: break")
                put(level + 1, f"{here} = {step}")
                if op == "star":
                    put(level, f"{dst} = {here}")
                else:
                    put(level, f"{dst} = {here} if {here} > {src} else -1")
                failed(level, here)
            elif op == "opt":
                got = f"v{next(count)}"
                emit(tree[1], src, got, level)
                put(level, f"{dst} = {got} if {got} >= 0 else {src}")
            else:
                got = f"v{next(count)}"
                emit(tree[1], src, got, level)
                put(level, f"{dst} = {src} if {got} {'<' if op == 'not' else '>='} 0 else -1")

        put(0, "def parse(s):")
        put(1, "far = 0")
        for name, tree in self.rules.items():
            put(1, f"memo_{name} = {{}}")
            put(1, f"def r_{name}(p):")
            put(2, "nonlocal far")
            put(2, f"q = memo_{name}.get(p)")
            put(2, "if q is not None: return q")
            emit(tree, "p", "q", 2)
            put(2, f"memo_{name}[p] = q")
            put(2, "return q")
        put(1, f"q = r_{self.start}(0)")
        put(1, "return q, far")
        exec("\n".join(lines), space)  # noqa: S102 - the text was made above
        return space["parse"]

    def accepts(self, kinds: str) -> bool:
        """kinds ends with END; the whole of it must be consumed."""
        return self.parse_fast(kinds)[0] == len(kinds)

    def furthest(self, kinds: str) -> int:
        """The furthest position at which a token was refused."""
        q, far = self.parse_exact(kinds)
        return min(max(far, q), len(kinds) - 1)

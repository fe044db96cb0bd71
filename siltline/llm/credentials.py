"""Credentials embedded in source code, configuration and finding evidence.

Candidates are values in the notations in which credentials stand (literals, assignments, addresses, headers,
connection strings, key blocks). A logistic regression scores them from a character Markov likelihood, the identifiers
around the value and features of the path; it is trained on weak labels that patterns give to a bounded sample.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.session import cut, hash_below

#: Labelled candidates the classifier is fitted on; a bound on the driver's work, whatever the size of the corpus.
SAMPLE = 12_000
#: Calibrated probability from which a candidate counts.
THRESHOLD = 0.5
_HASHED = 512

# Words of identifiers and values that patterns use for weak labels.
_SECRET_WORDS = "password passwd passphrase pass pwd pw secret token credential credentials cred apikey key auth authorization session bot dsn conn remote bearer"
_HARMLESS_WORDS = "hint length len url uri etag commit checksum integrity icon digest hash trace sha version public cert fingerprint size label name path endpoint file min max count id ttl timeout policy header data user username login email"
_PLACEHOLDERS = "example dummy changeme change_me placeholder your_ your- xxxx set-me todo insert replace redacted removed sample foobar 12345678 <password> none null"

_KNOWN = r"AKIA[0-9A-Z]{12,}|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{16,}|[sr]k_live_\w{16,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|\b\d{8,10}:[\w-]{30,}"
_BLOCK = re.compile(r"-----BEGIN ([A-Z ]*)-----")
# Lines of a block, whose feeds may be escaped; key text with what quotes, joins, indents, numbers or masks it, or a header of its own; key text with blanks for line feeds.
_LINE = re.compile(r"((?:[^\n\\]|\\(?![nr]))*+)(?:\n|(?:\\[nr])+|\Z|)")
_KEY_LINE = re.compile(r"(?:\d{1,6}[ \t]*[:|])?(?:[ \t\r\"'`>#|,.&;()@*\\-]|\+(?=[ \t\"']|$))*+(?:(?://|/\*)[ \t]+)?((?:[A-Za-z0-9+/=*]|\.{3}|…)*+|[\[<][^\]>\n]*[\]>]|(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID|Subject|[xX]-[\w-]+):[^\n]*)[ \t\r\"'`,.&;()*\\+]*(?:(?:Environment\.NewLine|System\.lineSeparator\(\)|PHP_EOL|EOL|os\.linesep|vbCrLf|vbLf)[ \t\r\"'`,.&;()*\\+_]*)?")
_KEY_WORDS = re.compile(r"(?:[A-Za-z0-9+/=* \t\r]|\.{3}|…)++")
# One pattern a notation, each with a literal or small set in front, which the engine skips to.
_SPECIFIC = (
    ("address", re.compile(r"://[^\s:/@\"'<>`]*:([^\s@/\"'`]{3,})@(?=[\w\[])")),
    ("header", re.compile(r"earer[ \t]+([A-Za-z0-9._~+/=-]{8,})")),
    ("header", re.compile(r"asic[ \t]+([A-Za-z0-9._~+/=-]{8,})")),
    ("connection", re.compile(r"assword=([^;\"'`\s&]{4,})(?=[;\"'&])")),
    ("connection", re.compile(r"[Pp]wd=([^;\"'`\s&]{4,})(?=[;&])")),
    ("connection", re.compile(r"(?:AccountKey|SharedAccessKey|SharedSecret)=([^;\"'`\s&]{4,})")),
    ("login", re.compile(r"(?:-u|--user)[ \t]+[\w.-]+:([^\s\"'`]{4,}+)")),
    *((("known", re.compile(f"({x})")) for x in _KNOWN.split("|"))),
)
_QUOTED = re.compile(r"([\"'`])([^\"'`\s\\<>]{4,}+)\1((?:[ \t]*+[+.]?\s*+\1[^\"'`\s\\<>]{2,}+\1)*+)")
# Assigned literals that hold what the pattern above leaves out; no prose between two literals.
_WIDE = re.compile(r"[=:>][ \t]*+(?:[bBrRuUL@]{1,2})?([\"'`])(?![ \t]*[)\],;]|[ \t]+[-+.%&|?:*=<>{])((?:[^\"'`\\\n]|\\.|(?!\1)[\"'`])++)\1")
_WIDER = re.compile(r"[\s\\<>\"'`]")
_ELEMENT = re.compile(r">([^\s\"'`<>]{6,}+)</")
_BARE = re.compile(r"^(?:[^\n=:\"'`(){}<>]{0,60}?[\w.-]+[ \t]*(?:[=:]|->)[ \t]*|[+-]?[ \t]*(?:ENV|ARG)[ \t]+\w+[ \t]+)([^\s\"'`<>(){}\[\],;]{6,}+)[ \t\r]*+$", re.MULTILINE)
_PIECE = re.compile(r"[\"'`]([^\"'`\s\\<>]+)[\"'`]")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HINT = re.compile(r"(?i)pass|pwd|_pw\b|secret|token|cred|auth|key")
_HEADER_LINE = re.compile(r"-H[ \t]+[\"'][\w.-]+:[ \t]*([^\"'\s]{6,}+)[\"']")
_NAMING = re.compile(r"(?:<\w+[^<>]*\s(?:key|name|id)=|(?i:getenv|environ\.get|\benv|get_env)\s*[\[(]\s*)$")
_ASSIGNED = re.compile(r"[A-Za-z_][\w.-]*=(?=[^=])(?!$)")
_REMARK = re.compile(r"(?:#|//|;|\b[a-z]+)[ \t]*:[ \t]*$|(?:#|//)[ \t]*(?:[a-z]+[ \t]+)*$")
_DIGIT = re.compile(r"\d")
_RUN = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+")
# A name or words: pieces of three letters and more, of camel case or between _ and dots, each with a vowel.
_PLAIN = re.compile(r"(?:(?:[a-zA-Z]{1,2}(?![a-zA-Z])|[,:;!?'()-])?[ ]|(?=[A-Z]?[a-z]*[aeiouy]|[AEIOU])(?:[A-Z][a-z]{2,}|[a-z]{3,})|(?=[A-Z]*[AEIOUY])[A-Z]{3,}(?![a-z])|[_.])++")
_CONSONANTS = re.compile(r"(?i)[bcdfghjklmnpqrstvwxz]{6}")
_KEYWORDS = frozenset("const let var export static final private public string char str env arg was old one fallback if request headers get or set entry kind svc curl h s x http https run os environ process".split())


@dataclass(frozen=True)
class Candidate:
    line: int
    start: int
    end: int
    kind: str
    value: str
    context: str


def key_blocks(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Start, start of the body, end and label of the key blocks, in order.

    A block ends at its own END, at the next BEGIN or behind its last line of key text, whichever comes first. Without
    an END, a line shorter than the one before it is the last.
    """
    at = text.find("-----BEGIN ")
    while at >= 0:
        m = _BLOCK.match(text, at)
        if not m:
            at = text.find("-----BEGIN ", at + 10)
            continue
        following = text.find("-----BEGIN ", m.end())
        limit = following if following >= 0 else len(text)
        own = text.find(f"-----END {m[1]}-----", m.end(), limit)
        limit = own if own >= 0 else limit
        stop = last = m.end()
        width = 0
        if own >= 0 and _KEY_WORDS.fullmatch(text, last, own):
            stop = last = own
        while last < limit:
            line = _LINE.match(text, last, limit)
            body = _KEY_LINE.fullmatch(line[1])
            if not body or own < 0 and width and len(body[1]) > width:
                break
            last = line.end()
            if own >= 0 and last >= own:
                stop = own
            elif body[1]:
                stop = line.start() + body.end(1)
                if own < 0 and len(body[1]) < width:
                    break
                width = len(body[1])
        yield at, m.end(), stop, m[1]
        at = following


def candidates(text: str) -> list[Candidate]:
    """Values that may be credentials, in order of position; lines are counted from 1 and split at line feeds.

    A value inside an address, header or connection string stands for the whole literal; key blocks hide what they hold.
    """
    blocks: list[tuple[int, int]] = []
    found: list[tuple[int, int, str, str]] = []
    for at, body, stop, label in key_blocks(text):
        blocks.append((at, stop))
        if "PRIVATE KEY" in label:
            found.append((at, stop, "block", text[body:stop]))
    specific = [(m.start(1), m.end(1), kind, m[1]) for kind, pattern in _SPECIFIC for m in pattern.finditer(text)]
    general = []
    for m in _QUOTED.finditer(text):
        after = text[m.end() : m.end() + 1]
        if after in (":", "]") and text[max(0, m.start() - 4) : m.start()].rstrip()[-1:] != "=" or _NAMING.search(text, max(0, m.start() - 40), m.start()):
            continue  # the name of a field or attribute
        value = m[2] + "".join(_PIECE.findall(m[3])) if m[3] else m[2]
        kind = "quoted"
        if m[3]:
            for name, pattern in _SPECIFIC[:6]:
                inner = pattern.search(value)
                if inner:
                    kind, value = name, inner[1]
                    break
        if len(value) >= 6 and (kind != "quoted" or _DIGIT.search(value) or not value.isalnum() and len(value) >= 16 or text[max(0, m.start() - 4) : m.start()].rstrip()[-1:] in ("=", ":", ">") or _HINT.search(text, max(0, m.start() - 60), m.start())):
            general.append((m.start(2), m.end() - 1, kind, value))
    for m in _WIDE.finditer(text):
        if len(m[2]) >= 6 and _WIDER.search(m[2]) and _HINT.search(text, max(0, m.start() - 60), m.start()):
            general.append((m.start(2), m.end(2), "quoted", m[2]))
    for pattern, kind in ((_ELEMENT, "element"), (_BARE, "bare"), (_HEADER_LINE, "bare")):
        for m in pattern.finditer(text):
            nested = _ASSIGNED.match(m[1]) if _REMARK.search(text, max(0, m.start(1) - 24), m.start(1)) else None  # "was NAME=value"
            general.append((m.start(1) + (nested.end() if nested else 0), m.end(1), kind, m[1][nested.end() :] if nested else m[1]))
    if specific:
        specific.sort()
        starts = [x[0] for x in specific]
        for x in general:
            i = bisect.bisect_left(starts, x[0])
            inside = i < len(starts) and starts[i] < x[1] and x[2] in ("quoted", "bare", "element")
            if not inside:
                found.append(x)
            elif specific[i][2] == "known" and specific[i][0] == x[0]:
                specific[i] = (x[0], x[1], "known", x[3])  # the literal may go on after a join
        found += specific
    else:
        found += general
    if blocks:
        found = [x for x in found if x[2] == "block" or not any(a <= x[0] < b for a, b in blocks)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[Candidate] = []
    last_end, line, counted = -1, 1, 0
    for start, end, kind, value in found:
        if start < last_end:
            continue
        last_end = end
        line += text.count("\n", counted, start)
        counted = start
        begin = text.rfind("\n", 0, start) + 1
        prefix = text[max(begin, start - 120) : start]
        if not _WORD.search(prefix) and begin > 1:
            before = text.rfind("\n", 0, begin - 1) + 1
            prefix = text[max(before, begin - 120) : begin]
        out.append(Candidate(line, start, end, kind, value, prefix))
    return out


# -- weak labels and features --------------------------------------------------------------------------------------------

_SECRET, _HARMLESS = frozenset(_SECRET_WORDS.split()), frozenset(_HARMLESS_WORDS.split())
_PLACEHOLDER = re.compile("|".join(re.escape(w) for w in _PLACEHOLDERS.split()), re.IGNORECASE)
_REFERENCE = re.compile(r"^(?:vault|secret|secrets|env|ref|ssm|keyring|op|arn|file):|\$\{|\$\(|\{\{|%\(|^\$|^process\.env|^os\.|getenv|^@|\(\)")
_CHECKSUM = re.compile(r"^(?:sha\d{1,3}|md5)[-:]|^data:|^https?://[^:@]*$|^\w+://[^:@]*$", re.IGNORECASE)
_KNOWN_RX = re.compile(_KNOWN)


def words(context: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(context) if not w.isdigit() and w.lower() not in _KEYWORDS]


def _decoded(value: str) -> str:
    """The text behind a base64 value, if there is one."""
    if len(value) >= 8 and len(value) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]+=*", value):
        try:
            text = base64.b64decode(value, validate=True).decode("ascii")
        except (binascii.Error, ValueError):
            return ""
        return text if text.isprintable() else ""
    return ""


def placeholder(kind: str, value: str) -> bool:
    if kind == "block":
        return len(re.sub(r"[^A-Za-z0-9+/]", "", value)) < 40 or "*" * 8 in value or "[removed]" in value
    core = value.replace("*", "")
    inner = _decoded(value)
    if inner:
        inner = inner.split(":", 1)[-1]
    return len(core) < 0.5 * len(value) or len(set(value.lower())) < 4 or bool(_PLACEHOLDER.search(value)) or bool(inner and _PLACEHOLDER.search(inner)) or bool(_CHECKSUM.search(value))


def plain(value: str) -> bool:
    """Whether a value reads as words or as a name, so that it may refer to something instead of being it."""
    return _PLAIN.fullmatch(value) is not None and not _CONSONANTS.search(value)


def weak_label(kind: str, value: str, context: str) -> float | None:
    """1 or 0 where a pattern says so, None where none does, as for literals with blanks."""
    if placeholder(kind, value) or _REFERENCE.search(value):
        return 0.0
    if kind == "quoted" and " " in value:
        return None
    if kind in ("block", "address", "header", "login", "connection") or _KNOWN_RX.match(value):
        return 1.0
    inner = _decoded(value)
    if inner and any(pattern.search(inner) for _, pattern in _SPECIFIC):
        return 1.0
    names = words(context)
    if not names:
        return None
    if names[-1] in _HARMLESS:
        return 0.0
    secret = [w for w in names[-4:] if w in _SECRET]
    if not secret or plain(value):
        return 0.0
    strong = sum((any(c.isdigit() for c in value), any(c.isalpha() for c in value), any(not c.isalnum() for c in value)))
    return 1.0 if strong >= 2 and len(value) >= 8 else None


def _bucket(text: str) -> int:
    return binascii.crc32(text.encode()) % _HASHED


_CODES = np.clip(np.arange(256) - 31, 0, 96)


class Markov:
    """Log-likelihood ratio per character of two first-order chains over printable characters."""

    def __init__(self, values: list[str], labels: list[float]):
        counts = np.full((2, 97, 97), 0.2)
        for value, label in zip(values, labels):
            codes = self.codes(value)
            np.add.at(counts[int(label)], (codes[:-1], codes[1:]), 1)
        chains = counts / counts.sum(axis=2, keepdims=True)
        self.ratio = np.log(chains[1] / chains[0])

    @staticmethod
    def codes(value: str) -> np.ndarray:
        return _CODES[np.frombuffer(b"\x1f" + value.encode("latin-1", "replace"), np.uint8)]

    def score(self, value: str) -> float:
        codes = self.codes(value)
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if value else 0.0


def features(markov: Markov, kind: str, value: str, context: str, path: str) -> tuple[list[float], list[int]]:
    """Dense features and the columns of hashed ones."""
    n = max(1, len(value))
    names = words(context)
    near = names[-4:]
    inner = _decoded(value)
    digits, upper, other = sum(map(str.isdigit, value)), sum(map(str.isupper, value)), len(value) - sum(map(str.isalnum, value))
    changes = max(0, len(_RUN.findall(value)) - 1)
    fake, known, name_like = placeholder(kind, value), bool(_KNOWN_RX.match(value)), plain(value)
    dense = [
        1.0, markov.score(value), math.log(n) / 3, digits / n, upper / n, other / n, changes / n,
        float(fake), float(bool(_REFERENCE.search(value))), float(known), float(known and not fake), float(name_like), float(name_like and kind == "bare"),
        float(any(w in _SECRET for w in near)), float(bool(near) and near[-1] in _HARMLESS), float(not near), float(n < 8), min(n, 500) / 100, float(bool(inner)), float(bool(inner) and any(pattern.search(inner) for _, pattern in _SPECIFIC)),
        *[float(kind == k) for k in ("block", "address", "header", "connection", "known", "element", "login", "bare", "quoted")],
    ]
    folder, _, base = path.replace("\\", "/").rpartition("/")
    hashed = {_bucket("w:" + w) for w in near} | ({_bucket("l:" + near[-1])} if near else set())
    hashed |= {_bucket("p:" + p) for p in folder.lower().split("/") if p in ("test", "tests", "docs", "doc", "examples", "snippets", "fixtures", "deploy", "config")} | {_bucket("x:" + base.rpartition(".")[2].lower())}
    return dense, sorted(hashed)


_MARKOV = 1  # the dense feature with the likelihood
#: Dense features that the weak labels are made of: placeholder, reference, known shape, words near the value, inner shape, kinds that label.
_LABELLING = [7, 8, 9, 10, 11, 12, 13, 14, 15, 19, 20, 21, 22, 23, 24, 26]


@dataclass
class Model:
    markov: Markov
    dense: np.ndarray
    hashed: np.ndarray
    scale: tuple[float, float]

    def raw(self, kind: str, value: str, context: str, path: str) -> float:
        x, h = features(self.markov, kind, value, context, path)  # weights of features left out are 0
        return float(np.dot(self.dense, x) + self.hashed[h].sum())

    def probability(self, kind: str, value: str, context: str, path: str) -> float:
        z = self.scale[0] * self.raw(kind, value, context, path) + self.scale[1]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _descend(x: np.ndarray, y: np.ndarray, decay: np.ndarray, balanced: bool = True, steps: int = 150) -> np.ndarray:
    """Weights of a logistic regression, by Adam; balanced means that both labels weigh alike."""
    x, y, decay = x.astype(np.float32), y.astype(np.float32), decay.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32) if balanced else np.float32(1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ ((p - y) * weight) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(sample: pd.DataFrame, rules: bool = True) -> Model:
    """kind, value, context, path, label → model; trained on all rows, calibrated on scores of rows held out in turn. Without both labels every candidate scores by its weak label's prior."""
    if not len(sample) or sample["label"].nunique() < 2:
        both = pd.DataFrame({"kind": ["known", "quoted"], "value": ["ghp_" + "a1B2c3D4e5" * 3, "relay-ivory"], "context": ["token = ", "name = "], "path": ["a.py", "a.py"], "label": [1.0, 0.0]})
        sample = pd.concat([sample, both, both, both, both], ignore_index=True)
    labels = sample["label"].to_numpy()
    markov = Markov(sample["value"].tolist(), labels.tolist())
    made = [features(markov, *r) for r in zip(sample["kind"], sample["value"], sample["context"], sample["path"])]
    n = len(made[0][0])
    x = np.zeros((len(made), n + _HASHED), np.float32)
    for i, (dense, hashed) in enumerate(made):
        x[i, :n] = dense
        x[i, [n + h for h in hashed]] = 1
    if not rules:
        x[:, _LABELLING] = 0
    decay = np.full(x.shape[1], 1e-4)
    # each of three parts of the sample is scored by a model of the other two; these scores calibrate the model of all
    turn = sample.groupby("label").cumcount().to_numpy() % 3
    z = np.zeros(len(x))
    for part in range(3):
        train, held = x[turn != part], x[turn == part]
        chain = Markov(sample["value"][turn != part].tolist(), labels[turn != part].tolist())
        of_part = np.array([chain.score(v) for v in sample["value"]])
        train[:, _MARKOV], held[:, _MARKOV] = of_part[turn != part], of_part[turn == part]
        z[turn == part] = held @ _descend(train, labels[turn != part], decay)
    a, b = _descend(np.c_[z, np.ones(len(z))], labels, np.array([1e-4, 1e-4]), balanced=False)
    w = _descend(x, labels, decay)
    return Model(markov, w[:n], w[n:], (float(a), float(b)))


# -- tables --------------------------------------------------------------------------------------------------------------

_CANDIDATES = "place string, row_id long, delivery long, path string, line_no int, start int, end int, kind string, value string, context string, label double"


def readable_share(value: str, line: str, start: int, end: int, other: str) -> float:
    """The share of a value's characters that still stand in another version of its line."""
    tail = line[end:]
    if other[:start] == line[:start] and other.endswith(tail) and len(other) >= start + len(tail):
        shown = other[start : len(other) - len(tail)]
        if len(shown) == len(value):
            return sum(a == b for a, b in zip(shown, value)) / len(value)
        head = next((i for i, (a, b) in enumerate(zip(shown, value)) if a != b), min(len(shown), len(value)))
        rest = next((i for i, (a, b) in enumerate(zip(shown[head:][::-1], value[head:][::-1])) if a != b), min(len(shown), len(value)) - head)
        return (head + rest) / len(value)
    return 1.0 if value in other else 0.0


def _redacted_rows(evidence: str | None, redacted: str, found: list[Candidate]) -> list[Candidate]:
    """The evidence's candidates that are still readable in the redacted text; without evidence the text's own."""
    if evidence is None:
        return [c for c in candidates(redacted) if c.kind == "block" or c.value.count("*") * 2 < len(c.value)]
    lines, others = evidence.split("\n"), redacted.split("\n")
    out = []
    blocks = (b for b in key_blocks(redacted) if "PRIVATE KEY" in b[3])
    for c in found:
        if c.kind == "block":
            body = lambda t: len(re.sub(r"[^A-Za-z0-9+/=]", "", re.sub(r"\[removed\]|-----[A-Z ]*-----", "", t)))
            begin, inner, close, _ = next(blocks, (-1, 0, 0, ""))
            if begin >= 0 and body(redacted[inner:close]) * 2 > body(c.value):
                out.append(Candidate(redacted.count("\n", 0, begin) + 1, begin, close, c.kind, c.value, c.context))
            continue
        if c.line > len(others):
            continue
        offset = sum(len(x) + 1 for x in lines[: c.line - 1])
        if readable_share(evidence[c.start : c.end], lines[c.line - 1], c.start - offset, c.end - offset, others[c.line - 1]) > 0.5:
            at = sum(len(x) + 1 for x in others[: c.line - 1]) + c.start - offset
            out.append(Candidate(c.line, at, at + len(others[c.line - 1]) - len(lines[c.line - 1]) + c.end - c.start, c.kind, c.value, c.context))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _CANDIDATES.split(", ")]).astype({"label": "float64"})


def _row(place: str, row_id: int, delivery: int, path: str | None, c: Candidate) -> tuple:
    return place, row_id, delivery, path or "", c.line, c.start, c.end, c.kind, c.value, c.context, weak_label(c.kind, c.value, c.context)


def _text(content: bytes) -> str:
    """Characters are counted in this text, here and where spans are blotted out."""
    return content.decode("utf-8", "replace")


def _file_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, delivery, path, content in zip(batch["file_id"], batch["delivery"], batch["rel_path"], batch["content"]):
            rows.extend(_row("content", file_id, delivery, path, c) for c in candidates(_text(content)))
        yield _frame(rows)


def _evidence_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for finding_id, one, other, path, evidence, redacted in zip(batch["finding_id"], batch["delivery"], batch["delivery2"], batch["file"], batch["evidence"], batch["redacted_evidence"]):
            found = candidates(evidence) if evidence is not None else []
            rows.extend(_row("evidence", finding_id, one, path, c) for c in found)
            if redacted is not None and (found or evidence is None):
                rows.extend(_row("redacted_evidence", finding_id, other, path, c) for c in _redacted_rows(evidence, redacted, found))
        yield _frame(rows)


def find_candidates(files: DataFrame, findings: DataFrame) -> DataFrame:
    """All candidates of non-binary contents, evidence and redacted evidence, with weak labels; null texts have none. ``delivery`` is the hash of the text."""
    contents = files.where(~F.coalesce("is_binary", F.lit(False)) & F.col("content").isNotNull()).select("file_id", F.xxhash64("content").alias("delivery"), "rel_path", "content")
    evidence = findings.where("evidence is not null or redacted_evidence is not null").select(
        "finding_id", F.xxhash64(F.col("evidence").cast("binary")).alias("delivery"), F.xxhash64(F.col("redacted_evidence").cast("binary")).alias("delivery2"), "file", "evidence", "redacted_evidence"
    )
    return contents.mapInPandas(_file_candidates, _CANDIDATES).unionByName(evidence.mapInPandas(_evidence_candidates, _CANDIDATES))


def score_credentials(files: DataFrame, findings: DataFrame, sample: int = SAMPLE, rules: bool = True) -> DataFrame:
    """Every candidate with its calibrated probability: place, row_id, delivery, line_no, start, end, kind, value, probability.

    The sample is the labelled candidates with the smallest hashes, so it is the same at every run and spread over the
    corpus. Equal deliveries of a row give the same rows once, others their own. Characters are counted from 0 in the decoded
    text. Without ``rules`` the tests that give weak labels are no features.
    """
    found = cut(find_candidates(files, findings).dropDuplicates(["place", "row_id", "delivery", "start", "end", "value"]))
    order = F.xxhash64("value", "context", "path")
    labelled = found.where("label is not null")
    n = labelled.count()
    chosen = labelled.where(hash_below(order, 1.5 * sample / max(1, n)))  # what goes to the driver is bounded before it is sorted
    rows = chosen.orderBy(order, "place", "row_id", "start").limit(sample).select("kind", "value", "context", "path", "label").toPandas()
    if n and not len(rows):
        raise ValueError("no labelled candidate fell into the sample")
    model = fit(rows, rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = [model.probability(*r) for r in zip(batch["kind"], batch["value"], batch["context"], batch["path"])]
            yield batch.drop(columns=["context", "path"]).assign(probability=pd.Series(p, dtype="float64"))

    return found.select("place", "row_id", "delivery", "line_no", "start", "end", "kind", "value", "context", "path").mapInPandas(
        run, "place string, row_id long, delivery long, line_no int, start int, end int, kind string, value string, probability double"
    )


def found_credentials(files: DataFrame, findings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score_credentials(files, findings).where(F.col("probability") >= threshold).select("place", "row_id", "line_no").distinct()


_KEPT = re.compile(r"-----BEGIN [A-Z ]*-----|\\[nrt]|[\"'`]\s*[+.]?\s*[\"'`]|[\s\"'`\\]|(.)", re.DOTALL)


def blot(text: str, spans: list[tuple[int, int]], fill: str = "X") -> str:
    """The text with the characters of the spans replaced; line ends, quotes, joins of literals and key heads stay, so it stays well-formed."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], _KEPT.sub(lambda m: fill if m[1] else m[0], text[start:end])]
            at = end
    return "".join([*out, text[at:]])


def redact_texts(files: DataFrame, findings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """place, row_id, redacted: the texts in which credentials were found, with them blotted out; differing deliveries of a row each by their own places."""
    key = ["place", "row_id", "delivery"]
    spans = score_credentials(files, findings).where(F.col("probability") >= threshold).groupBy(*key).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    parts = [files.select(F.lit("content").alias("place"), F.col("file_id").alias("row_id"), F.col("content").alias("text"))]
    parts += [findings.select(F.lit(c).alias("place"), F.col("finding_id").alias("row_id"), F.col(c).cast("binary").alias("text")) for c in ("evidence", "redacted_evidence")]
    texts = reduce(DataFrame.unionByName, parts).where(F.col("text").isNotNull()).withColumn("delivery", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [blot(_text(t), [(s["start"], s["end"]) for s in spans]) for t, spans in zip(batch["text"], batch["spans"])]
            yield batch[["place", "row_id"]].assign(redacted=pd.Series(done, dtype=object))

    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key])  # a null id is a row too
    return texts.alias("t").join(spans.alias("s"), same).select("t.place", "t.row_id", "t.text", "s.spans").mapInPandas(run, "place string, row_id long, redacted string").distinct()

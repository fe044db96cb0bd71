"""Generated, minified and vendored source files, and data kept as code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.parsing import decoded
from siltline.llm.repair import grammar_sizes, shared_phrases
from siltline.session import cut

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*+|\d[\w.]*+|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`|\n|[^\s\w]")
_KEYWORDS = frozenset("if else for while do return def class function func var let const import from package public private static final void int string new try catch except finally switch case break continue struct type interface export extends implements this self in of and or not is null None true false True False end then fi done esac local echo".split())

# Whole lines of comment, by the signs of the language; others are left in place, where they weigh little.
_HASH_LINES, _DASH_LINES, _SLASH_LINES = r"^[ \t]*#[^\n]*+\n?", r"^[ \t]*--[^\n]*+\n?", r"^[ \t]*//[^\n]*+\n?|^[ \t]*/\*(?:[^*]|\*(?!/))*+\*/[ \t]*\n?"
_TAG_LINES = r"^[ \t]*<!--(?:[^-]|-(?!->))*+-->[ \t]*\n?"
# Languages whose comments begin with other signs than // and /*.
_HASH_LANGUAGES = ("python", "shell", "bash", "ruby", "perl", "r", "powershell", "terraform", "makefile", "yaml", "toml", "julia", "elixir")
_DASH_LANGUAGES = ("sql", "lua", "haskell", "ada", "vhdl", "elm")
_TAG_LANGUAGES = ("html", "xml", "vue", "svelte")
_COMMENTS = {
    **{name: re.compile(_HASH_LINES, re.MULTILINE) for name in _HASH_LANGUAGES},
    **{name: re.compile(f"{_DASH_LINES}|{_SLASH_LINES}", re.MULTILINE) for name in _DASH_LANGUAGES},
    **{name: re.compile(f"{_TAG_LINES}|{_SLASH_LINES}", re.MULTILINE) for name in _TAG_LANGUAGES},
    "php": re.compile(f"{_HASH_LINES}|{_SLASH_LINES}", re.MULTILINE),
}
_OTHER_COMMENTS = re.compile(_SLASH_LINES, re.MULTILINE)

_NAME, _NUMBER, _TEXT, _LONG, _LINE_END = 1, 2, 3, 4, 5
#: String literals from so many characters on are looked at by character.
LONG_LITERAL = 48
#: Numbers that follow one another with at most two signs between them are a literal from so many on.
LONG_ARRAY = 16
#: Characters of long literals that share a grammar; it bounds memory, not what is measured.
LITERAL_BLOCK = 24_000


#: Languages of configuration, which is not written as a program.
CONFIGURATION = ("json", "yaml", "xml", "properties", "dotenv", "dockerfile", "toml", "ini", "markdown", "text")
#: Limits of the classes. Generated: a grammar of at most so many symbols a token, at 100 tokens and less by the slope for ten times
#: as many (any text compresses better the longer it is), but never below the floor.
GENERATED_RATIO, GENERATED_SLOPE, GENERATED_FLOOR, GENERATED_TOKENS = 0.34, 0.13, 0.06, 40
#: Minified: of at least so many rules of the grammar with line ends at most such a share runs over a line end; it is a half in written code.
MINIFIED_RULES, MINIFIED_BROKEN, MINIFIED_TOKENS = 8, 0.05, 80
#: Data: share of characters in long literals and arrays of numbers, and size of their grammars against random text.
DATA_LITERALS, DATA_RATIO, DATA_CHARS = 0.50, 0.85, 1000
#: Vendored: share of tokens in phrases that other repositories have too.
SHARED, SHARED_TOKENS = 0.60, 80


def without_comments(text: str, language: str) -> str:
    return _COMMENTS.get(language.lower(), _OTHER_COMMENTS).sub("", text)


def _kind(token: str) -> int:
    first = token[0]
    if first in "\"'`":  # a key or certificate kept in code is none of its data
        return _LONG if len(token) >= LONG_LITERAL and token[1:12] != "-----BEGIN " else _TEXT
    if first.isdigit():
        return _NUMBER
    if first == "\n":
        return _LINE_END
    if first.isalpha() or first in "_$":
        return 16 + xxhash.xxh32_intdigest(token) if token in _KEYWORDS else _NAME
    return 8 + (ord(first) << 33)


@dataclass
class Lexicon:
    """Numbers, kinds and hashes of the tokens of a batch."""

    numbers: dict[str, int]
    kinds: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, tokens: list[str]) -> Lexicon:
        numbers = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        fill = lambda f, kind: np.fromiter(map(f, numbers), kind, len(numbers))
        return cls(numbers, fill(_kind, np.uint64), fill(xxhash.xxh64_intdigest, np.uint64), fill(len, np.int64))

    def ids(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))


def _bits(codes: np.ndarray) -> float:
    """Entropy of the characters, in bits a character."""
    share = np.bincount(codes) / max(1, len(codes))
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum())


def literal_ratios(codes: list[np.ndarray]) -> np.ndarray:
    """Size of the character grammars of each sequence against that of the same characters in random order: 1 is incompressible.

    The comparison makes up for length and alphabet: a grammar of random hex saves more than one of random base64, and
    any the more the longer the text. A sequence longer than a block has a grammar for each block, whose ratios are
    averaged by length; blocks of less than one bit a character, in any order, count the less.
    """
    blocks = [(j, c[at : at + LITERAL_BLOCK]) for j, c in enumerate(codes) for at in range(0, len(c), LITERAL_BLOCK)]
    total = np.zeros(len(codes))
    rounds = np.cumsum([len(c) for _, c in blocks]) // (20 * LITERAL_BLOCK)  # blocks of a round, which bound the memory
    for part in range(int(rounds[-1]) + 1 if len(blocks) else 0):
        chosen = [blocks[b] for b in np.flatnonzero(rounds == part)]
        if chosen:
            owners, lengths = [j for j, _ in chosen], np.array([len(c) for _, c in chosen])
            mixed = [np.random.default_rng(len(c)).permutation(c) for _, c in chosen]
            n, r, _ = grammar_sizes(np.concatenate([*(c for _, c in chosen), *mixed]).astype(np.uint64), np.repeat(np.arange(2 * len(chosen)), np.r_[lengths, lengths]), 2 * len(chosen))
            size = n + 2 * r
            weight = lengths * np.minimum(1.0, [_bits(c) for _, c in chosen])
            np.add.at(total, owners, weight * size[: len(chosen)] / np.maximum(1, size[len(chosen) :]))
    return total / np.maximum(1, [len(c) for c in codes])


def _core(token: str) -> str:
    """What a literal holds: a string without its quotes, a number without its notation (0x, leading zeros, decimal point)."""
    return token.lstrip("0xX").replace(".", "") if token[0].isdigit() else token.strip("\"'`")


def _arrays(numbers: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of the places of numbers those in an array of LONG_ARRAY and more."""
    if not len(numbers):
        return numbers
    new = np.r_[True, (np.diff(numbers) > 3) | (owner[numbers][1:] != owner[numbers][:-1])]
    run = np.cumsum(new) - 1
    return numbers[np.bincount(run)[run] >= LONG_ARRAY]


def measure(texts: list[str], languages: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """One row of grammar figures a text, and (hash, owner, width) of the phrases of all texts."""
    count = len(texts)
    bodies = [without_comments(t.replace("\0", "") if "\0" in t else t, g) for t, g in zip(texts, languages)]  # blocks of NUL bytes are damage, not repetition
    lists = [_TOKEN.findall(b) for b in bodies]
    tokens = [t for x in lists for t in x]
    lexicon = Lexicon.of(tokens)
    every = lexicon.ids(tokens)
    owners = np.repeat(np.arange(count), np.fromiter(map(len, lists), np.int64, count))
    ends = lexicon.kinds[every] == _LINE_END if len(every) else np.zeros(0, bool)
    _, line_rules, broken = grammar_sizes(lexicon.kinds[every], owners, count, ends) if len(every) else [np.zeros(count, np.int64)] * 3

    ids, owner = every[~ends], owners[~ends]
    kinds = lexicon.kinds[ids] if len(ids) else np.zeros(0, np.uint64)
    hashes = lexicon.hashes[ids] if len(ids) else np.zeros(0, np.uint64)
    lengths = lexicon.lengths[ids] if len(ids) else np.zeros(0, np.int64)
    left, rules, _ = grammar_sizes(kinds, owner, count)
    sizes = np.bincount(owner, minlength=count)
    chars = np.bincount(owner, weights=lengths, minlength=count)
    # long literals and arrays of numbers by character: near-incompressible ones are data
    literal = kinds == _LONG
    literal[_arrays(np.flatnonzero(kinds == _NUMBER), owner)] = True
    share = np.bincount(owner[literal], weights=lengths[literal], minlength=count) / np.maximum(chars, 1)
    ratios = np.full(count, np.nan)
    big = np.flatnonzero((share >= DATA_LITERALS) & (chars >= DATA_CHARS))
    if len(big):
        names = list(lexicon.numbers)
        places = np.flatnonzero(literal)
        first, last = np.searchsorted(owner[places], big), np.searchsorted(owner[places], big, side="right")
        ratios[big] = literal_ratios([np.frombuffer("".join(_core(names[k]) for k in ids[places[a:b]]).encode("latin-1", "replace"), np.uint8) for a, b in zip(first, last)])
    frame = pd.DataFrame({
        "tokens": sizes, "ratio": (left + 2 * rules) / np.maximum(sizes, 1), "chars": chars, "literal_share": share, "literal_ratio": ratios,
        "line_rules": line_rules, "broken_share": broken / np.maximum(line_rules, 1),
    })
    return (frame, *shared_phrases(hashes, owner))


# -- tables --------------------------------------------------------------------------------------------------------------

_CHUNK_BYTES = 600_000
#: A phrase with one in so many of all phrase rows and more is hot; its rows are spread over so many join keys.
HOT, SALTS = 256, 32

# A library's own head: name with version, and a licence that isn't this repository's.
_FOREIGN_HEAD = re.compile(r"\bv\d+\.\d+(?:\.\d+)?\b[\s\S]{0,200}?\b(?:released|licen[sc]ed|distributed) under the (?:MIT|BSD|Apache|ISC|MPL|L?GPL|zlib)", re.IGNORECASE)
# What may stand before a file's first code: blanks and comments.
_LEADING = re.compile(r"(?:[\s\ufeff]++|<\?php\b|//[^\n]*+|#[^\n]*+|--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|<!--(?:[^-]|-(?!->))*+-->|\"\"\"(?:[^\"]|\"(?!\"\"))*+\"\"\")*+")
_FIGURES = "file_id long, repo string, language string, at long, tokens long, ratio double, chars double, literal_share double, literal_ratio double, line_rules long, broken_share double, foreign_head boolean, phrases array<long>, widths array<int>"


def foreign_head(text: str) -> bool:
    """Whether a library's own head stands in the leading comments, or in the first 800 characters if code comes before."""
    return _FOREIGN_HEAD.search(text, 0, max(800, _LEADING.match(text).end())) is not None


def _measure_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = np.cumsum([len(c) for c in batch["content"]]) // _CHUNK_BYTES
        for _, part in batch.groupby(sizes, sort=False):
            texts = [decoded(c) for c in part["content"]]
            frame, phrase, owner, width = measure(texts, part["language"].tolist())
            keep = width >= 4
            phrase, owner, width = phrase[keep], owner[keep], width[keep].astype(np.int32)
            cuts = np.searchsorted(owner, np.arange(1, len(texts)))
            for i, name in enumerate(("file_id", "repo", "language", "at")):
                frame.insert(i, name, part[name].to_numpy())
            frame["foreign_head"] = [foreign_head(t) for t in texts]
            frame["phrases"], frame["widths"] = np.split(phrase, cuts), np.split(width, cuts)
            yield frame


def file_origins(files: DataFrame) -> DataFrame:
    """Grammar figures and the flags generated, minified, data and vendored of every non-binary source file.

    ``literal_ratio`` is null where literals are too few or too short to matter. All four flags come from the grammars. ``foreign_head`` tells apart, and sets no flag, whether a library's licence
    head stands in the leading comments, as a hint at copies that only one repository holds.

    Files of unknown or configuration languages and null contents aren't judged. A file delivered several times counts
    once, by its latest delivery. A repository counts once however many copies it holds; a null repository is one
    repository.
    """
    rows = files.where(~F.coalesce("is_binary", F.lit(False)) & F.col("content").isNotNull() & F.col("language").isNotNull())
    at = F.coalesce(F.unix_micros("discovered_at") if "discovered_at" in files.columns else F.lit(None).cast("long"), F.lit(-(2**62))).alias("at")
    rows = rows.where(~F.lower("language").isin(*CONFIGURATION)).select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), "language", at, "content")
    measured = rows.mapInPandas(_measure_batches, _FIGURES)
    others = [c for c in measured.columns if c != "file_id"]
    latest = F.max_by(F.struct(*others), F.struct("at", F.xxhash64(*others))).alias("f")
    figures = cut(measured.groupBy("file_id").agg(latest).select("file_id", "f.*").drop("at"))
    phrases = figures.select("file_id", "repo", F.explode(F.arrays_zip("phrases", "widths")).alias("p")).select("file_id", "repo", F.col("p.phrases").alias("phrase"), F.col("p.widths").alias("width"))
    # lowest and highest repository by hash: two numbers tell whether there are at least two, without a set for each phrase
    place = F.xxhash64("repo")
    spread = cut(phrases.groupBy("phrase").agg(F.min(place).alias("_a"), F.max(place).alias("_b"), F.count("*").alias("_n")).where("_a <> _b").select("phrase", "_n"))
    # phrases that very many files have, at most HOT by definition, are spread over several join keys
    every = figures.agg(F.sum(F.size("phrases"))).first()[0] or 0
    hot = [r["phrase"] for r in spread.where(F.col("_n") * HOT >= F.lit(every)).collect()]
    is_hot = F.col("phrase").isin(hot) if hot else F.lit(False)
    salted = phrases.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    keys = spread.select("phrase", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    shared = salted.join(keys, ["phrase", "_salt"], "left_semi").groupBy("file_id").agg(F.sum("width").alias("_shared"))
    out = figures.drop("phrases", "widths").join(shared, "file_id", "left").withColumn("shared_share", F.coalesce(F.col("_shared") / F.col("tokens"), F.lit(0.0))).drop("_shared")
    generated_limit = F.greatest(F.lit(GENERATED_FLOOR), GENERATED_RATIO - GENERATED_SLOPE * F.log10(F.greatest(F.lit(1), F.col("tokens")) / 100.0))
    return out.select(
        "*",
        ((F.col("tokens") >= GENERATED_TOKENS) & (F.col("ratio") <= generated_limit)).alias("generated"),
        ((F.col("tokens") >= MINIFIED_TOKENS) & (F.col("line_rules") >= MINIFIED_RULES) & (F.col("broken_share") <= MINIFIED_BROKEN)).alias("minified"),
        ((F.col("chars") >= DATA_CHARS) & (F.col("literal_share") >= DATA_LITERALS) & (F.col("literal_ratio") >= DATA_RATIO)).alias("data"),
        ((F.col("tokens") >= SHARED_TOKENS) & (F.col("shared_share") >= SHARED)).alias("vendored"),
    )


def not_handwritten(files: DataFrame) -> DataFrame:
    return file_origins(files).where("generated or minified or data or vendored").select("file_id")


def origin_rates(origins: DataFrame) -> DataFrame:
    """Files and files of each class per repository and language."""
    return origins.groupBy("repo", "language").agg(F.count("*").alias("files"), *[F.count_if(c).alias(c) for c in ("generated", "minified", "data", "vendored")])

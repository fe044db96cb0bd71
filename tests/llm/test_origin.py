"""Grammar inference and file origins."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm.origin import DATA_RATIO, file_origins, foreign_head, measure, not_handwritten, without_comments
from siltline.llm.repair import grammar_sizes, shared_phrases


def sizes(*texts):
    symbols = np.array([ord(c) for t in texts for c in t], np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return grammar_sizes(symbols, owner, len(texts))


def test_repetition_shrinks():
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 2000)) for _ in range(1000))
    left, rules, _ = sizes("abcdefgh" * 128, noise, "", "a", "ab" * 4)
    assert left[0] + 2 * rules[0] < 60
    assert left[1] + 2 * rules[1] > 950
    assert left[2] == 0 and left[3] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=60), min_size=1, max_size=5))
def test_sequences_do_not_mix_and_never_grow(texts):
    left, rules, marked = sizes(*texts)
    for i, t in enumerate(texts):
        alone = sizes(t)
        assert (left[i], rules[i], marked[i]) == tuple(x[0] for x in alone)
        assert left[i] + 2 * rules[i] <= max(len(t), left[i] + len(t)) and left[i] <= len(t)


def test_rules_over_a_mark():
    text = "ab;cd\n" * 8
    _, rules, marked = grammar_sizes(np.array([ord(c) for c in text], np.uint64), np.zeros(len(text), int), 1, np.array([c == "\n" for c in text]))
    assert 0 < marked[0] < rules[0]
    _, rules, marked = grammar_sizes(np.array([ord(c) for c in "ab;cd" * 8], np.uint64), np.zeros(40, int), 1, np.zeros(40, bool))
    assert rules[0] > 0 and marked[0] == 0


def test_phrases_of_a_shared_stretch_agree():
    for seed in range(30):
        rng = random.Random(seed)
        shared, before, after = ([rng.randrange(10**6) for _ in range(n)] for n in (400, rng.randrange(30), rng.randrange(30)))
        a, b = shared, before + shared + after
        h, owner, width = shared_phrases(np.array(a + b, np.uint64), np.repeat([0, 1], [len(a), len(b)]), 3)
        assert width[owner == 0].sum() == len(a) and width[owner == 1].sum() == len(b)
        common = set(h[owner == 0]) & set(h[owner == 1])
        assert sum(w for x, o, w in zip(h, owner, width) if o == 0 and x in common) >= 200


def hand(i):
    """Source that people wrote: modules of the standard library."""
    import argparse, ast, bisect, calendar, cmd, csv, fnmatch, glob, heapq, inspect, pprint, shlex, textwrap, timeit

    return inspect.getsource([textwrap, bisect, calendar, cmd, csv, fnmatch, glob, heapq, pprint, shlex, timeit, argparse, ast][i % 13]).encode()


SCHEMA = "file_id long, repo string, language string, is_binary boolean, content binary"


def test_classes(spark):
    rng = random.Random(3)
    generated = "".join(f"def get_field_{i}(self):\n    return self._f[{i}]\n\n" for i in range(60)).encode()
    minified = ("!function(){" + "".join(f"var a{i}=function(b){{return b+{i}}};" for i in range(200)) + "}();").encode()
    blob = ('DATA = "' + "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(4000)) + '"\n').encode()
    numbers = ("T = [" + ", ".join(str(rng.randrange(10**6)) for _ in range(600)) + "]\n").encode()
    lib = hand(11)
    rows = [(1, "a", "python", False, generated), (2, "a", "javascript", False, minified), (3, "a", "python", False, blob), (4, "a", "python", False, numbers), (5, "a", "python", False, lib), (6, "b", "python", False, b"# other head\n" + lib)]
    rows += [(10 + i, "abc"[i % 3], "python", False, hand(i)) for i in range(11)]
    rows += [(30, "a", "json", False, generated), (31, "a", "python", True, generated), (32, "a", "python", False, b""), (33, None, "python", None, hand(12)), (34, "a", None, False, generated), (35, "a", "python", False, None), (1, "a", "python", False, generated)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("phrase", "width", "ratio", "_shared", "phrases")})
    assert sorted(r["file_id"] for r in not_handwritten(df).collect()) == [1, 2, 3, 4, 5, 6]
    flags = {r["file_id"]: [c for c in ("generated", "minified", "data", "vendored") if r[c]] for r in file_origins(df).where("file_id < 7").collect()}
    assert "generated" in flags[1] and "minified" in flags[2] and flags[3] == ["data"] and "data" in flags[4] and flags[5] == flags[6] == ["vendored"]


def test_same_repository_shares_nothing(spark):
    lib = hand(11)
    df = spark.createDataFrame([(1, "a", "python", False, lib), (2, "a", "python", False, lib)], SCHEMA)
    assert not_handwritten(df).count() == 0
    assert not_handwritten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_literals_are_measured_to_their_end():
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    texts = ['P = "' + "A" * 210_000 + '"\nD = "' + noise(400_000) + '"\n', 'D = "' + noise(200_000) + '"\nP = "' + "A" * 600_000 + '"\n', 'D = "' + noise(300_000) + '"\n', 'D = "' + noise(3_000) + '"\n']
    late, early, long, short = measure(texts, ["python"] * 4)[0]["literal_ratio"]
    assert late > 0.5 and early < 0.3 and long > 0.75 and short > 0.75


def test_blobs_of_any_length_and_alphabet(spark):
    rng = random.Random(6)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    letters = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "bits": "01"}
    for name, alphabet in letters.items():
        texts = [f'D = "{draw(alphabet, n)}"\n' for n in (1_200, 4_000, 30_000, 200_000)] + ['D = [\n' + "".join(f'    "{draw(alphabet, 64)}",\n' for _ in range(300)) + "]\n"]
        figures = measure(texts, ["python"] * len(texts))[0]
        assert (figures["literal_ratio"] > DATA_RATIO).all() and (figures["literal_share"] > 0.5).all(), name
    octets = ["T = [" + ", ".join(f"0x{rng.randrange(256):02x}" for _ in range(n)) + "]\n" for n in (400, 20_000)]
    octets += ["T = [" + ", ".join(str(rng.randrange(256)) for _ in range(600)) + "]\n", "T = [" + ", ".join(f"{rng.random():.6f}" for _ in range(600)) + "]\n"]
    assert (measure(octets, ["python"] * 4)[0]["literal_ratio"] > DATA_RATIO).all()
    prose = 'HELP = """' + " ".join(rng.choices("the scan reads every file of a tree and writes what it has found into one report".split(), k=900)) + '"""\nTEXT = "' + " ".join(rng.choices("no rule of this table may name a file that is not there".split(), k=900)) + '"\n'
    assert measure([prose], ["python"])[0]["literal_ratio"][0] < 0.8


def test_statements_that_look_like_comments_stay():
    body = "int f(int *p) {\n    *p = 1;\n    *q++ = 2;\n    --x;\n}\n"
    assert without_comments(body, "c") == body
    assert without_comments("/* a\n * b\n*/\n// c\n#include <x>\nint a; // stays\n", "c") == "#include <x>\nint a; // stays\n"
    assert without_comments("# a\nx = 1  # b\n--y\n", "python") == "x = 1  # b\n--y\n"
    assert without_comments("-- a\nselect 1;\n", "SQL") == "select 1;\n" and without_comments("/* open\nint a;", "c") == "/* open\nint a;"
    key = 'K = `-----BEGIN PUBLIC KEY-----\n' + "QWERTYUIOPASDFGHJKLZXCVBNM1234567890\n" * 40 + "-----END PUBLIC KEY-----`\n"
    assert measure([key], ["go"])[0]["literal_share"][0] == 0.0


def test_head_of_a_library_behind_a_banner():
    head = "relay.js v1.2.3 - released under the MIT licence"
    for banner in ("// " + "=" * 900 + "\n// ", "/*\n" + " * bundled with care\n" * 60 + " * ", "#!/bin/sh\n" + "# a\n" * 300 + "# ", '"""' + "x y\n" * 300, "<?php\n/* " + "-" * 900 + " */\n// "):
        assert foreign_head(banner + head + ' */ """\n'), banner[:9]
    assert foreign_head("a = 1\n// " + head) and not foreign_head("a = 1\n" * 200 + "// " + head) and not foreign_head("")

"""Credentials and abusive content."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltline.llm import abuse
from siltline.llm import credentials as C
from siltline.llm.parsing import judge

RNG = random.Random(4)


def word(n, letters="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"):
    return "".join(RNG.choice(letters) for _ in range(n))


TOKEN = "gh" + "p_" + word(36)
PASSWORD = "river-" + "Stone42!"
BLOCK = "-----BEGIN RSA PRIVATE" + " KEY-----\n" + "\n".join(word(64) for _ in range(6)) + "\n-----END RSA PRIVATE" + " KEY-----"

FOUND = [
    (f'token = "{TOKEN}"', 1), (f"x\nexport DB_PASSWORD='{PASSWORD}'\n", 2), (f"db.url=postgres://u:{PASSWORD.replace('!', '')}@h.invalid/x", 1), (f"a: 1\npassword: {PASSWORD}\n", 2), (f'h = {{"Authorization": "Bearer {word(40)}"}}', 1),
    (f'c = "Server=a;User Id=b;Password={PASSWORD};X=1"', 1), (f"k = '''{BLOCK}'''", 1), (f'<entry key="api_key">{word(32)}</entry>', 1), (f'SECRET_KEY = "{TOKEN[:20]}" + "{TOKEN[20:]}"', 1), (f"# was SMTP_PASSWORD={PASSWORD}", 1), (f"ENV API_KEY={word(32)}", 1), (f"ARG DB_PASS {PASSWORD}", 1), (f'if headers.get("X-api_key") == "{word(30)}":', 1), (f"curl -s -H 'X-client_secret: {PASSWORD}' https://a.invalid/run", 1), (f"run --user svc --secret-access-key='{word(40)}'", 1), (f"ENV DB_PWD2={PASSWORD}", 1), (f"API_KEY -> {word(30)}", 1), ("admin.pass=Stone=9" + "942-", 1), (f"# old one: a.pass={PASSWORD}", 1),
]
CLEAN = [
    'password = "changeme"', "password = os.environ['DB_PASSWORD']", 'api_key = "${API_KEY}"', 'secret: "{{ vault.secret }}"', "commit = 'a97059900f0ee7bd3b1632a97d6e0c7a572e3aec'", "etag: c80cbcac65817dac5919a9d7b47dde7a", 'password_hint = "ask the duty desk 12"',
    "-----BEGIN PUBLIC KEY-----\n" + word(64) + "\n-----END PUBLIC KEY-----", 'token_url = "https://a.invalid/oauth2/token"', "key = 'AKIA" + "ABCDEFGHEXAMPLE1'", 'min_password_length = "12"', "x = 'plain words 123'", 'const a = require("./b2");', "pass", "", 'password = "****************"', "secret = 'vault:kv/a/b1'",
]


@pytest.fixture(scope="module")
def model():
    rows = []
    for text, _ in FOUND:
        for _ in range(12):
            rows += [(c.kind, c.value + word(RNG.randrange(3)), c.context, "src/a.py") for c in C.candidates(text)]
    for text in CLEAN:
        for _ in range(12):
            rows += [(c.kind, c.value, c.context, "src/a.py") for c in C.candidates(text)]
    sample = pd.DataFrame(rows, columns=["kind", "value", "context", "path"])
    sample["label"] = [C.weak_label(k, v, x) for k, v, x in zip(sample["kind"], sample["value"], sample["context"])]
    return C.fit(sample[sample["label"].notna()].sample(frac=1, random_state=1).reset_index(drop=True))


def lines(model, text, path="src/b.py"):
    return [c.line for c in C.candidates(text) if model.probability(c.kind, c.value, c.context, path) >= C.THRESHOLD]


@pytest.mark.parametrize("text, line", FOUND)
def test_found(model, text, line):
    assert lines(model, text) == [line]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(model, text):
    assert lines(model, text) == []


def test_values_of_letters_only(model):
    for text in ('ENV LDAP_BIND_PW=bXga' + 'AWYiHpfFu', 'db_password: "caGn' + 'FnXPXjicMnye"', "api_secret=tkSgLB" + "HSRznnUCUOxJEs", '<entry key="password">LQxN' + 'ULQGCDbNqk</entry>', "curl -H 'X-api-token: iwDL" + "eWChQTDzaQ' https://a.invalid"):
        assert lines(model, text) == [1], text
    assert C.candidates('order = "jagged"') and lines(model, 'order = "jagged"') == []
    for name in ("passphrase", "newPassword", "Password", "derive_secret", "configuredApiKey"):
        assert C.weak_label("bare", name, "password = ") == 0.0


def test_blocks_end_at_their_own_end(model):
    rows = [word(64) for _ in range(4)]
    cut = "-----BEGIN CERTIFICATE-----\n" + "\n".join(rows)
    assert lines(model, f'if "-----BEGIN CERTIFICATE-----" in text:\n    token = "{TOKEN}"\n') == [2]
    assert lines(model, f'{cut}\n{rows[0][:20]}\ntoken = "{TOKEN}"\n') == [7]
    assert lines(model, f"{cut}\n{BLOCK}\n") == [6]
    assert lines(model, f"-----BEGIN PUBLIC KEY-----\n{rows[0]}\n{BLOCK}\npassword: {PASSWORD}\n") == [3, 11]
    whole = BLOCK.split("\n")
    head, body, foot = whole[0], whole[1:-1], whole[-1]
    for text in (BLOCK, "\n".join("  " + x for x in whole), BLOCK.replace("\n", "\r\n"), "K=" + BLOCK.replace("\n", "\\n"), "k = " + " +\n  ".join(f'"{x}\\n"' for x in whole), "K=" + " ".join(whole), "\n".join("# " + x for x in whole), "\n".join([head, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A", "", *body, foot])):
        (c,) = (c for c in C.candidates(text) if c.kind == "block")
        assert text.startswith(foot, c.end), text
        assert lines(model, text) == [1], text
    assert [c.kind for c in C.candidates("\n".join([head, *body]) + f'\ntoken = "{TOKEN}"')] == ["block", "known"]
    assert [(c.kind, c.line) for c in C._redacted_rows(BLOCK, cut + "\n" + BLOCK, C.candidates(BLOCK))] == [("block", 6)]


def test_long_values_and_any_character_inside_quotes(model):
    long = word(5001)
    for text, value in ((f"client-key-data: {long}", long), (f'api_key = "{long}"', long), (f"<entry key='api_key'>{long}</entry>", long), (f"curl -H 'X-api-token: {long}' https://a.invalid", long), (f"curl -u bot:{long} https://a.invalid", long), (f'api_key = "{TOKEN}" + "{long}"', TOKEN + long)):
        assert [c.value for c in C.candidates(text)] == [value], text[:40]
    for value in ("p@ss <w0" + "rd7", 'st\\"one9' + "42-x", "r1ver>St" + "one42!", "it's R1v" + "er-42"):
        text = f'a = 1\npassword = "{value}"\nb = 2'
        assert [(c.line, c.value) for c in C.candidates(text)] == [(2, value)], text
    assert " + t1 + " not in [c.value for c in C.candidates('u = "token=" + t1 + "&x=1"')]
    assert model.markov.score("a1" * 200 + "zq" * 4000) != model.markov.score("a1" * 200)
    changes = lambda v: C.features(model.markov, "quoted", v, "", "")[0][6]
    assert changes("aB1-" * 1000) > 0.99


def test_redaction_keeps_the_rest():
    for name, text in (("python", f'a = "{TOKEN}"\nb = """{BLOCK}"""\n'), ("json", '{"token": "' + TOKEN + '"}'), ("yaml", f"password: {PASSWORD}\nb: 1\n"), ("java", 'class A { String k = "' + BLOCK.replace("\n", '\\n" +\n "') + '"; }')):
        spans = [(c.start, c.end) for c in C.candidates(text)]
        out = C.blot(text, spans)
        assert judge(name, text.encode())[0] and judge(name, out.encode())[0], out
        assert len(out) == len(text) and out.count("\n") == text.count("\n")
        assert TOKEN not in out and PASSWORD not in out and BLOCK.split("\n")[1] not in out


def test_readable_share():
    line = f'k = "{TOKEN}"'
    start, end = 5, 5 + len(TOKEN)
    assert C.readable_share(TOKEN, line, start, end, line) == 1.0
    assert C.readable_share(TOKEN, line, start, end, f'k = "{TOKEN[:4]}{"*" * 32}{TOKEN[-4:]}"') == pytest.approx(0.2)
    assert C.readable_share(TOKEN, line, start, end, 'k = "[hidden]"') < 0.2


FILES = "file_id long, rel_path string, is_binary boolean, content binary"
FINDINGS = "finding_id long, file string, evidence string, redacted_evidence string"


def test_tables(spark):
    files = [(i, "a.py", False, t.encode()) for i, (t, _) in enumerate(FOUND)] * 2 + [(100 + i, "b.py", False, t.encode()) for i, t in enumerate(CLEAN)]
    files += [(200, None, None, b""), (201, "c", True, f"t = '{TOKEN}'".encode()), (202, "d", False, None), (None, "e.py", False, f"t = '{TOKEN}'".encode()), (203, "f.py", False, (f"x = 1\n" * 50_000 + f"token = '{TOKEN}'\n").encode())]
    bad, good = f'k\ntoken = "{TOKEN}"', f'k\ntoken = "{TOKEN[:4]}{"*" * 32}{TOKEN[-4:]}"'
    findings = [(1, "a", bad, bad), (2, "a", bad, good), (3, None, bad, None), (4, "a", None, bad), (5, "a", None, None), (6, "a", "", "")]
    f = spark.createDataFrame(files, FILES).withColumns({c: F.lit(1) for c in ("place", "line_no", "label", "value")})
    g = spark.createDataFrame(findings, FINDINGS).withColumns({c: F.lit(1) for c in ("place", "row_id", "start")})
    got = {tuple(r) for r in C.found_credentials(f, g).collect()}
    want = {("content", i, line) for i, (_, line) in enumerate(FOUND)} | {("content", None, 1), ("content", 203, 50_001), ("evidence", 1, 2), ("evidence", 2, 2), ("evidence", 3, 2), ("redacted_evidence", 1, 2), ("redacted_evidence", 4, 2)}
    assert got == want
    out = {(r["place"], r["row_id"]): r["redacted"] for r in C.redact_texts(f, g).collect()}
    assert TOKEN not in out["evidence", 1] and out["evidence", 1].startswith("k\ntoken = ")
    empty = C.found_credentials(spark.createDataFrame([], FILES), spark.createDataFrame([], FINDINGS))
    assert empty.count() == 0


# -- abuse ---------------------------------------------------------------------------------------------------------------

RUDE = ["You are a worthless idiot.", "I will find you and hurt you, loser.", "Go back to where you came from, vermin.", "Nobody wants you here, moron."]
CALM = ["The build is green again.", "Please rebase the branch.", "The process kills its child and exits.", "See the notes of last week.", "This stupid test fails again.", "Thanks for the review."]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, votes = [], []
    for i in range(n):
        rude = rng.random() < 0.4
        parts = [rng.choice(CALM) for _ in range(rng.randrange(1, 8))] + ([rng.choice(RUDE)] if rude else [])
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
        for name in ("a", "b"):
            votes.append((i, name, int(rude) if rng.random() < 0.9 else 1 - int(rude)))
    return rows, votes


def test_learns_sentences_from_document_labels():
    rows, votes = corpus(300, 1)
    model = abuse.fit(pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(votes, columns=["doc_id", "annotator", "y"]))
    p = lambda s: model.sentences([s])[0]
    assert min(map(p, RUDE)) > 0.5 and max(map(p, CALM)) < 0.2
    held, _ = corpus(200, 2)
    right = sum((abuse.noisy_or([p(s) for s in abuse.sentences(t)]) >= 0.5) == any(r in t for r in RUDE) for _, t in held)
    assert right >= 195


def test_disguises_are_undone():
    assert abuse.normal("ID​IOT") == "idiot" and abuse.normal("i d i o t!") == "idiot!" and abuse.normal("idiooooot") == "idiot"
    assert abuse.sentences("> a b. c d!\n\n- e") == ["a b.", "c d!", "e"]
    assert abuse.noisy_or([]) == 0.0 and abuse.noisy_or([0.5, 0.5]) == 0.75


def test_abuse_tables(spark):
    rows, votes = corpus(120, 3)
    docs = [(i, "s", t) for i, t in rows] + [(900, "s", None), (901, None, ""), (902, "s", " \n "), (903, "s", "ok. " * 40_000 + RUDE[0]), (0, "s", rows[0][1]), (None, "s", RUDE[1])]
    labels = [(i, a, "Abusive " if y else "ok") for i, a, y in votes] + [(900, "a", None), (None, None, "ok"), (5, "a", "unsure"), (12345, "a", "abusive")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("score", "sentence", "y")})
    l = spark.createDataFrame(labels, "doc_id long, annotator string, label string").withColumn("y", F.lit(1))
    scored = abuse.score_documents(d, l)
    by = {r["doc_id"]: r for r in scored.collect()}
    assert by[900]["score"] == by[901]["score"] == by[902]["score"] == 0.0 and by[900]["sentence"] is None
    assert by[903]["score"] > 0.5 and by[903]["sentence"] == RUDE[0]
    found = {r["doc_id"] for r in abuse.found_abuse(d, l).collect()}
    assert len(found ^ ({i for i, t in rows if any(x in t for x in RUDE)} | {903, None})) <= 4
    rates = {r["source"]: r for r in abuse.abuse_rates(scored).collect()}
    assert rates["s"]["documents"] == 125 and rates[None]["abusive"] == 0


def test_abuse_without_documents_or_labels(spark):
    d = spark.createDataFrame([(1, "s", "You worthless idiot, I hope you die."), (2, "s", "All is well.")], "doc_id long, source string, text string")
    none = spark.createDataFrame([], "doc_id long, annotator string, label string")
    assert abuse.score_documents(d, none).count() == 2
    assert abuse.score_documents(spark.createDataFrame([], d.schema), none).count() == 0


# -- samples, deliveries, ablations --------------------------------------------------------------------------------------


def test_hash_shares_never_round_to_nothing(spark):
    from siltline.session import hash_below

    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    for share in (0.0005, 0.01, 0.5):
        assert abs(rows.where(hash_below(F.col("h"), share)).count() / 20_000 - share) < 0.25 * share + 0.001
    assert rows.where(hash_below(F.col("h"), 1.5)).count() == 20_000
    # nine thousand million documents and a sample of 6 000: a share far below a millionth still keeps a part of the range
    low = hash_below(F.lit(-(2**63) + 10**12), 1.5 * 6_000 / 9e9)
    assert spark.range(1).where(low).count() == 1 and spark.range(1).where(hash_below(F.lit(0), 1e-6)).count() == 0


def test_redaction_goes_by_delivery(spark):
    one, other = f"x = 1\ntoken = '{TOKEN}'\n".encode(), f"# a line more\nx = 1\ntoken = '{TOKEN}'\n# é\n".encode() + b"\xff"
    files = spark.createDataFrame([(1, "a.py", False, one), (1, "a.py", False, other), (1, "a.py", False, one)], FILES)
    out = sorted(r["redacted"] for r in C.redact_texts(files, spark.createDataFrame([], FINDINGS)).collect())
    assert len(out) == 2 and all(TOKEN not in t and "token = '" in t and t.count("X") >= 30 for t in out)
    assert out[0].startswith("# a line more\nx = 1\ntoken = 'X") and out[1].startswith("x = 1\ntoken = 'X") and out[0].endswith("# é\n�")


def test_blanks_do_not_hide_references():
    assert C.weak_label("quoted", "{{ secrets.db_password }}", "password: ") == 0.0
    assert C.weak_label("quoted", "$(vault_read db_password)", "export DB_PASSWORD=") == 0.0
    assert C.weak_label("quoted", "two words 12345678x", "password = ") in (None, 0.0)


def test_credentials_without_the_label_rules():
    """Held out: what the Markov chain, notation and words say without the tests that gave the labels."""
    rows = []
    for i in range(300):
        rows.append(("quoted", word(24), f"{RNG.choice(['api_key', 'auth_token', 'client_secret'])} = ", "src/a.py", 1.0))
        rows.append(("quoted", "-".join(RNG.choice(["relay", "ivory", "quota", "panel", "stream"]) for _ in range(4)), f"{RNG.choice(['label', 'name', 'title'])} = ", "src/a.py", 0.0))
    sample = pd.DataFrame(rows, columns=["kind", "value", "context", "path", "label"])
    for rules in (True, False):
        model = C.fit(sample.iloc[:400], rules)
        right = sum((model.probability(*r[:4]) >= 0.5) == (r[4] > 0) for r in rows[400:])
        assert right >= 196, rules
        assert (model.dense[C._LABELLING] == 0).all() == (not rules)


def test_abuse_learns_without_word_lists():
    rows, votes = corpus(400, 5)
    texts, opinions = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(votes, columns=["doc_id", "annotator", "y"])
    model = abuse.fit(texts, opinions, lexicon=False)
    assert not model.weights[abuse._LISTED.ravel()].any()
    held, _ = corpus(200, 6)
    score = lambda t: abuse.noisy_or(model.sentences(abuse.sentences(t)))
    assert sum((score(t) >= 0.5) == any(r in t for r in RUDE) for _, t in held) >= 195


def test_features_do_not_depend_on_the_batch():
    parts = ["You are a worthless idiot.", "See a/b.py and f(x) 12", "i d i o t !", "お前は死ね", "*** p*ss off", "a", "你好 世界", "plain words here", "x" * 90]
    known = abuse.Pieces()
    columns, owner = abuse.sentence_features(parts * 3, known)
    for i, part in enumerate(parts):
        alone, _ = abuse.sentence_features([part])
        for k in range(3):
            assert (columns[owner == i + k * len(parts)] == alone).all()
    assert len(abuse.sentence_features([])[0]) == len(abuse.sentence_features(["123 456"])[1]) == 0
    model = abuse.Model(abuse._starting_weights(True).astype("float32"), -5.0)
    assert list(model.sentences(parts)) == [model.sentences([p])[0] for p in parts]

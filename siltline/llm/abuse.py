"""Abusive, hateful or sexual content: multiple-instance learning over sentences.

A document is a bag of sentences. Each sentence has a probability from a linear model over hashed word and character
n-grams and a lexicon; the document's is one minus the product of their complements (noisy-or). The model is fitted to
document labels only, so the sentences that make a document abusive are found along the way.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.session import hash_below

#: Labelled documents the model is fitted on; the bound of the driver's work.
SAMPLE_DOCUMENTS = 6_000
#: Unlabelled documents that show what ordinary sentences look like; as many at most.
BACKGROUND_DOCUMENTS = 6_000
#: The share of abusive documents that an unlabelled document is taken to have before the model has seen it.
BASE_RATE = 0.05
#: Features of fewer documents of the sample are left out.
LEAST_DOCUMENTS = 4
#: A sentence's weights are divided by the root of its number of features, but never of fewer than these.
LEAST_FEATURES = 16.0
#: Width of the hashed features.
WIDTH = 1 << 17
#: Document probability from which a document counts.
THRESHOLD = 0.4

# Stems of insults, threats, slurs of groups and sexual words, by language, as weak prior knowledge.
_INSULTS = {
    "en": "idiot moron imbecile stupid dumbass scumbag loser parasite worthless pathetic disgust garbage trash asshole bastard bitch whore slut cunt retard vermin filth subhuman scum pig clown freak fucking fuck shit ass",
    "de": "idiot penner arschloch trottel drecksau hurensohn wichser schlampe abschaum dumm widerlich faul versager verpiss fotze missgeburt",
    "fr": "connard connasse salope putain abruti crétin débile imbécile ordure raclure enculé pute bâtard crève",
    "es": "inútil idiota imbécil cabrón puta mierda estúpido gilipollas asqueroso basura mueras zorra maricón",
    "pt": "idiota imbecil burro merda puta vagabunda nojento inútil lixo desgraçado cabrão morra otário",
    "ja": "死ね 馬鹿 バカ クズ 殺す キモい ブス 消えろ 変態 ゴミ",
    "ar": "غبي حقير كلب حمار قذر عاهرة سأقتلك تموت أحمق",
}
_THREATS = "kill die burn cancer rot wheelchair suffocate beat stab hang shoot hurt regret family house grave"
_SEXUAL = "sluts naked nude horny sex porn cock dick pussy boobs tits cum girls fuck undress blowjob"

_SPLIT = re.compile(r"[.!?…](?=[\s\"')\]])[\s\"')\]]+|[。！？][\s\"')\]]*|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’*@$!01345]+[^\W\d_]+)*[*]*|\*+")
_CODE = re.compile(r"[\w.]+\([^)\s]*\)|\b[\w-]+(?:/[\w.-]+)+|\b\w+\.\w{1,5}\b|https?://\S+|\b\w*\d\w*\b")
_CODE_SIGNS = re.compile(r"[\d./(]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯؀-ۿ]")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_HIDDEN = re.compile(r"[​-‏⁠﻿­]")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]{1,5}\b")
_LEETED = re.compile(r"(?<![\w/.])(?=[a-z]*+[013457@$])(?=[\w@$]*[a-z])[a-z013457@$]{4,}(?![\w/.(])")
_LEET_SIGNS, _SPELLING_SIGNS = frozenset("013457@$"), frozenset(".-_*")
_REPEATED = re.compile(r"(\w)\1{2,}")
_MASKED = re.compile(r"\b\w+\*+\w*|\b\w\*+\w+")
#: Words of an instance; longer sentences (often several without marks between them) are cut into windows that overlap by half.
WINDOW = 14
#: Characters of a word; longer runs are instances of their own, in windows of that length that overlap by half.
LONG_WORD = 100
#: Sentences whose features are made at a time, which bounds memory, and pieces that a worker remembers before it starts anew.
_ROUND, _REMEMBERED = 30_000, 300_000


def folded(text: str) -> str:
    """Case, width and hidden characters made alike, words spelled out with blanks put together."""
    text = text.lower() if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()
    if sum(len(w) == 1 for w in text.split()) >= 3:
        text = _SPACED.sub(_joined, text)
    return text


def _joined(spelled: re.Match) -> str:
    return re.sub(r"[ .\-_*]", "", spelled[0])


def undisguised(text: str) -> str:
    """Words spelled out with signs put together, letters for the digits and signs that stand for them; runs of a letter are one."""
    if not text.isalpha():
        if not _SPELLING_SIGNS.isdisjoint(text):
            text = _SPACED.sub(_joined, text)
        if not _LEET_SIGNS.isdisjoint(text):
            text = _LEETED.sub(lambda m: m[0].translate(_LEET), text)
    return _REPEATED.sub(r"\1", text)


def normal(text: str) -> str:
    return undisguised(folded(text))


def sentences(text: str) -> list[str]:
    """Pieces that end at a sentence mark or line end, long ones in windows; marks of quoting and list stay off; blank ones are left out."""
    out, pieces, at = [], [], 0
    for m in _SPLIT.finditer(text):
        pieces.append(text[at : m.start() + (text[m.start()] != "\n")])
        at = m.end()
    pieces.append(text[at:])
    for piece in pieces:
        piece = piece.strip(" \t>*-#|")
        if not piece or piece.isspace():
            continue
        if len(piece) <= LONG_WORD and piece.count(" ") < WINDOW:
            out.append(piece)
            continue
        words = piece.split()
        if len(piece) > LONG_WORD and max(map(len, words), default=0) > LONG_WORD:  # writing without blanks, or a long run
            out += [w[i : i + LONG_WORD] for w in words if len(w) > LONG_WORD for i in range(0, len(w) - LONG_WORD // 2, LONG_WORD // 2)]
            words = [w for w in words if len(w) <= LONG_WORD]
            piece = " ".join(words)
            if not piece:
                continue
        if len(words) <= WINDOW + WINDOW // 2:
            out.append(piece)
        else:
            out += [" ".join(words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
    return out


def _lexicon() -> list[tuple[str, ...]]:
    return [tuple(" ".join(_INSULTS.values()).split()), tuple(_THREATS.split()), tuple(_SEXUAL.split())]


_STEMS = {stem: i for i, stems in enumerate(_lexicon()) for stem in stems}
_LONGEST = max(map(len, _STEMS))
_FOREIGN_STEMS = [(s, i) for s, i in _STEMS.items() if not s.isascii()]
_SECOND = frozenset("you your you're u ur dich du dir dein deine euch tu toi te ton ta vous votre tú te usted tus eres você vocês seu sua te ti お前 あなた أنت".split())
_GROUPS = frozenset("women men immigrants foreigners muslims jews christians believers blacks gays lesbians religion accent people them they gypsies asians whites disabled frauen ausländer immigrés étrangers femmes inmigrantes mujeres extranjeros mulheres estrangeiros".split())
#: What the word lists say of a piece, as bits: a stem of each list, address in the second person, a group.
_SECOND_BIT, _GROUP_BIT = 8, 16


def _column(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram) >> (64 - 17)


_LISTED = np.array([[_column(f"{sign}{i}") for sign in "LYG"] for i in range(3)], np.int32)
_SECOND_COLUMN, _GROUP_COLUMN = _column("Y"), _column("G")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _hashed(h: np.ndarray) -> np.ndarray:
    """Columns of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return ((h ^ (h >> np.uint64(29))) * _ODD[4] >> np.uint64(64 - 17)).astype(np.int32)


class Pieces:
    """What a worker knows of the pieces between blanks that it has met: hashes of their words, columns of their own, bits of the word lists."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.columns = array("Q"), array("i")
        self.word_ends, self.column_ends, self.bits = array("q", [0]), array("q", [0]), array("B")

    def add(self, piece: str) -> None:
        text = undisguised(piece)
        if text.isalpha():
            plain, words = text, [text]
        else:
            plain = _CODE.sub(" ", text) if _CODE_SIGNS.search(text) else text
            words = [w.translate(_LEET) for w in _WORD.findall(plain)]
        grams: list[str] = []
        bits = 0
        for w in words:
            if len(w) > 4:
                grams += (f"p{w[:4]}", f"x{w[:5]}", f"e{w[-4:]}")
            if not w.isascii() and _WIDE.search(w):
                grams += [f"c{w[i : i + 2]}" for i in range(len(w) - 1)] + [f"d{w[i : i + 3]}" for i in range(len(w) - 2)]
            for k in range(min(len(w), _LONGEST), 0, -1):
                i = _STEMS.get(w[:k])
                if i is not None and (k > 3 or k == len(w)):
                    bits |= 1 << i
            bits |= _SECOND_BIT * (w in _SECOND) | _GROUP_BIT * (w in _GROUPS)
        if "*" in plain:  # a letter behind a star may be any
            masked = _MASKED.findall(plain)
            hidden = [re.compile(re.escape(w).replace(r"\*", ".") + "$") for w in masked if len(w) > 3]
            for s, i in _STEMS.items():
                bits |= (1 << i) * any(p.match(s) for p in hidden)
            inside = [w for w in masked if not w.endswith("*")]
            grams += [f"m{w[0]}{len(w)}{w[-1]}" for w in inside] + ["masked"] * bool(inside)
        if not text.isascii() and _WIDE.search(text):
            for s, i in _FOREIGN_STEMS:
                bits |= (1 << i) * (s in text)
        self.number[piece] = len(self.number)
        self.words.extend(map(xxhash.xxh64_intdigest, words))
        self.columns.extend(map(_column, grams))
        self.word_ends.append(len(self.words))
        self.column_ends.append(len(self.columns))
        self.bits.append(bits)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self.number) > _REMEMBERED:
            self.__init__()
        for piece in set(pieces).difference(self.number):
            self.add(piece)
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))


def _spread(ends: np.ndarray, values: np.ndarray, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, one after the other, and the owners of the rows."""
    sizes = ends[rows + 1] - ends[rows]
    offsets = np.repeat(ends[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    return values[offsets + np.arange(len(offsets))], np.repeat(owner, sizes)


def _distinct(values: np.ndarray) -> np.ndarray:
    """In ascending order; sorting beats hashing for so many."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def sentence_features(parts: list[str], known: Pieces | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, sentence of each), ascending and without repeats, of many sentences in one vectorised step.

    Features are words, their pairs, triples and pairs over a gap, beginnings and ends of words, parts of words in
    writing without blanks, and what the word lists say together with an address or a group.
    """
    known = known or Pieces()
    lists = [folded(part).split() for part in parts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    rows = known.numbers([x for line in lists for x in line])
    owner = np.repeat(np.arange(len(lists)), sizes)
    if not len(rows):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h, at = _spread(np.frombuffer(known.word_ends, np.int64), np.frombuffer(known.words, np.uint64) if known.words else np.zeros(0, np.uint64), rows, owner)
    own, held = _spread(np.frombuffer(known.column_ends, np.int64), np.frombuffer(known.columns, np.int32) if known.columns else np.zeros(0, np.int32), rows, owner)
    columns, owners = [own, _hashed(h)], [held, at]
    for gap, salt in ((1, 0), (2, 1)):
        pair = at[gap:] == at[:-gap]
        first, last = h[:-gap][pair], h[gap:][pair]
        columns.append(_hashed(first * _ODD[salt] + last))
        owners.append(at[gap:][pair])
        if gap == 2:
            columns.append(_hashed((first * _ODD[2] + h[1:-1][pair]) * _ODD[0] + last))
            owners.append(at[gap:][pair])
    filled = np.flatnonzero(sizes)
    bits = np.bitwise_or.reduceat(np.frombuffer(known.bits, np.uint8)[rows], np.r_[0, np.cumsum(sizes)[:-1]][filled])
    second, group = bits & _SECOND_BIT > 0, bits & _GROUP_BIT > 0
    for i in range(3):
        listed = bits & (1 << i) > 0
        for column, chosen in zip(_LISTED[i], (listed, listed & second, listed & group)):
            owners.append(filled[chosen])
            columns.append(np.full(len(owners[-1]), column, np.int32))
    for column, chosen in ((_SECOND_COLUMN, second), (_GROUP_COLUMN, group)):
        owners.append(filled[chosen])
        columns.append(np.full(len(owners[-1]), column, np.int32))
    both = _distinct(np.concatenate(owners) * WIDTH + np.concatenate(columns))
    return (both % WIDTH).astype(np.int32), both // WIDTH


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, parts: list[str], known: Pieces | None = None) -> np.ndarray:
        """The probability of each sentence."""
        out = np.zeros(len(parts))
        for begin in range(0, len(parts), _ROUND):
            some = parts[begin : begin + _ROUND]
            columns, owner = sentence_features(some, known)
            sums, sizes = np.zeros(len(some)), np.bincount(owner, minlength=len(some))
            if len(columns):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[owner[starts]] = np.add.reduceat(self.weights[columns], starts, dtype=np.float64)
            z = self.bias + sums / np.sqrt(np.maximum(LEAST_FEATURES, sizes))
            out[begin : begin + _ROUND] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def noisy_or(p: np.ndarray | list[float]) -> float:
    return float(1 - np.prod(1 - np.asarray(p, float))) if len(p) else 0.0


def _annotator_targets(votes: pd.DataFrame, prior: dict[int, float]) -> dict[int, float]:
    """The chance that a document is abusive, from the votes, each annotator's error rates and a prior by document."""
    p = votes["doc_id"].map(prior).to_numpy(float)
    votes = votes.assign(_p=p)
    rates = {}
    for name, part in votes.groupby("annotator", dropna=False):
        y, q = part["y"].to_numpy(float), part["_p"].to_numpy(float)
        hit = (q @ y + 4) / (q.sum() + 5)
        alarm = ((1 - q) @ y + 0.5) / ((1 - q).sum() + 5)
        rates[name] = (min(max(hit, 0.55), 0.99), min(max(alarm, 0.01), 0.45))
    logit = {d: np.log(max(q, 1e-3) / max(1 - q, 1e-3)) for d, q in prior.items()}
    for d, name, y in zip(votes["doc_id"], votes["annotator"], votes["y"]):
        hit, alarm = rates[name]
        logit[d] += np.log(hit / alarm) if y else np.log((1 - hit) / (1 - alarm))
    return {d: float(1 / (1 + np.exp(-np.clip(z, -8, 8)))) for d, z in logit.items()}


def _fit_bags(columns: np.ndarray, owner: np.ndarray, scale: np.ndarray, bag: np.ndarray, part: np.ndarray, target: np.ndarray, importance: np.ndarray, start: np.ndarray, steps: int, decay: float, model: Model | None = None) -> Model:
    """columns with their sentence, (bag, part): which bag holds which sentence, bags with their target: noisy-or cross-entropy by Adam, from an earlier model on if there is one."""
    n = len(scale)
    sentence, begin = np.unique(owner, return_index=True)  # owner ascends
    by_column = np.argsort(columns, kind="stable")
    used, first = np.unique(columns[by_column], return_index=True)
    holder = owner[by_column]
    place = np.searchsorted(used, columns).astype(np.int32)
    holder, scale = holder.astype(np.int32), scale.astype(np.float32)
    weights, bias = (model.weights[used].astype(np.float64), model.bias) if model else (start[used], -5.0)
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.full(n, bias)
        z[sentence] += np.add.reduceat(weights.astype(np.float32)[place], begin) * scale[sentence] if len(columns) else 0.0
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-7, 1 - 1e-7)
        none = np.exp(np.bincount(bag, weights=np.log1p(-p)[part], minlength=len(target)))
        whole = np.clip(1 - none, 1e-6, 1 - 1e-6)
        # d loss / d z = p * (1 - target / whole)
        slope = p * np.bincount(part, weights=((1 - target / whole) * importance)[bag], minlength=n) / len(target)
        g = (np.add.reduceat((slope * scale).astype(np.float32)[holder], first) if len(columns) else np.zeros(0)) + decay / len(target) * (weights - start[used])
        gb = slope.sum()
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g**2
        rate = 0.3
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-7)
        bias = min(bias, -4.0)
    every = start.copy()
    every[used] = weights
    return Model(every.astype(np.float32), float(bias))


def _starting_weights(lexicon: bool) -> np.ndarray:
    start = np.zeros(WIDTH)
    for gram, value in (("L0", 2.0), ("Y0", 6.0), ("G0", 6.0), ("L1", 1.0), ("Y1", 3.0), ("L2", 3.0)) if lexicon else ():
        start[_column(gram)] = value
    return start


def fit(texts: pd.DataFrame, votes: pd.DataFrame, background: pd.DataFrame | None = None, rounds: int = 3, steps: int = 50, decay: float = 0.06, lexicon: bool = True) -> Model:
    """texts and background: doc_id, text; votes: doc_id, annotator, y (0 or 1). Without votes the lexicon's prior is all that is known.

    The first round trusts votes and takes background documents for ordinary; later rounds weigh the votes by each
    annotator's error rates and take the model's own view of the background. Without the lexicon its features are
    left out, so that only document labels teach.
    """
    start = _starting_weights(lexicon)
    texts = texts[texts["doc_id"].isin(votes["doc_id"])]
    labelled = len(texts)
    rows = pd.concat([texts, background[~background["doc_id"].isin(votes["doc_id"])]] if background is not None else [texts], ignore_index=True)
    number: dict[str, int] = {}
    held = [[number.setdefault(s, len(number)) for s in sentences(t)] for t in rows["text"]]
    if not number:
        return Model(start.astype(np.float32), -5.0)
    bag = np.repeat(np.arange(len(held)), [len(x) for x in held])
    part = np.fromiter((i for x in held for i in x), np.int64, len(bag))
    columns, owner = sentence_features(list(number))
    sizes = np.bincount(owner, minlength=len(number))
    if not lexicon:
        own = ~np.isin(columns, [*_LISTED.ravel(), _SECOND_COLUMN, _GROUP_COLUMN])
        columns, owner = columns[own], owner[own]
    # what fewer than LEAST_DOCUMENTS documents have says nothing; it keeps its starting weight
    pairs = _distinct(bag * len(number) + part)
    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(number)))]
    spread, holder = _spread(ends, columns, pairs % len(number), pairs // len(number))
    seen_in = np.bincount(_distinct(spread.astype(np.int64) * len(held) + holder) // len(held), minlength=WIDTH)
    often = seen_in[columns] >= LEAST_DOCUMENTS
    columns, owner = columns[often], owner[often]
    mean = votes.groupby("doc_id")["y"].mean()
    ids = rows["doc_id"].tolist()
    target = np.full(len(ids), BASE_RATE)
    target[:labelled] = [0.05 + 0.85 * float(mean[d]) for d in ids[:labelled]]
    others = max(1, len(ids) - labelled)
    importance = np.where(np.arange(len(ids)) < labelled, 1.0, min(1.0, 1.0 * labelled / others))
    known = votes[votes["doc_id"].isin(set(ids[:labelled]))]
    scale = 1 / np.sqrt(np.maximum(LEAST_FEATURES, sizes))
    model = None
    for n in range(rounds):
        model = _fit_bags(columns, owner, scale, bag, part, target, importance, start, steps if model is None else steps // 2, decay, model)
        z = model.bias + scale * np.bincount(owner, weights=model.weights[columns], minlength=len(number))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = 1 - np.exp(np.bincount(bag, weights=np.log1p(-np.clip(p, 0, 1 - 1e-7))[part], minlength=len(ids)))
        prior = {d: 0.05 + 0.9 * float(q) for d, q in zip(ids[:labelled], whole)}
        weighed = _annotator_targets(known, prior) if len(known) else {}
        target[:labelled] = [weighed.get(d, q) for d, q in prior.items()] if labelled else []
        seen = whole[labelled:]
        target[labelled:] = np.where(seen > 0.6, 0.95, 0.02)
        importance[labelled:] = np.where((seen > 0.25) & (seen < 0.6), 0.0, min(1.0, 3.0 * (n + 1) * labelled / others))
    if not lexicon:
        model.weights[[*_LISTED.ravel(), _SECOND_COLUMN, _GROUP_COLUMN]] = 0
    return model


# -- tables --------------------------------------------------------------------------------------------------------------


def _latest_texts(documents: DataFrame) -> DataFrame:
    """One text a doc_id: the delivery loaded last where the table says so, else the one with the greatest hash."""
    order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", F.xxhash64("text")) if "loaded_at" in documents.columns else F.xxhash64("text")
    return documents.groupBy("doc_id").agg(F.max_by("text", order).alias("text"))


def _said(labels: DataFrame) -> DataFrame:
    said = F.lower(F.trim("label"))
    return labels.where(said.isin("ok", "abusive") & F.col("doc_id").isNotNull()).select("doc_id", "annotator", (said == "abusive").cast("int").alias("y")).distinct()


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, background: int = BACKGROUND_DOCUMENTS) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(texts, votes, background): the labelled documents and the others with the smallest hashes of their ids, at most so many.

    What goes to the driver is bounded before it is sorted: about half as many again pass a threshold on the whole
    64-bit hash, which no number of documents brings down to nothing.
    """
    votes = _said(labels)
    ids = votes.select("doc_id").distinct()
    labelled = ids.count()
    chosen = ids.where(hash_below(F.xxhash64("doc_id"), 1.5 * sample / max(1, labelled))).orderBy(F.xxhash64("doc_id")).limit(sample)
    if labelled and not chosen.take(1):
        raise ValueError("no labelled document fell into the sample")
    texts = documents.where("text is not null")
    rows = _latest_texts(texts.join(F.broadcast(chosen), "doc_id", "left_semi")).toPandas()  # at most ``sample`` ids
    opinions = votes.join(F.broadcast(chosen), "doc_id", "left_semi").toPandas().sort_values(["doc_id", "annotator", "y"])
    order = F.xxhash64("doc_id", F.lit(1))
    others = texts.where(hash_below(order, 1.5 * background / max(1, documents.count())))
    others = _latest_texts(others).orderBy(order).limit(background).toPandas()
    return rows.sort_values("doc_id").reset_index(drop=True), opinions, others.sort_values("doc_id").reset_index(drop=True)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, background: int = BACKGROUND_DOCUMENTS, lexicon: bool = True) -> Model:
    """Fits on the rows of ``training_rows``; null labels don't vote."""
    return fit(*training_rows(documents, labels, sample, background), lexicon=lexicon)


def score_documents(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, lexicon: bool = True) -> DataFrame:
    """doc_id, source, score, sentence_no and sentence: the noisy-or of all sentences and the likeliest one (null if none).

    Null, empty and blank texts score 0. Deliveries of a doc_id count once each row; other columns are ignored.
    """
    model = train(documents, labels, sample, lexicon=lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pieces()
        for batch in batches:
            number: dict[str, int] = {}
            held = [[number.setdefault(s, len(number)) for s in sentences(t)] if t else [] for t in batch["text"]]
            p = model.sentences(list(number), known)  # each distinct sentence of the batch once
            parts = list(number)
            scores, places, worst = np.zeros(len(held)), [], []
            for i, x in enumerate(held):
                q = p[x]
                best = int(q.argmax()) if x else None
                scores[i] = noisy_or(q)
                places.append(best)
                worst.append(parts[x[best]] if x else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": scores, "sentence_no": pd.array(places, dtype="Int32"), "sentence": pd.Series(worst, dtype=object)})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double, sentence_no int, sentence string")


def found_abuse(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score_documents(documents, labels).where(F.col("score") >= threshold).select("doc_id").distinct()


def abuse_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, those at or above the threshold, their rate and the mean score of each source."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"), F.avg("score").alias("mean_score")
    ).withColumn("rate", F.col("abusive") / F.col("documents"))

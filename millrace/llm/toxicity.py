"""Operator 6: toxicity by a weighted lexicon.

Texts are folded first: lower case, accents off, letters of other scripts that look Latin and digits that stand for
letters replaced. The lexicon's terms are whole words or word beginnings; one Aho-Corasick pass over the folded text
finds them all. A hit inside an exception phrase doesn't count. What is left is summed by the terms' weights, and
normalised by the text's length; a logistic curve turns both into a score.

At a word's beginning or end a digit or sign may stand for a letter or for itself ("1diot", "$tupid", "1st", "|cell|").
Texts with such words are matched in further readings too, with those digits, or digits and signs, as letters; a word
counts once, by its heaviest reading. Numbers without a letter and "!" behind a word are left alone.

The lexicon starts from a short fixed list and learns further terms and all weights (log odds of a term between toxic
and other documents) from labelled documents that are not held out, at most TRAIN_DOCS of each label, dealt by a hash.

Rules: null counts as empty, and a text without a hit gets the curve's value at 0; texts are scored whole; a document
with several labels counts as toxic if one says so; rows are independent; without labels the fixed list has weight 2
each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.sources.tables import shipped

TRAIN_DOCS = 3000
#: Most terms that are learned, and the least number of toxic documents and log odds that a term needs.
MOST_TERMS, LEAST_DOCS, LEAST_ODDS = 2000, 4, 2.0
PREFIXES = range(4, 9)
PREDICT_AT = 0.7
DEFAULT_CURVE = (-2.0, 1.5, 0.0)

#: Words of abuse.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb")
#: Harmless phrases that hold such words.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "not stupid", "no idiot", "sore loser")
#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
MARKS = str.maketrans(LOOKALIKES)
#: A digit or sign with a letter on both sides stands for a letter.
STANDS = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])")
#: Those at a word's beginning and end, digits alone or signs too; a run of them is taken whole.
LEADS = re.compile(r"(?<![^\W_])[0134578]++(?=[^\W\d_])"), re.compile(r"(?<![^\W_])(?<![@$!|])[0134578@$!|]++(?=[^\W\d_])")
TAILS = re.compile(r"(?<=[^\W\d_])[0134578]++(?![^\W_])"), re.compile(r"(?<=[^\W\d_])[0134578@$!|]*[0134578@$|](?![^\W_])")
LETTERS = str.maketrans(DIGITS)
GAP, WORD, LETTER = re.compile(r"[\W_]+"), re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]")


def as_letters(m: re.Match) -> str:
    """The letters that a run of digits and signs stands for."""
    return m.group().translate(LETTERS)


def plain(text: str) -> str:
    """Folded characters."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(MARKS))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return STANDS.sub(as_letters, text)


def spaced(chars: str) -> str:
    """The words of folded characters with one space before, between and after them."""
    return f" {GAP.sub(' ', chars).strip()} "


def fold(text: str) -> str:
    """Folded words with one space before, between and after them."""
    return spaced(plain(text))


def readings(text: str) -> list[str]:
    """Folded characters, first as they are, then with the digits, or digits and signs, at the words' edges as letters; all of one length."""
    first = plain(text)
    begun = dict.fromkeys(lead.sub(as_letters, first) for lead in LEADS)
    return list(dict.fromkeys([first, *(tail.sub(as_letters, b) for b in begun for tail in TAILS)]))


def terms_of(folded: str) -> set[str]:
    """The terms that a folded text has: " word " and the beginnings " wor"."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def in_class(key: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Lexicon:
    """Terms with weights, exception phrases, and the curve's coefficients."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, ...] = DEFAULT_CURVE):
        self.weights, self.curve = weights, curve
        self.find = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.find.add_word(term, (len(term), weight, term))
        self.spare = ahocorasick.Automaton()
        for phrase in EXCEPTIONS:
            self.spare.add_word(f" {phrase} ", len(phrase) + 2)
        self.find.make_automaton()
        self.spare.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.curve)

    def hits(self, folded: str) -> dict[int, float]:
        """Where the words with a hit begin, and the heaviest term's weight; 0 inside an exception phrase."""
        best: dict[int, float] = {}
        if self.weights:
            for end, (size, weight, _) in self.find.iter(folded):
                start = end - size + 1
                if weight > best.get(start, 0.0):
                    best[start] = weight
        spared = [(end - size + 1, end) for end, size in self.spare.iter(folded)] if best else []
        return {at: 0.0 if any(s <= at < e for s, e in spared) else w for at, w in best.items()}

    def features(self, text: str) -> tuple[float, float]:
        """The log of the hits' weights, and their share of the text's words.

        Each word counts once, with the heaviest term that it has in any reading; a word that reads the same is spared
        if one reading of its neighbours makes an exception phrase.
        """
        read = readings(text)
        folded = [spaced(chars) for chars in read]
        found = [self.hits(f) for f in folded]
        if not any(found[1:]):
            total = sum(found[0].values())
        else:
            slots: dict[int, dict[str, float]] = {}
            for chars, hits in zip(read, found, strict=True):
                at = 0
                for m in WORD.finditer(chars) if hits else ():
                    if at in hits:
                        letter = LETTER.search(read[0], *m.span())
                        words = slots.setdefault(letter.start() if letter else m.start(), {})
                        words[m.group()] = min(hits[at], words.get(m.group(), hits[at]))
                    at += len(m.group()) + 1
            total = sum(max(words.values()) for words in slots.values())
        return float(np.log1p(total)), total / (folded[0].count(" ") - 1)

    def score(self, text: str) -> float:
        """0 to 1; a higher score is likelier toxic."""
        a, b, c = self.curve
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-(a + b * x + c * np.sqrt(y)))))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps, with both labels of equal weight and a little shrinkage.

    No slope is negative: a feature that would have one is left out, and a curve without any feature is the default.
    """
    weight = np.where(y > 0, 0.5 * len(y) / max(1.0, y.sum()), 0.5 * len(y) / max(1.0, len(y) - y.sum()))
    columns = np.column_stack([np.ones(len(x)), x])
    used = np.ones(columns.shape[1], bool)
    while used[1:].any():
        z = columns[:, used]
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (weight * (y - p)) - 0.1 * w
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), slope)
            w = w + step / max(1.0, np.abs(step).max())
        full = np.zeros(columns.shape[1])
        full[used] = w
        if (full[1:] >= 0).all():
            return tuple(float(v) for v in full)
        used[1 + int(full[1:].argmin())] = False
    return DEFAULT_CURVE


@shipped
def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Lexicon:
    """Learn terms, weights and the curve from at most about ``train_docs`` documents of each label."""
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_class())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Lexicon({f" {w} ": 2.0 for w in SEED})
    share = F.when(F.col("toxic") > 0, min(1.0, train_docs / counts[1])).otherwise(min(1.0, train_docs / counts[0]))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # a bounded number of rows of two numbers; more than the bound by chance only
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int32())])

    def run(batches):
        for b in common.slices(batches):
            out = [(t, y) for text, y in zip(common.texts_of(b), b.column("toxic").to_pylist(), strict=True) for t in (*set().union(*(terms_of(spaced(r)) for r in readings(text))), "")]
            yield common.to_batch(schema, list(map(list, zip(*out, strict=True))) or [[], []])

    found = rows.mapInArrow(run, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    seed = [f" {w} " for w in SEED]
    found = found.where((F.col("bad") >= LEAST_DOCS) | F.col("term").isin("", *seed))
    totals = found.where("term = ''").first()
    if totals is None or not 0 < totals["bad"] < totals["n"]:
        return Lexicon({f" {w} ": 2.0 for w in SEED})
    odds = F.log(((F.col("bad") + 0.5) / (totals["bad"] + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (totals["n"] - totals["bad"] + 1)))
    kept = found.where("term <> ''").withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) | F.col("term").isin(*seed))
    top = kept.orderBy(F.desc("odds"), F.desc("bad"), "term").limit(MOST_TERMS).collect()
    weights = {w: 1.0 for w in seed} | {r["term"]: max(0.1, float(r["odds"])) for r in top}
    lexicon = Lexicon(weights)
    points = pa.schema([("x", pa.float64()), ("d", pa.float64()), ("toxic", pa.int32())])

    def measure(batches):
        for b in common.slices(batches):
            got = [lexicon.features(t) for t in common.texts_of(b)]
            yield common.to_batch(points, [*map(list, zip(*got, strict=True)), b.column("toxic")])

    seen = rows.mapInArrow(measure, "x double, d double, toxic int").collect()  # the bounded sample
    seen.sort(key=lambda r: (r["x"], r["d"], r["toxic"]))
    x = np.array([(r["x"], np.sqrt(r["d"])) for r in seen])
    y = np.array([r["toxic"] for r in seen], float)
    return Lexicon(weights, fit_curve(x, y))


@shipped
def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in common.slices(batches):
            scores = [lexicon.score(t) for t in common.texts_of(b)]
            yield common.to_batch(schema, [b.column("doc_id"), b.column("held_out"), scores, [int(s >= PREDICT_AT) for s in scores]])

    return docs.select("doc_id", "text", in_class().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

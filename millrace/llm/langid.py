"""Operator 9: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the product of the pieces' probabilities; the forward algorithm adds these up place by
place, in running scale. A text's score in a language is the sum of its words' log probabilities. The probabilities come from expectation
maximisation over all segmentations (forward and backward sums), on a bounded sample of labelled documents: at most
TRAIN_DOCS of each language, dealt by a hash of doc_id.

Rules: a null text, or one without a letter, is ``und`` with score 0; texts are read whole, in lower case; a letter that
no piece has costs the same in all languages; ties go to the first language by name; rows are independent; the
model of no labelled document is empty, and to it every row is ``und``; an empty table gives an empty table; further columns are ignored. A null doc_id
is not held out and not learned from.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.sources.tables import Workspace, shipped

LETTERS = regex.compile(r"\p{L}+")
TRAIN_DOCS = 2000
ROUNDS = 2
FLOOR = 1e-7
#: Letters from which a word is summed on its own, and isn't kept.
LONG = 40
#: Places after which the sums are scaled anew: so many of the least probabilities, and a longest piece's, are above the least double.
STEP = 8
#: Words kept between texts, in each of two generations.
KEPT_WORDS = 150_000
NONE, UNKNOWN = 0, 1


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """Row numbers of the vocabulary's letter pieces, in lower case, and the longest piece; "▁" opens a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    kept = sorted(p for p in found if p == p.lower() and regex.fullmatch(r"▁?\p{L}*", p) and p)
    return {p: i + 2 for i, p in enumerate(kept)}, max(map(len, kept))


def default_path() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str) -> list[str]:
    """A text's words as the model reads them: runs of letters."""
    return LETTERS.findall(text.lower())


def lattices(words: list[str], vocabulary: dict[str, int], longest: int):
    """Words of one length at a time: their places, the length, and the piece rows of each (start, size)."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    get = vocabulary.get
    for n, rows in by_length.items():
        marked = ["▁" + words[i] for i in rows]
        grid = {}
        for start in range(n + 1):
            for size in range(1, min(longest, n + 1 - start) + 1):
                default = UNKNOWN if size == 1 else NONE
                ids = np.fromiter((get(w[start : start + size], default) for w in marked), np.int32, len(marked))
                if size == 1 or ids.any():
                    grid[start, size] = ids
        yield np.array(rows), n + 1, grid


def forward(grid: dict, n: int, probability: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over all segmentations of each prefix, and the logarithm of their scale: arrays (words, languages) of each place."""
    width, reach = len(next(iter(grid.values()))), max(size for _, size in grid)
    sums = [np.zeros((width, probability.shape[1])) for _ in range(n + 1)]
    sums[0][:] = 1
    scale, scales, last = np.zeros_like(sums[0]), [], -1
    for (start, size), ids in sorted(grid.items(), key=lambda x: x[0]):
        if start != last:
            last = start
            if start and start % STEP == 0:
                ahead = sums[start : start + reach]
                top = np.maximum.reduce(ahead)
                for s in ahead:
                    s /= top
                scale = scale + np.log(top)
            scales.append(scale)
        sums[start + size] += sums[start] * probability[ids]
    return sums, [*scales, scale]


def score_long(word: str, vocabulary: dict[str, int], longest: int, probability: np.ndarray) -> np.ndarray:
    """Log probabilities (languages) of a word of any length: as ``forward``, but only the last places are kept, and rescaled as they get small."""
    marked, width = "▁" + word, longest + 1
    ring, scale = np.zeros((width, probability.shape[1])), np.zeros(probability.shape[1])
    ring[0] = 1
    for start in range(len(marked)):
        here = ring[start % width].copy()
        ring[start % width] = 0
        for size in range(1, min(longest, len(marked) - start) + 1):
            piece = vocabulary.get(marked[start : start + size], UNKNOWN if size == 1 else NONE)
            if piece:
                ring[(start + size) % width] += here * probability[piece]
        if start % STEP == STEP - 1:
            top = ring.max(axis=0)
            ring /= top
            scale += np.log(top)
    return np.log(ring[len(marked) % width]) + scale


def score_words(words: list[str], path: str, probability: np.ndarray) -> np.ndarray:
    """Log probabilities (words, languages)."""
    out = np.empty((len(words), probability.shape[1]))
    vocabulary, longest = pieces(path)
    short = [i for i, w in enumerate(words) if len(w) < LONG]
    for rows, n, grid in lattices([words[i] for i in short], vocabulary, longest):
        sums, scales = forward(grid, n, probability)
        out[np.array(short)[rows]] = np.log(sums[n]) + scales[n]
    for i, w in enumerate(words):
        if len(w) >= LONG:
            out[i] = score_long(w, vocabulary, longest, probability)
    return out


def expected_long(word: str, vocabulary: dict[str, int], longest: int, p: list[float]) -> dict[int, float]:
    """How often each piece is used in a word of any length, over all its segmentations; sums are logarithms, one a place."""
    marked = "▁" + word
    n, get, found = len(marked), vocabulary.get, defaultdict(float)

    def total(terms: list[tuple[float, float]]) -> float:
        top = max(x for x, _ in terms)
        return top + math.log(sum(q * math.exp(x - top) for x, q in terms))

    def ending(end: int) -> list[tuple[int, int]]:
        pieces_ = ((size, get(marked[end - size : end], UNKNOWN if size == 1 else NONE)) for size in range(1, min(longest, end) + 1))
        return [x for x in pieces_ if x[1]]

    ahead, behind = [0.0] * (n + 1), [-math.inf] * n + [0.0]
    for end in range(1, n + 1):
        ahead[end] = total([(ahead[end - size], p[piece]) for size, piece in ending(end)])
    for end in range(n, 0, -1):  # what follows ``end`` is summed; it goes on to where the pieces begin
        for size, piece in ending(end):
            start, x = end - size, behind[end] + math.log(p[piece])
            high, low = max(behind[start], x), min(behind[start], x)
            behind[start] = high + math.log1p(math.exp(low - high))
            found[piece] += math.exp(ahead[start] + x - ahead[n])
    return found


def expected_counts(words: Counter, path: str, probability: np.ndarray, language: int) -> np.ndarray:
    """How often each piece is used, over all segmentations of the counted words under one language's probabilities."""
    vocabulary, longest = pieces(path)
    listed = [w for w in words if len(w) < LONG]
    times = np.array([words[w] for w in listed], float)
    p = probability[:, [language]]
    out = np.zeros(len(probability))
    for rows, n, grid in lattices(listed, vocabulary, longest):
        ahead, behind = (forward(g, n, p) for g in (grid, {(n - start - size, size): ids for (start, size), ids in grid.items()}))
        before, after = ([np.log(s) + scale for s, scale in zip(*x, strict=True)] for x in (ahead, behind))
        for (start, size), ids in grid.items():
            used = np.exp(before[start] + after[n - start - size] - before[n])
            np.add.at(out, ids, (p[ids] * used * times[rows][:, None])[:, 0])
    plain = p[:, 0].tolist()
    for w in (w for w in words if len(w) >= LONG):
        for piece, n in expected_long(w, vocabulary, longest, plain).items():
            out[piece] += n * words[w]
    return out


class Model:
    """Languages and the probability of each piece in each."""

    def __init__(self, languages: list[str], probability: np.ndarray, path: str):
        self.languages, self.probability, self.path = languages, probability, path
        self.young: tuple[dict[str, int], np.ndarray] = ({}, np.empty((0, len(languages))))
        self.old = self.young

    def __reduce__(self):
        return Model, (self.languages, self.probability, self.path)

    def placed(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        """Where the words' scores are; a full generation becomes the old one, from which words that are met again come back."""
        if len(self.young[0]) > KEPT_WORDS:
            self.old, self.young = self.young, ({}, self.old[1][:0])
        place, scores = self.young
        missing = words.difference(place)
        again = [w for w in missing if w in self.old[0]]
        fresh = list(missing.difference(again))
        if missing:
            found = [scores, self.old[1][[self.old[0][w] for w in again]], score_words(fresh, self.path, self.probability)]
            place.update(zip([*again, *fresh], range(len(place), len(place) + len(missing)), strict=True))
            self.young = place, np.concatenate(found)
        return self.young

    def read(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; a word's sums are kept for the texts that follow."""
        listed = [words_of(t) for t in texts]
        short = set().union(*listed)
        long_ = {w: score_words([w], self.path, self.probability)[0] for w in short if len(w) >= LONG} if self.languages else {}
        place, scores = self.placed(short.difference(long_)) if self.languages else ({}, None)
        out = []
        for words in listed:
            if not words or not self.languages:
                out.append(("und", 0.0))
                continue
            kept = [w for w in words if w not in long_] if long_ else words
            total = scores[np.fromiter(map(place.__getitem__, kept), np.int64, len(kept))].sum(axis=0)
            if long_:
                total = total + sum(long_[w] for w in words if w in long_)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out


@shipped
def train(docs: DataFrame, path: str | None = None, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from the documents that are not held out and have a lang: at most about ``train_docs`` of each language."""
    path = path or default_path()
    usable = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(counts)
    size = max(pieces(path)[0].values()) + 1
    probability = np.full((size, max(1, len(languages))), 1 / size)
    probability[NONE], probability[UNKNOWN] = 0, FLOOR
    if not languages:
        return Model([], probability, path)
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, train_docs / counts[k]))))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    with Workspace(docs.sparkSession) as w:
        sample = w.table(chosen.select("lang", "text"), "op9-sample")  # read again in each round
        return Model(languages, learn(sample, languages, probability, path), path)


def learn(sample: DataFrame, languages: list[str], probability: np.ndarray, path: str) -> np.ndarray:
    """The pieces' probabilities after ROUNDS of expectation maximisation over (lang, text)."""
    schema = pa.schema([("language", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])
    for _ in range(ROUNDS):
        known = probability

        def run(batches, known=known):
            seen: dict[int, Counter] = defaultdict(Counter)
            for b in common.slices(batches):
                for lang, text in zip(b.column("lang").to_pylist(), common.texts_of(b), strict=True):
                    seen[languages.index(lang)].update(words_of(text))
            for k, words in seen.items():
                found = expected_counts(words, path, known, k)
                used = np.flatnonzero(found)
                yield common.to_batch(schema, [[k] * len(used), used.tolist(), found[used].tolist()])

        total = np.zeros_like(probability)
        rows = sample.mapInArrow(run, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n"))
        for r in rows.collect():  # at most languages * pieces
            total[r["piece"], r["language"]] = r["n"]
        total[NONE] = total[UNKNOWN] = 0
        total[2:] += 0.02
        probability = total / total.sum(axis=0)
        probability[UNKNOWN] = FLOOR
    return probability


@shipped
def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in common.slices(batches):
            rows = model.read(common.texts_of(b))
            yield common.to_batch(schema, [b.column("doc_id"), b.column("held_out"), *map(list, zip(*rows, strict=True))])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


@shipped
def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of at least ``least``; columns as they are."""

    def run(batches):
        for b in common.slices(batches):
            keep = [lang != "und" and score >= least for lang, score in model.read(common.texts_of(b))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

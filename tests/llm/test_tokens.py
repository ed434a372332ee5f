"""Operators 4, 7 and 10 against the tokenizers library and plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, tokens, words64
from millrace.llm.tokens import default_path, library_encoder
from millrace.sources.tables import load

ODD = ["", None, "<|endoftext|>", "a <|endoftext|>  b  <|endoftext|>\n", "x" * 9000, "   \n\n \t x　y  ", "\x1c\x1d a\x85b", "it's 'S 123 ½ ४२ 😀😀", "ab" * 500, "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], 7, "x"), (None, "no id", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, ids string")


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoders_match_the_library(library):
    rnd = random.Random(7)
    letters = "ab<|endoftext|>' \n\té😀1  \x1cthersion"
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    pairs, own = bpe.tables(default_path())
    for text in texts:
        want = ids_of(library, text).tobytes()
        assert own.ids(text) == want and library_encoder(default_path()).ids(text) == want
        assert pairs.decode(np.frombuffer(want, "<u4").astype(np.int64)).decode() == text


def test_compatibility_table_is_what_merging_gives():
    pairs, _ = bpe.tables(default_path())
    rnd = random.Random(3)
    for _ in range(3000):
        a, b = rnd.randrange(3000), rnd.randrange(3000)
        assert pairs.fits(a, b) == (bpe.merge_all(pairs, pairs.bytes_of[a] + pairs.bytes_of[b]) == [a, b])


def test_round_trip(spark, odd, library):
    got = {(r["doc_id"], r["decoded_sha256"], r["ids_sha256"], r["n_tokens"]) for r in bpe.round_trip(odd).collect()}
    want = set()
    for r in odd.collect():
        ids = ids_of(library, r["text"])
        want.add((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), hashlib.sha256(ids.tobytes()).hexdigest(), len(ids)))
    assert got == want
    back = bpe.decode(bpe.encode(odd)).collect()
    assert sorted(r["text"] for r in back) == sorted((r["text"] or "") for r in odd.collect())
    assert bpe.round_trip(odd.limit(0)).count() == 0


def test_simple8b_words():
    rnd = np.random.default_rng(5)
    for ids in ([], [0], [0] * 500, [2**60 - 1, 2**60, 2**63], rnd.integers(0, 50_257, 3000), rnd.integers(0, 2 ** rnd.integers(1, 62, 2000))):
        ids = np.array(ids, np.uint64)
        words, escaped, values = words64.pack(ids)
        assert (words64.unpack(words, len(ids), escaped, values) == ids).all()
        assert len(words) <= max(1, len(ids))
    assert len(words64.pack(np.ones(60, np.uint64))[0]) == 1


def expect_starts(rows, library, end):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(ids_of(library, text), np.uint32(end)).astype("<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_simple8b_file(spark, odd, library, sf):
    for docs in (odd, load(spark, sf, "documents")):
        got = [tuple(r) for r in words64.read(words64.write(docs)).collect()]
        want = expect_starts([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], library, 0)
        key = lambda r: (r[1], r[2])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert words64.read(words64.write(odd.limit(0))).count() == 0


def plain_best_fit(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else window
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


def test_plan_equals_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(60):
        window = rnd.choice([7, 16, 64, 100])
        lengths = [rnd.randint(1, window) for _ in range(rnd.randint(0, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        classes = packing.plan(histogram, window)
        assert sorted(window - sum(c) for c, k in classes for _ in range(k)) == plain_best_fit(lengths, window)


def test_packing(spark, odd, library, sf):
    for docs in (odd, load(spark, sf, "documents")):
        rows = packing.pack(docs).collect()
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        by_sequence = {}
        for r in rows:
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert sum(r["length"] for r in rows) == sum(len(ids_of(library, t)) + 1 for _, t in texts)
        pieces = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows}
        for doc_id, text in texts:
            ids = np.append(ids_of(library, text), np.uint32(1)).astype("<u4")
            for s in range(0, len(ids), 2048):
                assert (doc_id, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) in pieces
    assert packing.pack(odd.limit(0)).count() == 0


def test_a_word_is_encoded_once_whatever_follows_it():
    """A word keeps one entry, and is encoded once, with any marks behind it."""
    calls = []
    encoder = tokens.Encoder(lambda piece: calls.append(piece) or b"\0\0\0\1", {})
    encoder.ids("a word, word. word; word: word! word? word\n word's word-word word1 wordé (word) word")
    kept = {k for cache in vars(encoder).values() if isinstance(cache, tokens.Pieces) for k in cache}
    assert calls.count(" word") == 1 and {k for k in kept if k.startswith(" word")} == {" word", " wordé"}


def test_units_are_cut_as_the_library_cuts(library):
    """Words before marks, digits, other scripts, combining marks and odd spaces."""
    encoder = library_encoder(default_path())
    rnd = random.Random(6)
    parts = ["word", "Été", "ßa", "ŉ", "ǅ", "ɏ", "ɐ", "α", "я", "你", "́", "²", "1", "x2", "'", "'s", "'ll", "’", ".", ",", "(", "[", "`", "{", "~", "-", "×", "÷", "ª", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", " ", "​", "😀", "\0", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)

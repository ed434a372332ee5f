"""Operator 10: byte-pair encoding by backtracking, and decoding by an offset table.

Tokens that start at each byte come from one Aho-Corasick pass over a word piece. The encoder takes the longest token at
its place if that token and the one before it are what merging their joined bytes gives (the pair-compatibility table);
else the next shorter token; else it steps back and closes the place it came from. No place is entered twice with the
same outcome, so the work is linear in the piece's length, and the result is that of applying the merges in rank order.

Rules: null or empty texts give no ids and an empty decoding; texts of any length are encoded whole; rows are
independent, so ties and repeated rows each get their own result; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common
from millrace.llm.tokens import Encoder, byte_letters, default_path
from millrace.sources.tables import shipped


class BytePairs:
    """The tables of one vocabulary file: tokens, merge ranks, how each token was made, and the offset table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for k, v in vocab.items():
            self.bytes_of[v] = k
        for k, v in self.specials.items():
            self.bytes_of[v] = k.encode()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int] | None] = [None] * size
        self.born = [-1] * size
        for r, merge in enumerate(model["model"]["merges"]):
            a, b = map(as_bytes, merge if isinstance(merge, list) else merge.split(" "))
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            if self.made[whole] is None:
                self.made[whole], self.born[whole] = pair, r
        self.of_bytes = vocab
        self.length = [len(b) for b in self.bytes_of]
        self.shorter: list[int] = [-1] * size
        for k, v in vocab.items():
            self.shorter[v] = next((vocab[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in vocab), -1)
        self.find = ahocorasick.Automaton()
        for k, v in vocab.items():
            self.find.add_word(k.decode("latin-1"), (len(k), v))
        self.find.make_automaton()
        self.single = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.buffer = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again.

        Undo the younger of the two tokens' last merges step by step: at each step the parts that meet at the seam must
        not be a pair that merges before the parts themselves had been merged on.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        born, made, rank = self.born, self.made, self.rank
        # ranks below which the parts at the seam, as they are now, are still whole: the merges that take them up
        until_a = until_b = len(rank) + 1
        while True:
            r = rank.get((a, b))
            # equal ranks are one merge on both sides of the seam; the leftmost goes first and uses the left part up
            if r is not None and r < until_a and r <= until_b:
                return False
            if born[a] < 0 and born[b] < 0:
                return True
            if born[a] > born[b]:
                until_a, a = born[a], made[a][1]
            else:
                until_b, b = born[b], made[b][0]

    def encode_piece(self, piece: str) -> bytes:
        """Packed ids of one word piece."""
        raw = piece.encode()
        whole = self.of_bytes.get(raw)
        if whole is not None and self.born_whole(whole):
            return np.array([whole], "<u4").tobytes()
        n, length, shorter, fits = len(raw), self.length, self.shorter, self.fits
        longest = [self.single[b] for b in raw]
        for end, (size, token) in self.find.iter(raw.decode("latin-1")):
            start = end - size + 1
            if size > length[longest[start]]:
                longest[start] = token
        open_ = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_[at + length[token]] and (last < 0 or fits(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return np.array(out, "<u4").tobytes()

    @functools.cached_property
    def _whole(self) -> dict[int, bool]:
        return {}

    def born_whole(self, token: int) -> bool:
        """Whether a token's own bytes merge to that token: its two parts must be compatible up to its own merge."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.made[token] is None or merge_all(self, self.bytes_of[token]) == [token]
        return known

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from one buffer by the offset table."""
        starts, ends = self.offsets[ids], self.offsets[ids + 1]
        sizes = ends - starts
        total = int(sizes.sum())
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(ids) else starts, sizes)
        return self.buffer[shift + np.arange(total)].tobytes()


def merge_all(tables: BytePairs, raw: bytes) -> list[int]:
    """The plain definition: merge the pair of lowest rank, leftmost first, until none is left. For tables and tests."""
    parts = [tables.single[b] for b in raw]
    while len(parts) > 1:
        best = min((tables.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 30:
            break
        i = best[1]
        parts[i : i + 2] = [tables.of_bytes[tables.bytes_of[parts[i]] + tables.bytes_of[parts[i + 1]]]]
    return parts


@functools.lru_cache(maxsize=2)
def tables(path: str) -> tuple[BytePairs, Encoder]:
    """The tables and the encoder of a vocabulary file, once for each worker process."""
    pairs = BytePairs(path)
    return pairs, Encoder(pairs.encode_piece, pairs.specials)


@shipped
def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the array of token ids of each whole text."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        _, encoder = tables(path)
        for b in common.slices(batches):
            ids = [np.frombuffer(encoder.ids(t), "<u4").astype(np.int64) for t in common.texts_of(b)]
            yield common.to_batch(schema, [b.column("doc_id"), ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of each row of ``encode``; bytes that are not UTF-8 become U+FFFD."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        pairs, _ = tables(path)
        for b in common.slices(batches):
            out = [pairs.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield common.to_batch(schema, [b.column("doc_id"), out])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@shipped
def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode each whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        pairs, encoder = tables(path)
        for b in common.slices(batches):
            rows = []
            for text in common.texts_of(b):
                packed = encoder.ids(text)
                back = pairs.decode(np.frombuffer(packed, "<u4").astype(np.int64)).decode("utf-8", "replace")
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield common.to_batch(schema, [b.column("doc_id"), *map(list, zip(*rows, strict=True))])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

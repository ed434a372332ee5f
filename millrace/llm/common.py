"""What several operators share: row access in Arrow tasks, ordered blocks of documents, shingles.

In all operators doc_id is a 64-bit integer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handled at once inside a task; bounds what a batch of long texts adds to a worker's memory.
SLICE = 256
MAX_BLOCKS = 65_536


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column's strings in UTF-8, null as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


#: For ``bytes.translate``: A-Z in lower case; and with all of ASCII but letters and digits as spaces, so that ``split`` gives the terms.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TERMS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all other characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(TERMS).split()


def fresh(names: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has that name."""
    while name in names:
        name = f"_{name}"
    return name


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch from Python lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_bounds(df: DataFrame, key: str = "doc_id", blocks: int | None = None) -> list[int]:
    """Upper bounds that deal the rows into blocks of nearly equal counts, by approximate quantiles of ``key``.

    The list has at most MAX_BLOCKS entries, whatever the input; it is empty for an empty table.
    """
    blocks = min(blocks or 8 * partitions(df), MAX_BLOCKS)
    marks = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(F.col(key), marks, 20 * blocks).alias("q")).first()["q"] or []
    return sorted(set(found))


def block_of(key: str, bounds: list[int]) -> Column:
    """The number of bounds below ``key``, by binary search over a literal array; null keys are in block 0."""
    if not bounds:
        return F.lit(0)
    array = F.lit(np.array(bounds, dtype=np.int64))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = (state["lo"] < state["hi"]) & (F.element_at(array, mid + 1) < F.col(key))
        return F.when(state["lo"] >= state["hi"], state).otherwise(
            F.struct(F.when(below, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(mid).alias("hi"))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(steps, start, halve)["lo"]
    return F.coalesce(F.when(F.col(key).isNull(), F.lit(0)).otherwise(found), F.lit(0))


WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits look independent."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a number of entries."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_words = WordHashes()


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` lower-case words, in order; a shorter text is one run; none without a word."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix64((out * _MIX) ^ h[i : len(words) - size + 1 + i])
    return out

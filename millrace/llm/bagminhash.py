"""Operator 5: near-duplicates by BagMinHash of 5-word shingles.

A document is a bag of shingles; the likeness of two is their weighted Jaccard similarity, the common part of the counts
over their union. For a shingle of count w, unit-rate Poisson processes over the counts 0..w throw points at the
signature's registers, and each register keeps its earliest time. Counts are discretised and taken in doubling intervals
(0,1], (1,2], (2,4], ...: one process for each interval, with the interval's length as its rate; in the last, partly
covered interval a point counts if its own position lies below w. A process stops when its time passes the latest
register. Registers of two bags agree with the probability of their weighted Jaccard similarity.

Registers are banded; of the documents that share a band, each is compared with the most central one by their exact
multiset overlap, then those of a band that aren't linked yet with each other (``linking``), and linked ones form classes. Equal texts,
told by SHA-256, are one item: a task computes a text's signature once, and one row of a text goes on.

Rules: null counts as empty; texts without a word are alike only if they are equal (null and empty are); a text of fewer
than five words is one shingle of all its words; texts are read whole; repeated rows belong to one class and each keeps
its row; a class is named by its least doc_id, null if it has no other; an empty table gives an empty table; further
columns are ignored by ``classes``, kept by ``deduplicate``, and may have any names. Of rows that agree in doc_id and text,
``deduplicate`` keeps one, whichever comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common, linking
from millrace.sources.tables import Workspace, materialize

#: 48 bands of 7: two texts of similarity 0.8 share none with a probability of 1.2e-5.
REGISTERS, BAND = 336, 7
THRESHOLD = 0.8
#: Digests of texts that a task remembers to have done.
SEEN = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their counts."""
    return np.unique(common.shingles(text), return_counts=True)


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; two empty bags have none."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    either = int(x[1].sum() + y[1].sum()) - both
    return both / either if either else 0.0


def elements(text: str) -> np.ndarray:
    """A text's bag as a set: each shingle with the number of its occurrence."""
    hashes, counts = bag(text)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return common.mix64(np.repeat(hashes, counts) + nth.astype(np.uint64) * GOLDEN)


def processes(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """The Poisson processes of all bags: bag number, seed, rate, the interval's lower end, the count."""
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    element = np.concatenate([b[0] for b in bags]) if bags else np.empty(0, np.uint64)
    count = np.concatenate([b[1] for b in bags]) if bags else np.empty(0, np.int64)
    parts, low, level = [], 0, 0
    while True:
        held = count > low
        if not held.any():
            break
        span = max(1, low)
        with np.errstate(over="ignore"):
            seed = common.mix64(element[held] + np.uint64(level + 1) * GOLDEN)
        n = int(held.sum())
        parts.append((owner[held], seed, np.full(n, span), np.full(n, low), count[held]))
        low, level = low + span, level + 1
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else ()


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Register times (bags, registers) as 32-bit floats; infinite for an empty bag."""
    times = np.full(len(bags) * registers, np.inf)
    made = processes(bags)
    if not made:
        return times.reshape(len(bags), registers).astype(np.float32)
    owner, seed, span, low, count = made
    clock = np.zeros(len(owner))
    step = 0
    while len(owner):
        # a few steps of all processes at once; points past the latest register change nothing
        some = np.arange(step + 1, step + 2 + step // 4, dtype=np.uint64)
        step += len(some)
        with np.errstate(over="ignore"):
            draw = common.mix64(seed[:, None] + some * GOLDEN)
            other = common.mix64(draw ^ np.uint64(0xD6E8FEB86659FD93))
        waits = np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / -span[:, None]
        waits[:, 0] += clock
        reached = np.add.accumulate(waits, axis=1)  # in order, so that a point's time doesn't depend on the other bags
        where = (((other & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64) + (owner * registers)[:, None]
        if span.max() > 1:  # spans are powers of two; in an interval of length one every point counts
            cell = low[:, None] + ((other >> np.uint64(32)).astype(np.int64) & (span - 1)[:, None])
            counts = cell < count[:, None]
            np.minimum.at(times, where[counts], reached[counts])
        else:
            np.minimum.at(times, where.ravel(), reached.ravel())
        clock = reached[:, -1]
        on = clock < times.reshape(len(bags), registers).max(axis=1)[owner]
        owner, seed, span, low, count, clock = owner[on], seed[on], span[on], low[on], count[on], clock[on]
    return times.reshape(len(bags), registers).astype(np.float32)


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each signature (bags, bands)."""
    bits = signature.view(np.uint32).astype(np.uint64).reshape(len(signature), -1, band)
    keys = np.arange(bits.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(band):
            keys = common.mix64(keys * GOLDEN ^ bits[:, :, i])
    return keys.view(np.int64)


def sketches(texts: DataFrame, registers: int = REGISTERS, band: int = BAND) -> DataFrame:
    """digest, size and keys (the bands') of each distinct text of (digest, text); no keys without a word."""
    schema = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        seen: set[bytes] = set()
        for b in common.slices(batches):
            fresh = {d: t for d, t in zip(b.column("digest").to_pylist(), common.texts_of(b), strict=True) if d not in seen}
            if len(seen) > SEEN:
                seen.clear()
            seen.update(fresh)
            bags = {d: bag(t) for d, t in fresh.items()}
            full = [d for d, x in bags.items() if len(x[0])]
            found = dict(zip(full, band_keys(signatures([bags[d] for d in full], registers), band), strict=True)) if full else {}
            yield common.to_batch(schema, [list(bags), [int(x[1].sum()) for x in bags.values()], [found.get(d, ()) for d in bags]])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, size long, keys array<long>").dropDuplicates(["digest"])


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the text's SHA-256 digest."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def placed(docs: DataFrame, threshold: float, w: Workspace) -> DataFrame:
    """digest, least doc_id and root of each distinct text."""
    rows = digested(docs)
    # numbered once they are written, so that a number is a text's own
    items = w.table(sketches(rows).withColumn("id", F.monotonically_increasing_id()), "sketches")
    roots = linking.classes(items, rows, elements, threshold)
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    texts = least.join(items.select("digest", "id"), "digest").join(roots, "id", "left")
    return w.table(texts.select("digest", "least", F.coalesce("root", "id").alias("root")), "texts")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id, the least doc_id of the near-duplicates that it is linked to, for each row."""
    with Workspace(docs.sparkSession) as w:
        texts = placed(docs, threshold, w)
        least = texts.groupBy("root").agg(F.min("least").alias("class_id"))
        named = materialize(texts.join(least, "root").select("digest", "class_id"), "classes")
    return digested(docs).select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, of its least doc_id (null last, then the least digest); columns as they are."""
    with Workspace(docs.sparkSession) as w:
        texts = placed(docs, threshold, w)
        order = F.struct(F.col("least").isNull(), "least", "digest")
        kept = texts.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.digest").alias("digest"), F.col("k.least").alias("doc"))
        kept = materialize(kept, "kept")
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.col("doc_id").alias("id"))
    match = (rows["digest"] == kept["digest"]) & rows["id"].eqNullSafe(kept["doc"])
    return rows.join(kept, match, "left_semi").dropDuplicates(["digest", "id"]).select("row.*")

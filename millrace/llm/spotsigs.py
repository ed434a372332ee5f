"""Operator 1: SpotSigs fingerprints.

A spot signature is a common word (the anchor) with the next content words after it. A text's fingerprint is the set of
its spot signatures, as sorted 32-bit hashes in hex; two texts are as alike as the Jaccard similarity of their sets. For
near-duplicate classes, sets are dealt into partitions by their length so that alike sets are in the same or the next
one; within these, sets that share one of their rarest signatures are compared in order, until the signatures that are
left can't reach the threshold.

Rules: null counts as empty; the empty fingerprint belongs to texts without a word, and two of these are alike to 1.0; a
text with words but no spot has one signature, of all its words. Equal texts have equal fingerprints. Texts are read
whole. Documents go by descending doc_id, nulls last, repeated ids by their text; the document after the last is the
first. One document alone follows itself. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common, linking
from millrace.sources.tables import Workspace, materialize, shipped

#: Anchors, the commonest function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the a an of to in is and that it for on with as was by be this are from or at have "
    "der die das und ist in den von zu mit sich des auf für ein eine dem nicht als auch "
    "le la les de des du et un une en que qui dans pour par sur au est pas "
    "el los las del y que en un una por con para se su es lo al".split()
)
CHAIN = 2


def spots(text: str, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct hashes of a text's spot signatures."""
    content: list[str] = []
    anchors: list[tuple[str, int]] = []
    words = common.WORD.findall(text.lower())
    for w in words:
        if w in ANCHORS:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    if chain == 2:
        chains = {f"{a} {content[k]} {content[k + 1]}" for a, k in anchors if k <= last}
    else:
        chains = {" ".join((a, *content[k : k + chain])) for a, k in anchors if k <= last}
    if words and not chains:
        chains = {"\n".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, chains), np.uint32, len(chains)))


def to_string(marks: np.ndarray) -> str:
    """A fingerprint as hex, eight digits a signature."""
    return marks.astype(">u4").tobytes().hex()


def from_string(shown: str) -> np.ndarray:
    """The signatures of a fingerprint."""
    return np.frombuffer(bytes.fromhex(shown), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def pruned_alike(x: np.ndarray, y: np.ndarray, ratio: float, step: int = 64) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``ratio``; ends as soon as the rest can't reach it."""
    short, long_ = sorted((x, y), key=len)
    total, both, at = len(x) + len(y), 0, 0

    def enough(shared: int) -> bool:
        return shared >= ratio * (total - shared)

    for start in range(0, len(short), step):
        if not enough(both + min(len(short) - start, len(long_) - at)):
            return False
        part = short[start : start + step]
        end = at + int(np.searchsorted(long_[at:], part[-1], "right"))
        both, at = both + len(np.intersect1d(part, long_[at:end], assume_unique=True)), end
    return enough(both)


@shipped
def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in common.slices(batches):
            yield common.to_batch(schema, [b.column("doc_id"), [to_string(spots(t)) for t in common.texts_of(b)]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


@shipped
def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near-duplicates, or its own) of each document.

    Equal fingerprints are one item. An item's keys are its rarest signatures, as many as two sets of this length may
    differ in and one more, with the number of its length partition and of the one before.
    """
    with Workspace(docs.sparkSession) as w:
        prints = w.table(fingerprints(docs).withColumn("digest", F.unhex(F.sha2("fingerprint", 256))), "op1-fingerprints")
        once = prints.groupBy("digest").agg(F.first("fingerprint").alias("text"))
        sets = w.table(once.withColumn("size", F.length("text") / 8).withColumn("id", F.monotonically_increasing_id()), "op1-sets")
        marks = sets.select("id", "size", F.explode(F.expr("regexp_extract_all(text, '([0-9a-f]{8})')")).alias("mark"))
        often = marks.groupBy("mark").agg(F.count("*").alias("n"))
        rare = F.array_sort(F.collect_list(F.struct("n", "mark")))  # as long as one text's set
        ranked = marks.join(often, "mark").groupBy("id", "size").agg(rare.alias("marks"))
        kept = F.slice("marks", 1, (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int"))
        part = F.floor(F.log("size") / -np.log(threshold))
        keys = F.flatten(F.transform(kept, lambda k: F.array(F.xxhash64(part, k["mark"]), F.xxhash64(part + 1, k["mark"]))))
        items = w.table(ranked.select("id", "size", keys.alias("keys")).join(sets.select("id", "digest"), "id"), "op1-keys")
        roots = linking.classes(items, sets.select("digest", "text"), lambda x: from_string(x).astype(np.uint64), threshold, pruned_alike)
        numbered = prints.select("doc_id", "digest").join(sets.select("id", "digest"), "digest")
        placed = w.table(numbered.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")), "op1-placed")
        least = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
        return materialize(placed.join(least, "root").select("doc_id", "class_id"), "op1-classes")


@shipped
def with_next(docs: DataFrame) -> DataFrame:
    """The query's rows: each document's fingerprint, its edited text's, and its likeness to that and to the next document.

    Documents are dealt into ranges of doc_id and sorted there. A range also gets the first document of the one that
    comes after it, so that its last row has its successor; nothing is sorted in one task.
    """
    docs = docs.select("doc_id", "text")
    bounds = common.block_bounds(docs)
    placed = docs.withColumn("block", common.block_of("doc_id", bounds))
    tops = {r["block"]: r["top"] for r in placed.groupBy("block").agg(F.max("doc_id").alias("top")).collect()}  # a row for each block
    order = sorted(tops, reverse=True)
    # the first document of a range goes to the range before it too; the first of all to the last range
    target = {b: order[i - 1] for i, b in enumerate(order)}
    guests = docs.sparkSession.createDataFrame([(b, tops[b], target[b]) for b in order], "block int, top long, target int")
    if not order:
        guests = guests.limit(0)
    led = placed.join(F.broadcast(guests), "block", "left")  # one small row a block
    own = F.struct(F.col("block").cast("int").alias("block"), F.lit(0).alias("guest"))
    sent = F.struct(F.col("target").cast("int").alias("block"), F.lit(1).alias("guest"))
    led = led.withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, sent)).otherwise(F.array(own))))
    dealt = led.select(F.col("at.block").alias("block"), F.col("at.guest").alias("guest"), "doc_id", "text")
    dealt = dealt.repartition(common.partitions(docs), "block").sortWithinPartitions("block", "guest", F.desc_nulls_last("doc_id"), "text")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches):
        held, over = None, None  # the row that waits for its successor; the block whose guest has been used
        rows: list[tuple] = []
        for b in common.slices(batches):
            for block, guest, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("block", "guest", "doc_id")), common.texts_of(b), strict=True):
                if guest and over == block:
                    continue
                marks = spots(text)
                if held and held[0] == block:
                    _, own_id, own_text, own_marks = held
                    n, half = len(own_text), len(own_text) // 2
                    edited = own_text[: n - half] + text[:half]
                    changed = spots(edited)
                    rows.append((own_id, n, hashlib.sha256(edited.encode()).hexdigest(), to_string(own_marks), to_string(changed), likeness(own_marks, changed), likeness(own_marks, marks)))
                held, over = (None, block) if guest else ((block, doc_id, text, marks), over)
            if rows:
                yield common.to_batch(schema, list(map(list, zip(*rows, strict=True))))
                rows = []

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

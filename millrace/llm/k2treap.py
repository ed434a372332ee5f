"""Operator 11: ranked lexical search over K2-treaps.

The grid of terms (rows) and documents (columns) is cut into blocks of documents. A block's cells, the impacts of a term
in a document, form a quadtree: each node stands for a square of the grid, has a bit for each of its four quarters that
isn't empty, and the greatest impact below it, stored as the difference from its parent's. Nodes lie in breadth-first
order, so a child's place follows from the count of bits before it.

A query walks down one row path for each of its terms, jointly: a range of documents is bounded by the sum of its terms'
weights times the greatest impacts of the nodes that they are in. The ranges with the highest bounds are halved first,
and those that can't reach the item's k-th best score so far are left out; single documents' bounds are their scores.

Impacts are 10^9 tf / (1000 tf + 12 m), rounded down, where m = 75 + 25 n N / L, rounded down, of tf occurrences in a
document of n terms, N documents with terms, and L terms in all. A term's weight, floor(1000 ln((2N + 2) / (2 df + 1))),
follows when a query is asked, from the rows' counts in all blocks.

Scale: blocks are made where the texts are read, without a shuffle, and hold a bounded number of documents and cells; an
index is written once, a few blocks to a file, so that a task reads few at a time. Items are asked in rounds of bounded size against all blocks, and each task returns at most k rows
for each item, whatever the number of its blocks.

Rules: terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased; null and
empty texts have none; each row of documents or items counts on its own, repeated ids too; equal scores go by ascending
doc_id, nulls last; an item without terms, or whose terms no document has, gives no row; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.sources.tables import Workspace, materialize, shipped

TOP = 20
#: Documents and cells of a block; the last document may go beyond the cells.
BLOCK_DOCS = 8192
BLOCK_CELLS = 1 << 19
#: Blocks of a file. Spark's reader takes a file's rows into memory together, about 5 MB each.
FILE_BLOCKS = 4
#: Ranges that are halved at once.
BATCH = 128
#: Bytes of items that are asked in one round.
ITEM_BYTES = 1 << 23
COUNT_BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)


@dataclass(frozen=True)
class Index:
    """Blocks, the number of documents with terms, and the number of terms in all of them."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def sizes(docs: DataFrame) -> tuple[int, int]:
    """N and L: the documents with at least one term, and all their terms."""
    schema = pa.schema([("docs", pa.int64()), ("terms", pa.int64())])
    inside = np.frombuffer(common.TERMS, np.uint8) != 32

    def run(batches):
        found = total = 0
        for b in common.slices(batches):
            for text in common.bytes_of(b):
                within = inside[np.frombuffer(text, np.uint8)]
                n = int(np.count_nonzero(within[1:] & ~within[:-1])) + int(len(within) and within[0])
                found, total = found + (n > 0), total + n
        yield common.to_batch(schema, [[found], [total]])

    row = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def spread(x: np.ndarray) -> np.ndarray:
    """Integers below 2^32 with a zero bit before each of their bits."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A K2-treap: ``height`` levels of halving, the bits of all nodes above the cells, and the greatest value of every node."""

    def __init__(self, height: int, kids: np.ndarray, tops: np.ndarray):
        self.height = height
        # one further node, empty, stands for the quarters that aren't there
        self.none = len(tops)
        self.inner = len(kids)
        self.kids = np.zeros(len(tops) + 1, np.uint8)
        self.kids[: len(kids)] = kids
        self.tops = np.append(tops, np.int32(0))

    @functools.cached_property
    def first(self) -> np.ndarray:
        """The place of each node's first child."""
        counts = COUNT_BITS[self.kids]
        ends = np.cumsum(counts, dtype=np.int32)
        ends -= counts
        ends += 1
        return ends

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        """From the cells of a grid, each once, of values above 0 and below 2^31."""
        height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        codes = (spread(rows) << np.uint64(1)) | spread(columns)
        order = np.argsort(codes)
        codes, values = codes[order], values[order].astype(np.int32)
        kids, tops = [], [values]
        for _ in range(height if len(codes) else 0):
            parents = codes >> np.uint64(2)
            starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
            kids.append(np.bitwise_or.reduceat(np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8), starts))
            tops.append(np.maximum.reduceat(tops[-1], starts))
            codes = parents[starts]
        return cls(height, np.concatenate(kids[::-1]) if kids else np.empty(0, np.uint8), np.concatenate(tops[::-1]))

    def packed(self) -> tuple[bytes, bytes]:
        """The inner nodes' bits; and the values as differences from the parents', their bytes of equal place together."""
        kids, own = self.kids[: self.inner], self.tops[: self.none].copy()
        own[1:] = np.repeat(self.tops[: self.inner], COUNT_BITS[kids]) - own[1:]
        return kids.tobytes(), own.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()

    @classmethod
    def unpacked(cls, height: int, kids: bytes, tops: bytes) -> Treap:
        """What ``packed`` gave."""
        bits = np.frombuffer(kids, np.uint8)
        values = np.ascontiguousarray(np.frombuffer(tops, np.uint8).reshape(4, -1).T).view("<i4")[:, 0]
        counts = COUNT_BITS[bits]
        start, end = 0, min(1, len(values))
        while end < len(values):  # a level at a time: its nodes' children are the next level
            below = np.repeat(values[start:end], counts[start:end])
            values[end : end + len(below)] = below - values[end : end + len(below)]
            start, end = end, end + len(below)
        return cls(height, bits, values)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores, the sums of the rows' weighted values, of the ``k`` best columns and of all that tie with the last.

        Only scores of at least ``least`` (above 0) are found. Ranges of columns are halved best bound first, ``batch`` at once.
        """
        nodes = np.zeros((1, len(rows)), np.int64)
        height, start = np.array([self.height]), np.array([0])
        bound = self.tops[nodes].astype(np.int64) @ weights
        columns, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while True:
            open_ = bound >= least
            nodes, height, start, bound = nodes[open_], height[open_], start[open_], bound[open_]
            if not len(bound):
                return columns, scores
            pick = np.argpartition(-bound, batch)[:batch] if len(bound) > batch else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            level = height[pick] - 1
            bits = self.kids[nodes[pick]].astype(np.int64)
            base = self.first[nodes[pick]]
            upper = 2 * ((rows[None, :] >> level[:, None]) & 1)
            made = []
            for half in (0, 1):
                quarter = upper + half
                child = np.where((bits >> quarter) & 1, base + COUNT_BITS[bits & ((1 << quarter) - 1)], self.none)
                made.append((child, level, start[pick] + (half << level), self.tops[child].astype(np.int64) @ weights))
            new_nodes, new_height, new_start, new_bound = (np.concatenate(x) for x in zip(*made, strict=True))
            ends = (new_height == 0) & (new_bound >= least)
            if ends.any():
                columns, scores = np.append(columns, new_start[ends]), np.append(scores, new_bound[ends])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    columns, scores = columns[scores >= least], scores[scores >= least]
            on = (new_height > 0) & (new_bound >= least)
            nodes = np.concatenate([nodes[rest], new_nodes[on]])
            height, start, bound = (np.concatenate([x[rest], y[on]]) for x, y in ((height, new_height), (start, new_start), (bound, new_bound)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What terms' occurrences in a document add to its score, before the terms' weights; below 10^6."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 12 * m)).astype(np.int32)


BLOCK = "doc_ids array<long>, terms binary, counts array<int>, height int, kids binary, tops binary"


def block_row(doc_ids: list, vocabulary: dict[bytes, int], rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> list:
    """A block's row: columns go by ascending doc_id, rows by how many documents have the term."""
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
    column = np.empty(len(order), np.int32)
    column[order] = np.arange(len(order))
    counts = np.bincount(rows, minlength=len(vocabulary))
    by_count = np.argsort(-counts, kind="stable")
    row = np.empty(len(by_count), np.int32)
    row[by_count] = np.arange(len(by_count))
    treap = Treap.build(row[rows], column[columns], values)
    terms = list(vocabulary)
    return [[doc_ids[i] for i in order], b" ".join(terms[i] for i in by_count.tolist()), counts[by_count].tolist(), treap.height, *treap.packed()]


@shipped
def build(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_cells: int = BLOCK_CELLS) -> Index:
    """The index of all terms of all documents, written to the shared folder."""
    n_docs, n_terms = sizes(docs)
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.list_(pa.int32())), ("height", pa.int32()), ("kids", pa.binary()), ("tops", pa.binary())])

    def run(batches):
        doc_ids, vocabulary, rows, times, held, margins = [], defaultdict(int), [], [], [], []

        def flush():
            vocabulary.default_factory = None
            columns = np.repeat(np.arange(len(held), dtype=np.int32), held)
            values = np.concatenate([impact(t, m) for t, m in zip(times, margins, strict=True)])
            return common.to_batch(schema, [[x] for x in block_row(doc_ids, vocabulary, np.concatenate(rows), columns, values)])

        vocabulary.default_factory = vocabulary.__len__
        for b in common.slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), common.bytes_of(b), strict=True):
                words = common.terms_of(text)
                if not words:
                    continue
                counted = Counter(words)
                doc_ids.append(doc_id)
                rows.append(np.fromiter(map(vocabulary.__getitem__, counted), np.int32, len(counted)))
                times.append(np.fromiter(counted.values(), np.int32, len(counted)))
                held.append(len(counted))
                margins.append(75 + 25 * len(words) * n_docs // n_terms)
                if len(held) >= block_docs or sum(held) >= block_cells:
                    yield flush()
                    doc_ids, vocabulary, rows, times, held, margins = [], defaultdict(int), [], [], [], []
                    vocabulary.default_factory = vocabulary.__len__
        if held:
            yield flush()

    return Index(materialize(docs.select("doc_id", "text").mapInArrow(run, BLOCK), "op11-index", "zstd", FILE_BLOCKS), n_docs, n_terms)


def spans(batch: pa.RecordBatch, wanted: set[bytes]) -> list[dict[bytes, int]]:
    """The rows of the wanted terms in each block of a batch."""
    return [{t: i for i, t in enumerate(terms.split(b" ")) if t in wanted} for terms in batch.column("terms").to_pylist()]


def document_counts(index: Index, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents have each wanted term."""
    schema = pa.schema([("term", pa.binary()), ("n", pa.int64())])

    def run(batches):
        total: Counter = Counter()
        for b in common.slices(batches, 4):
            for rows, counts in zip(spans(b, wanted), b.column("counts"), strict=True):
                values = counts.values.to_numpy()
                for term, row in rows.items():
                    total[term] += int(values[row])
        yield common.to_batch(schema, [list(total), list(total.values())])

    found = index.blocks.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}  # at most a round's terms


def ask(index: Index, items: list[tuple[int, Counter]], k: int) -> DataFrame:
    """place, doc_id and score of the best documents of each item (place, terms) in each task's blocks."""
    counts = document_counts(index, set().union(*(terms for _, terms in items)))
    weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in counts.items()}
    asked = [(place, {t: n * weight[t] for t, n in terms.items() if weight.get(t)}) for place, terms in items]
    schema = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        wanted = {t for _, terms in asked for t in terms}
        best: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)  # negative scores with doc_ids, in order
        for b in common.slices(batches, 1):
            rows, doc_ids = spans(b, wanted)[0], b.column("doc_ids").to_pylist()[0]
            treap = Treap.unpacked(*(b.column(c)[0].as_py() for c in ("height", "kids", "tops")))
            for place, terms in asked:
                held = [t for t in terms if t in rows]
                if not held:
                    continue
                known = best[place]
                least = -known[-1][0] if len(known) >= k else 1
                columns, scores = treap.best(np.array([rows[t] for t in held]), np.array([terms[t] for t in held], np.int64), k, least)
                found = [(-s, doc_ids[c] is None, doc_ids[c] or 0) for c, s in zip(columns.tolist(), scores.tolist(), strict=True)]
                best[place] = sorted(known + found)[:k]
        flat = [(place, None if null else doc, -s) for place, found in best.items() for s, null, doc in found]
        yield common.to_batch(schema, list(map(list, zip(*flat, strict=True))) if flat else [[], [], []])

    return index.blocks.mapInArrow(run, "place long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents of each item with the highest scores above 0.

    ``items`` has item_id and text; they come to the driver in rounds of about ITEM_BYTES.
    """
    spark, found = items.sparkSession, []
    with Workspace(spark) as w:
        asked = w.table(items.select("item_id", "text").withColumn("place", F.monotonically_increasing_id()), "op11-items")
        rounds = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES
        for i in range(rounds):
            part = asked.where(F.pmod(F.xxhash64("place"), F.lit(rounds)) == i).select("place", F.col("text").cast("binary").alias("text"))
            terms = [(r["place"], Counter(common.terms_of(bytes(r["text"] or b"")))) for r in part.collect()]
            if any(t for _, t in terms) and index.n_docs:
                found.append(w.table(ask(index, terms, k), "op11-found"))
        best = found[0] if found else spark.createDataFrame([], "place long, doc_id long, score long")
        for more in found[1:]:
            best = best.union(more)
        ranks = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = best.withColumn("rank", ranks).where(F.col("rank") <= k)
        return materialize(ranked.join(asked.select("place", "item_id"), "place").select("item_id", "rank", "doc_id", "score"), "op11-ranked")

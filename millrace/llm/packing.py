"""Operator 7: best-fit decreasing packing of token sequences.

A document longer than a window is cut into full windows and a rest. All pieces then go by descending length into the
open window whose remaining room is the tightest that holds them; if none does, into a new one. Windows that hold the
same lengths are alike, so the plan works on counts: a histogram of piece lengths goes in, and classes of windows with
their multiplicities come out. A segment tree over the remaining capacities finds the tightest class. The histogram has
at most one entry for each length, so the plan is the packing of all pieces at once, whatever their number; Spark ranks
the pieces of each length and joins them to the plan's slots.

Rules: null texts count as empty; each document ends with an id, so every one has at least one piece; lengths tie by
doc_id and place in the document (repeated documents by their content's checksum); an empty table gives no pieces;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.tokens import default_path, library_encoder
from millrace.sources.tables import materialize, shipped

WINDOW = 2048
END_ID = 1
#: Pieces of one length that are ranked together, about; a length has as many groups as its count needs, so that no length is sorted in one task.
RANKED = 20_000


class RoomTree:
    """A segment tree over remaining capacities 0..size: whether any window has it, and the least one at or above a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, room: int, present: bool) -> None:
        at = room + self.leaves
        self.any[at] = present
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int:
        """The least capacity of at least ``length`` that an open window has; -1 if none has."""
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: classes of windows (the lengths in one, in order of placing) and how many there are."""
    tree = RoomTree(window)
    open_: dict[int, list[list]] = defaultdict(list)  # by remaining room: [lengths, count]

    def add(room: int, lengths: tuple[int, ...], count: int) -> None:
        if count:
            if not open_[room]:
                tree.put(room, True)
            open_[room].append([lengths, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, fresh = window, True
                lengths, count = (), left  # as many new windows as needed, at most
            else:
                fresh = False
                lengths, count = open_[room].pop()
                if not open_[room]:
                    tree.put(room, False)
            # a window that has taken a piece is tighter than before: it takes the next ones too, as long as they fit
            fit = room // length
            full = min(count, left // fit)
            add(room - fit * length, lengths + (length,) * fit, full)
            left, count = left - full * fit, count - full
            if count and left and left < fit:
                add(room - left * length, lengths + (length,) * left, 1)
                left, count = 0, count - 1
            if not fresh:
                add(room, lengths, count)
    return [(lengths, count) for room in sorted(open_) for lengths, count in open_[room]]


def slots(classes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each run of slots alike: length, first and last-exclusive rank, slots a window, first sequence, offset."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for lengths, count in classes:
        offset, at = 0, 0
        while at < len(lengths):
            length, same = lengths[at], 1
            while at + same < len(lengths) and lengths[at + same] == length:
                same += 1
            first = next_rank[length]
            next_rank[length] += same * count
            out.append((length, first, next_rank[length], same, sequence, offset))
            offset += same * length
            at += same
        sequence += count
    return out


@shipped
def cut(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        encoder = library_encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in common.slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), common.texts_of(b), strict=True):
                packed = encoder.ids(text) + end
                total = len(packed) // 4
                rows += [(doc_id, s, min(window, total - s), zlib.crc32(packed[4 * s : 4 * (s + window)]), total) for s in range(0, total, window)]
            yield common.to_batch(schema, list(map(list, zip(*rows, strict=True))) or [[]] * 5)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long")


@shipped
def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all documents: the columns of ``cut`` and sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(cut(docs, path, window), "op7-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row for each length
    table = slots(plan(histogram, window))
    # a rank among all pieces of its length: a running count in a hashed group, and what the groups before hold
    groups = spark.createDataFrame([(k, 1 + n // RANKED) for k, n in histogram.items()], "length int, groups long")  # at most one row for each length
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("g", F.pmod(F.xxhash64("doc_id", "start"), F.col("groups"))).drop("groups")
    before = (
        dealt.groupBy("length", "g").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )  # a row for each group
    order = Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "g"]).withColumn("r", F.col("r") + F.col("before"))
    plan_schema = "length int, lo long, hi long, same long, sequence long, base long"
    spans = spark.createDataFrame(table, plan_schema)  # as long as the plan, which the number of pieces does not lengthen
    within = (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))
    placed = ranked.join(F.broadcast(spans), "length").where(within)
    at = F.col("r") - F.col("lo")
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(at / F.col("same"))).cast("long").alias("sequence_id"),
        (F.col("base") + (at % F.col("same")) * F.col("length")).cast("long").alias("offset"),
    )


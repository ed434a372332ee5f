"""Operator 4: token ids in Simple-8b words.

A 64-bit word holds a selector in its top four bits and, below it, as many ids of one width as fit 60 bits; the first id
is lowest. An id of more than 60 bits stays out of the words: its place holds 0 and the block lists it as an escape. A
block holds whole documents: their ids, how many ids each has, and how many ids of its shard come before, so that a
block is decoded on its own and all words of a selector at once.

Rules: null texts count as empty, and each document ends with id 0, so that none is without ids; documents go by
ascending doc_id with nulls first, and repeated ids by their text; texts are encoded whole; an empty table writes an
empty file; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.tokens import default_path, library_encoder
from millrace.sources.tables import materialize, shipped

#: Ids in a word and bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
END_ID = 0
BLOCK_IDS = 1 << 16


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the places and values of the escapes, of unsigned 64-bit ids.

    Each word takes as many of the next ids as any selector allows; where fewer ids are left than a selector packs, the
    word's upper slots are 0 and the block's count of ids tells how many to keep.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    escaped = np.flatnonzero(ids >> np.uint64(60))
    values = ids[escaped]
    if len(escaped):
        ids = ids.copy()
        ids[escaped] = 0
    if not n:
        return np.empty(0, np.uint64), escaped, values
    ids = np.concatenate([ids, np.zeros(60, np.uint64)])
    # each id's narrowest selector; the selectors' order goes from many narrow ids to few wide ones
    need = np.searchsorted(np.array([(1 << b) - 1 for b in BITS], np.uint64), ids).astype(np.uint8)
    pick = np.full(n, len(COUNTS) - 1, np.uint8)
    widest, span = need[: n + 59], 1
    for selector in range(len(COUNTS) - 1, -1, -1):
        while span < COUNTS[selector]:
            step = min(span, COUNTS[selector] - span)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            span += step
        pick[widest[:n] <= selector] = selector
    takes = np.array(COUNTS)[pick].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += takes[at]
    starts = np.array(starts)
    chosen = pick[starts]
    words = np.empty(len(starts), np.uint64)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        first = starts[rows]
        word = np.full(len(rows), int(selector) << 60, np.uint64)
        for slot in range(COUNTS[selector]):
            word |= ids[first + slot] << np.uint64(slot * BITS[selector])
        words[rows] = word
    return words, escaped, values


def unpack(words: np.ndarray, n: int, escaped=(), values=()) -> np.ndarray:
    """The ``n`` ids of a block; all words of a selector are decoded together."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.array(COUNTS)[chosen]
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        word, first, mask = words[rows], starts[rows], np.uint64((1 << BITS[selector]) - 1)
        for slot in range(COUNTS[selector]):
            out[first + slot] = (word >> np.uint64(slot * BITS[selector])) & mask
    out = out[:n]
    if len(escaped):
        out[np.asarray(escaped, np.int64)] = np.asarray(values, np.uint64)
    return out


FILE = "block int, part long, doc_ids array<long>, n_tokens array<int>, first long, n_ids int, words binary, escaped array<int>, escapes array<long>"


@shipped
def write(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, order and write all documents; returns the written file's blocks.

    Blocks of documents are ranges of doc_id with nearly equal counts; a task sorts its blocks and streams through them.
    """
    path = path or default_path()
    docs = docs.select("doc_id", "text")
    bounds = common.block_bounds(docs)
    schema = pa.schema(
        [("block", pa.int32()), ("part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("first", pa.int64()), ("n_ids", pa.int32()), ("words", pa.binary()), ("escaped", pa.list_(pa.int32())), ("escapes", pa.list_(pa.int64()))]
    )

    def run(batches):
        encoder = library_encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        block, part, first, held, ids, sizes = None, 0, 0, [], [], []

        def flush():
            nonlocal part, first, held, ids, sizes
            flat = np.frombuffer(b"".join(held), "<u4")
            words, escaped, values = pack(flat)
            row = [[block], [part], [ids], [sizes], [first], [len(flat)], [words.tobytes()], [escaped.tolist()], [values.astype(np.int64).tolist()]]
            part, first, held, ids, sizes = part + 1, first + len(flat), [], [], []
            return common.to_batch(schema, row)

        for b in common.slices(batches):
            for number, doc_id, text in zip(b.column("block").to_pylist(), b.column("doc_id").to_pylist(), common.texts_of(b), strict=True):
                if ids and (number != block or sum(sizes) >= BLOCK_IDS):
                    yield flush()
                if number != block:
                    block, part, first = number, 0, 0
                held.append(encoder.ids(text) + end)
                ids.append(doc_id)
                sizes.append(len(held[-1]) // 4)
        if ids:
            yield flush()

    dealt = docs.withColumn("block", common.block_of("doc_id", bounds)).repartition(common.partitions(docs), "block")
    return materialize(dealt.sortWithinPartitions("block", "doc_id", "text").mapInArrow(run, FILE), "op4-words")


@shipped
def read(blocks: DataFrame) -> DataFrame:
    """Decode a written file: doc_id, start, n_tokens, ids_crc32 of each document, in any order."""
    totals = blocks.groupBy("block").agg(F.sum("n_ids").alias("n")).collect()  # at most MAX_BLOCKS rows
    before, base = 0, {}
    for row in sorted(totals, key=lambda r: r["block"]):
        base[row["block"]], before = before, before + row["n"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in common.slices(batches, 16):
            for row in b.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), row["n_ids"], row["escaped"], np.array(row["escapes"], np.int64).astype(np.uint64))
                packed = ids.astype("<u4").tobytes()
                ends = np.cumsum(row["n_tokens"])
                starts = ends - row["n_tokens"]
                crcs = [zlib.crc32(packed[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield common.to_batch(schema, [row["doc_ids"], base[row["block"]] + row["first"] + starts, row["n_tokens"], crcs])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

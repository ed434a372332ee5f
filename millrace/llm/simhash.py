"""Operator 12: SimHash near-duplicates by bit-sliced comparison.

A text's words are its runs of other characters than ASCII white space, only A-Z lower-cased; its shingles are all runs
of four words, repeats included, joined by one space. A bit of the 64-bit fingerprint is 1 if it is set in over half of
the shingles' XXH64 values (seed 42). Documents are linked if their fingerprints differ in at most RADIUS bits.

Candidates: the bits are cut into RADIUS + SHARED pieces. Fingerprints within the radius are equal in at least SHARED of
them, so they meet in the bucket of some choice of SHARED pieces. A bucket of more than LIMIT fingerprints is not
compared; its members meet again in smaller buckets, by pieces of the bits that they may still differ in. This goes on
until all buckets are small, copies each member a fixed number of times whatever the bucket's size, and misses no link.

Comparison: a task stands the fingerprints of many buckets side by side, one bit plane for each of the 64 bits, 64
fingerprints (lanes) to a word. Each lane is held against the lane some places further in its bucket; carry-save counters
add up the planes' differences for 64 lanes at once, and a word is abandoned once all its lanes exceed the radius, belong
to other buckets or are already connected. A task returns only links that connect, fewer than it has fingerprints.

Rules: a text with fewer words than four is one shingle; null, empty and white-space texts have fingerprint 0, which is
linked like any other; each repeated row has its own row in the result; component_id is the least doc_id that is reached
and leaves out null ones (null only if all are); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import itertools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.operators import lineage
from millrace.sources.tables import Workspace, materialize

WORDS = 4
SEED = 42
RADIUS = 4
#: Equal pieces by which candidates meet.
SHARED = 3
#: Fingerprints of a bucket that a task compares.
LIMIT = 4096
#: Fingerprints that stand side by side in a task, beside the last bucket's.
LANES = 16_384
#: Words (of 64 lanes) that are compared at once.
BLOCKS = 4096


def hashes(text: bytes, size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of all shingles of a text in UTF-8."""
    words = text.translate(common.LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    parts = map(joined.__getitem__, map(slice, starts, (ends[size - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(starts))


def fingerprint(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # what a byte can count
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def prints(docs: DataFrame) -> DataFrame:
    """doc_id and print (a signed 64-bit integer) of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches):
        for b in common.slices(batches):
            found = np.array([fingerprint(hashes(t)) for t in common.bytes_of(b)], np.uint64)
            yield common.to_batch(schema, [b.column("doc_id"), pa.array(found.view(np.int64))])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long")


def pieces(fixed: int, radius: int = RADIUS, shared: int = SHARED) -> list[int]:
    """``fixed`` (a mask of 64 bits) with each choice of ``shared`` of the pieces that the other bits are cut into."""
    free = [b for b in range(64) if not fixed >> b & 1]
    parts = [sum(1 << int(b) for b in p) for p in np.array_split(free, radius + shared)]
    return sorted({fixed | sum(chosen) for chosen in itertools.combinations(parts, shared)})


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes (64, words) of unsigned fingerprints: bit i of word w of a plane is lane 64 * w + i; one further word is 0."""
    words = len(values) // 64 + 2
    bits = np.zeros((64 * words, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """The lanes whose vertical counters, least bit first, are above ``radius``, or have overflowed."""
    above, equal = over, ~np.zeros_like(over)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above, equal = above | (equal & counters[i]), equal & ~counters[i]
    return above


def near_lanes(plane: np.ndarray, words: np.ndarray, offsets: np.ndarray, alive: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """For each word and offset the lanes of ``alive`` within ``radius`` bits of the lane that is ``offset`` places further.

    Two planes' differences and the lowest counter go through one full adder; its carry ripples up. After every ``step``
    planes, words without a lane that may still be near are left out of the rest.
    """
    near, at = np.zeros_like(alive), np.flatnonzero(alive)
    words, alive = words[at], alive[at]
    ahead, shift = words + offsets[at] // 64, (offsets[at] % 64).astype(np.uint64)
    counters = [np.zeros_like(alive) for _ in range(max(1, radius.bit_length()))]
    over, top, one = np.zeros_like(alive), np.uint64(63), np.uint64(1)
    for bit in range(0, 64, 2):
        x, y = (p[words] ^ ((p[ahead] >> shift) | ((p[ahead + 1] << one) << (top - shift))) for p in plane[bit : bit + 2])
        low = counters[0]
        carry, counters[0] = (x & y) | (low & (x ^ y)), low ^ x ^ y
        for i in range(1, len(counters)):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over = over | carry
        if bit % step == step - 2:
            alive = alive & ~exceeds(counters, over, radius)
            keep = np.flatnonzero(alive)
            if len(keep) < len(alive):
                at, words, ahead, shift, alive, over = at[keep], words[keep], ahead[keep], shift[keep], alive[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(at):
                break
    near[at] = alive
    return near


class Forest:
    """Which of some numbers are connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Connect pairs one by one; the places of those that were apart. Afterwards ``root`` has each number's own root."""
        new = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                new.append(i)
        while (up := self.root[self.root]).tobytes() != self.root.tobytes():
            self.root = up
        return new


def connect(values: np.ndarray, buckets: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints within ``radius`` bits of each other that connect all such pairs of equal bucket numbers (ascending)."""
    n = len(values)
    distinct, place = np.unique(values, return_inverse=True)
    forest, plane = Forest(len(distinct)), planes(values)
    room = np.zeros(64 * (n // 64 + 1), np.int64)  # how many lanes of its bucket are behind each lane
    room[:n] = np.searchsorted(buckets, buckets, "right") - np.arange(n) - 1
    most = room.reshape(-1, 64).max(axis=1)
    words = np.repeat(np.arange(len(most)), most)
    offsets = np.arange(len(words)) - np.repeat(np.cumsum(most) - most, most) + 1
    order = np.argsort(offsets, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(order), BLOCKS):
        w, s = words[order[at : at + BLOCKS]], offsets[order[at : at + BLOCKS]]
        lanes = 64 * w[:, None] + np.arange(64)
        own = forest.root[place]
        apart = own[np.minimum(lanes, n - 1)] != own[np.minimum(lanes + s[:, None], n - 1)]
        alive = np.packbits((room[lanes] >= s[:, None]) & apart, axis=1, bitorder="little").view(np.uint64)[:, 0]
        near = near_lanes(plane, w, s, alive, radius)
        block, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a = 64 * w[block] + lane
        b = a + s[block]
        new = forest.join(place[a], place[b])
        found.append((values[a[new]], values[b[new]]))
    return tuple(np.concatenate([f[i] for f in found]) if found else values[:0] for i in (0, 1))


def compared(members: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect what is near in each bucket (fixed, value); a bucket's prints lie in one task, in order."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[np.ndarray] = []

        def link(rows: np.ndarray) -> pa.RecordBatch:
            first = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
            a, b = connect(rows[:, 2].view(np.uint64), np.concatenate([[0], np.cumsum(first)]), radius)
            return common.to_batch(schema, [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("fixed", "value", "print")], axis=1)
            held.append(rows)
            if sum(map(len, held)) >= LANES:
                rows = np.concatenate(held)
                last = int(np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))[-1]) + 1 if np.any(rows[0, :2] != rows[-1, :2]) else 0
                held = [np.ascontiguousarray(rows[last:])]
                if last:
                    yield link(np.ascontiguousarray(rows[:last]))
        if held and len(rows := np.concatenate(held)):
            yield link(rows)

    dealt = members.repartition(common.partitions(members), "fixed", "value").sortWithinPartitions("fixed", "value", "print")
    return dealt.select("fixed", "value", "print").mapInArrow(run, "a long, b long")


def links(once: DataFrame, w: Workspace, radius: int = RADIUS, shared: int = SHARED, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that connect all prints within ``radius`` bits of each other, of a table of distinct ones."""
    if limit < 2 ** (radius + 1):
        raise ValueError("limit: buckets of so few prints can't always be made")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows, masks, found = once.select(F.lit(0).cast("long").alias("fixed"), "print"), {0}, []
    while masks:
        # at most 35 of the masks before, in at most four rounds, whatever the data
        table = [(signed(f), signed(p)) for f in sorted(masks) for p in pieces(f, radius, shared)]
        choice = once.sparkSession.createDataFrame(table, "fixed long, part long")
        keyed = rows.join(F.broadcast(choice), "fixed").select(F.col("part").alias("fixed"), F.col("part").bitwiseAND(F.col("print")).alias("value"), "print")
        if found:
            keyed = keyed.distinct()  # several ways lead to a bucket
        sizes = w.table(keyed.groupBy("fixed", "value").agg(F.count("*").alias("n")).where("n > 1"), "op12-sizes")
        met = keyed.join(sizes, ["fixed", "value"])
        found.append(w.table(compared(met.where(F.col("n") <= limit), radius), "op12-links"))
        large = sizes.where(F.col("n") > limit)
        masks = {r["fixed"] % (1 << 64) for r in large.select("fixed").distinct().collect()}  # of the masks above
        if masks:
            rows = w.table(keyed.join(large, ["fixed", "value"]).select("fixed", "print").distinct(), "op12-large")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def shown(value: Column) -> Column:
    """A print as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def components(docs: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint and component_id of each row."""
    with Workspace(docs.sparkSession) as w:
        table = w.table(prints(docs), "op12-prints")
        once = w.table(table.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "op12-once")
        roots = lineage.components(links(once, w, radius, limit=limit)).withColumnRenamed("node", "print")
        least = once.join(roots, "print").groupBy("root").agg(F.min("least").alias("component_id"))
        linked = roots.join(least, "root").select("print", "component_id")
        named = w.table(once.join(linked, "print", "left").select("print", "n", F.coalesce("component_id", "least").alias("component_id")), "op12-named")
        # prints that more than a thousandth of the rows have, fewer than a thousand, are not met in a shuffle
        frequent = named.join(F.broadcast(once.agg(F.sum("n").alias("rows")))).where("n * 1000 > rows")
        told = table.join(F.broadcast(frequent.select("print", F.col("component_id").alias("known"), F.lit(True).alias("often"))), "print", "left")
        rest = told.where("often is null").select("doc_id", "print").join(named.select("print", "component_id"), "print")
        whole = told.where("often").select("doc_id", "print", F.col("known").alias("component_id")).unionByName(rest)
        return materialize(whole.select("doc_id", shown(F.col("print")).alias("fingerprint"), "component_id"), "op12-components")

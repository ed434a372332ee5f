"""Operator 3: media payloads stored as content-defined chunks.

A payload is cut where a rolling gear hash of its last 16 bytes has its low bits clear, so that equal passages give equal
chunks wherever they stand. Spark joins on the chunks' digests find the chunks that occur more than once; the earliest
document with such a chunk owns it. The store has one row for each document, a pack of the chunks that it owns, and the
recipe: the ordered list of all its chunks' digests and lengths. Each chunk is in the pack of one document only. Reading
back puts a document together from its own pack and the shared chunks that it lacks, and checks every digest.

A document's media container, whose size and digest the query gives, is its recipe: the text's byte length and, in order,
a reference (digest and length) to each chunk. Its content alone decides it, so equal texts have equal containers. The
samples themselves are in the store's packs; a container without the store can be verified, but not played.

Rules: null counts as empty, and an empty payload is padded to one unit; texts are stored whole; rows of one
doc_id and text are one document, of which each row has the same pack and is returned; an empty table gives an empty store and table;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.sources.tables import Workspace, materialize, shipped

UNIT, PAD = 576, 255
LEAST, MOST, MASK = 256, 4096, (1 << 10) - 1
#: A chunk with more than one of this many of all occurrences is frequent. There are fewer than this many such chunks, whatever the
#: input, so they may be broadcast (4 MB of samples at most); all others are joined by a shuffle, in which none is hot.
BROADCAST_ROWS = 1_000
WINDOW = 16
#: Bytes of a SHA-256 that documents and chunks meet by; recipes hold whole digests, which reading back checks.
KEY = 16


def gear() -> np.ndarray:
    """A fixed pseudo-random number for each byte value."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


GEAR = gear()


def payload(text: str) -> bytes:
    """A text's bytes, padded with 255 to a positive multiple of 576."""
    raw = text.encode()
    return raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def cuts(data: bytes) -> list[int]:
    """The ends of a payload's chunks.

    The gear hash shifts left once a byte, so its low bits at a place are a sum over the last bytes; the sums of 1, 2, 4,
    8 and 16 bytes follow from each other for all places at once.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    marks = (np.flatnonzero((h & np.uint32(MASK << 4)) == 0) + 1).tolist()
    ends, start = [], 0
    for m in [*marks, len(data)]:
        while m - start > MOST:
            start += MOST
            ends.append(start)
        if m - start >= LEAST or (m == len(data) and m > start):
            ends.append(m)
            start = m
    return ends


def chunks(text: str) -> list[bytes]:
    """A text's payload in chunks."""
    data, out, start = payload(text), [], 0
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


def features(data: bytes) -> str:
    """Integer features of 8-bit samples: count, sum, energy, crossings of the middle, and a histogram of eight ranges."""
    x = np.frombuffer(data, np.uint8)
    histogram = np.bincount(x >> 5, minlength=8)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    energy = int((x.astype(np.int64) ** 2).sum())
    return f"n={len(x)};sum={int(x.sum(dtype=np.int64))};energy={energy};crossings={crossings};hist=" + "-".join(map(str, histogram.tolist()))


def recipe_bytes(digests: list[bytes], lengths: list[int], n_bytes: int) -> bytes:
    """The stored form: the text's byte length, then each chunk's digest and length."""
    return n_bytes.to_bytes(8, "little") + b"".join(d + n.to_bytes(4, "little") for d, n in zip(digests, lengths, strict=True))


def digest_rows(docs: DataFrame) -> DataFrame:
    """key, seq and digest (KEY bytes) of each chunk; key is the document's."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for b in common.slices(batches):
            rows = [(k, d, i, hashlib.sha256(c).digest()[:KEY]) for k, d, t in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), common.texts_of(b), strict=True) for i, c in enumerate(chunks(t))]
            yield common.to_batch(schema, list(map(list, zip(*rows, strict=True))) or [[]] * 4)

    return docs.mapInArrow(run, "key binary, doc_id long, seq int, digest binary")


STORE = "key binary, doc_id long, recipe binary, n_bytes long, own array<struct<seq:int,shared:boolean,data:binary>>, missing array<struct<seq:int,digest:binary>>"


def frequent(counts: DataFrame, total: int) -> DataFrame:
    """digest of the chunks with more than one in BROADCAST_ROWS of all ``total`` occurrences; fewer than BROADCAST_ROWS."""
    return counts.where(F.col("n") * BROADCAST_ROWS > total).select("digest")


def by_digest(rows: DataFrame, chunks: DataFrame, often: DataFrame) -> DataFrame:
    """``rows`` with what ``chunks`` has of their digests: the ``often`` ones by a broadcast, so that none is one task's, the rest by a shuffle."""
    hot, cold = (chunks.join(F.broadcast(often), "digest", how) for how in ("left_semi", "left_anti"))
    rest = rows.join(F.broadcast(often), "digest", "left_anti").join(cold.hint("merge"), "digest")
    return rows.join(F.broadcast(hot), "digest").unionByName(rest)


def bodies(docs: DataFrame) -> DataFrame:
    """key, doc_id and the whole text, compressed for its way through a shuffle."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("body", pa.binary())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=6)
        for b in common.slices(batches):
            yield common.to_batch(schema, [b.column("key"), b.column("doc_id"), [press.compress(t.encode()) for t in common.texts_of(b)]])

    return docs.mapInArrow(run, "key binary, doc_id long, body binary")


@shipped
def write(docs: DataFrame) -> DataFrame:
    """Store all documents; returns the store's rows, one for each distinct document.

    A document's row needs to know which of its chunks are repeated elsewhere and which of these it owns. That list is as
    long as the input has repeated chunks, so it meets the compressed texts in a shuffle, at every size.
    """
    docs = keyed(docs)
    with Workspace(docs.sparkSession) as w:
        seen = w.table(digest_rows(docs), "op3-seen")
        first = F.min(F.struct("doc_id", "key", "seq")).alias("owner")
        repeated = w.table(seen.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "owner.key", "owner.seq", "n").toDF("digest", "owner", "place", "n"), "op3-owners")
        owned = (F.col("owner") == F.col("key")) & (F.col("place") == F.col("seq"))
        met = by_digest(seen, repeated.drop("n"), frequent(repeated, seen.count()))
        marks = w.table(met.groupBy("key").agg(F.collect_set(F.struct("seq", owned.alias("owned"))).alias("marks")), "op3-marks")  # a text's own chunks
        w.drop(seen, repeated)
        joined = bodies(docs).join(marks.hint("merge"), "key", "left")
        return materialize(joined.select("key", "doc_id", "body", "marks").mapInArrow(packs, STORE), "op3-packs", "zstd")


def packs(batches):
    """The store's rows of compressed texts with their marks."""
    schema = pa.schema(
        [("key", pa.binary()), ("doc_id", pa.int64()), ("recipe", pa.binary()), ("n_bytes", pa.int64()), ("own", pa.list_(pa.struct([("seq", pa.int32()), ("shared", pa.bool_()), ("data", pa.binary())]))), ("missing", pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary())])))]
    )

    press = zstandard.ZstdDecompressor()
    for b in common.slices(batches):
        out = []
        for key, doc_id, body, found in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "body", "marks")), strict=True):
            text = press.decompress(body).decode()
            parts = chunks(text)
            digests = [hashlib.sha256(c).digest() for c in parts]
            shared = {m["seq"]: m["owned"] for m in found or []}
            # a chunk repeated within the owner is kept at its first place; the owner's later places lack it like others do
            own = [{"seq": i, "shared": i in shared, "data": c} for i, c in enumerate(parts) if shared.get(i, True)]
            missing = [{"seq": i, "digest": digests[i][:KEY]} for i, mine in shared.items() if not mine]
            n = len(text.encode())
            out.append((key, doc_id, recipe_bytes(digests, list(map(len, parts)), n), n, own, missing))
        yield common.to_batch(schema, list(map(list, zip(*out, strict=True))) or [[]] * 6)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key of their doc_id and text, 128 bits of a SHA-256."""
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))
    return docs.select(F.substring(key, 1, KEY).alias("key"), "doc_id", "text")


@shipped
def read(store: DataFrame) -> DataFrame:
    """Put every stored payload together, verify it, and compute its columns; a row for each row of the store."""
    lacking = F.size("missing") > 0
    whole = assemble(store.where(~lacking).select("doc_id", "recipe", "n_bytes", "own"))
    wanted = store.where(lacking).select("key", F.explode("missing").alias("m")).select("key", "m.seq", "m.digest")
    offered = store.select(F.explode(F.filter("own", lambda c: c["shared"])).alias("c")).select(F.substring(F.unhex(F.sha2("c.data", 256)), 1, KEY).alias("digest"), "c.data").dropDuplicates(["digest"])
    often = materialize(frequent(wanted.groupBy("digest").agg(F.count("*").alias("n")), wanted.count()), "op3-frequent")
    got = by_digest(wanted, offered, often).groupBy("key").agg(F.collect_set(F.struct("seq", F.lit(True).alias("shared"), "data")).alias("got"))  # a text's own chunks
    parts = store.where(lacking).join(got, "key").select("doc_id", "recipe", "n_bytes", F.concat("own", "got").alias("own"))
    return whole.unionByName(assemble(parts))


def assemble(parts: DataFrame) -> DataFrame:
    """The columns of payloads whose chunks are all at hand."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int64())]
    )

    def run(batches):
        for b in common.slices(batches, 64):
            out = []
            for r in b.to_pylist():
                recipe = r["recipe"]
                listed = [(recipe[i : i + 32], int.from_bytes(recipe[i + 32 : i + 36], "little")) for i in range(8, len(recipe), 36)]
                data = [c["data"] for c in sorted(r["own"], key=lambda c: c["seq"])]
                if [(hashlib.sha256(c).digest(), len(c)) for c in data] != listed:
                    raise ValueError(f"stored chunks of document {r['doc_id']} do not match its recipe")
                whole = b"".join(data)
                out.append((r["doc_id"], r["n_bytes"], len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(recipe), hashlib.sha256(recipe).hexdigest(), features(whole), len(listed)))
            yield common.to_batch(schema, list(map(list, zip(*out, strict=True))))

    return parts.mapInArrow(run, names)

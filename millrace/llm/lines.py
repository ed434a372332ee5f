"""Operator 2: line dedup by a deletion-neighbourhood join.

A line goes if an earlier one, by doc_id and place, is equal to it or within one edit of it (a character put in, left out
or replaced), whether or not the earlier line itself stays. Equal lines meet by their SHA-256. For the others, a line's
variants are the line with one character left out. Two lines of one length are within one edit if they share a variant
made at the same place; a line and one that is a character shorter are if the shorter is a variant of the longer. So
each key's group needs only its earliest line, not its pairs, and what the hashes claim is verified on the lines.

Long lines have as many variants as characters, so variants are made only where they can matter: lines within one edit
agree in their first or in their last half. Lines that share neither half with another line make no variants, and the
others only in the half that differs.

64-bit hashes only find candidates, which are verified on the lines.

Rules: null texts stay null; blank lines stay; lines shorter than ``least`` characters (LEAST unless given; 1 compares
all) only go if they equal an earlier line; lines and texts of any length are handled whole; a null doc_id counts as the
least; rows that agree in doc_id and text count as one document and keep the same lines; a document keeps its row even if all its lines go; an empty table
gives an empty table; all other columns, of any names, stay as they are, but for n_chars, which follows the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.sources.tables import Workspace, materialize, shipped

LEAST = 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def row_key() -> Column:
    """Two hashes of the text, which tell apart rows of one doc_id."""
    return F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))


def line_hash(line: str) -> Column:
    """What equal lines are known by; a cryptographic digest, as the later of two lines that agree in it goes unseen."""
    return F.unhex(F.sha2(line, 256))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of the row among those of its doc_id."""
    return docs.select("doc_id", "text", row_key().alias("rk"))


def lines_of(docs: DataFrame) -> DataFrame:
    """at (doc_id, rk, no), h and line of every line that isn't blank."""
    rows = docs.select("doc_id", "rk", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.col("line").rlike(r"[^ \t\r]"))
    return rows.select(F.struct("doc_id", "rk", "no").alias("at"), line_hash("line").alias("h"), "line")


def half_keys(least: int = LEAST) -> list[Column]:
    """A line's half keys k0 to k3: k0 and k1 are its first and last half as the longer or an equally long line, k2 and k3 as the shorter; null for lines shorter than ``least``."""

    def pair(length):
        ahead = F.floor((length - 1) / 2).cast("int")
        behind = (length - 1 - ahead).cast("int")
        head = F.xxhash64(F.lit("head"), length, F.substring("line", F.lit(1), ahead))
        tail = F.xxhash64(F.lit("tail"), length, F.substring("line", F.length("line") - behind + 1, behind))
        return head, tail

    keys = (*pair(F.length("line")), *pair(F.length("line") + 1))
    return [F.when(F.length("line") >= least, k).alias(f"k{n}") for n, k in enumerate(keys)]


def variant_hashes(line: str, first: int, last: int) -> np.ndarray:
    """Polynomial hashes of a line without its character at first..last-1."""
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.ones(n + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(n, BASE))
        before = np.concatenate([[np.uint64(0)], np.cumsum(c[:-1] * power[: n - 1][::-1])]) if n > 1 else np.zeros(1, np.uint64)
        after = np.cumsum(c * power[:n][::-1])
        out = before + (after[-1] - after)
    return common.mix64(out[first:last])


def whole_hash(line: str) -> int:
    """The hash that a variant equal to this line has."""
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(c) - 1, BASE))]) if len(c) > 1 else np.ones(len(c), np.uint64)
        return int(common.mix64(np.array([(c * power[::-1]).sum()], np.uint64)).view(np.int64)[0])


def within_one(x: str, y: str) -> bool:
    """Whether two strings are within one edit."""
    if abs(len(x) - len(y)) > 1:
        return False
    short, long_ = sorted((x, y), key=len)
    low, high = 0, len(short)
    while low < high:  # the longest common beginning, by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if short[:mid] == long_[:mid] else (low, mid - 1)
    return short[low:] == long_[low + 1 :] or short[low + 1 :] == long_[low + 1 :]


def candidates(docs: DataFrame, firsts: DataFrame, w: Workspace) -> DataFrame:
    """c, h, at, line and parts (which half keys another line shares) of the distinct lines that share a half with another line.

    Each distinct line has one row, so no line is frequent here, and the keys are counted before they meet. The texts come
    from the documents of the lines' earliest places. Both joins are shuffles at every size, whatever the sides' sizes.
    """
    keys = firsts.where("k0 is not null").select("c", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("part", "key"))
    met = keys.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    hit = keys.join(met.hint("merge"), "key", "left_semi").groupBy("c").agg(F.collect_set("part").alias("parts"))
    marked = w.table(firsts.select("c", "h", "at").join(hit, "c"), "op2-marked")
    spots = F.collect_list(F.struct("c", F.col("at.no").alias("no"))).alias("spots")  # one document's lines
    wanted = marked.groupBy(F.col("at.doc_id").alias("id"), F.col("at.rk").alias("row")).agg(spots)
    match = docs["doc_id"].eqNullSafe(wanted["id"]) & (docs["rk"] == wanted["row"])
    schema = pa.schema([("c", pa.int64()), ("line", pa.string())])

    def pick(batches):
        for b in common.slices(batches):
            got = [(s["c"], parts[s["no"]]) for parts, spots in ((t.split("\n"), x) for t, x in zip(common.texts_of(b), b.column("spots").to_pylist(), strict=True)) for s in spots]
            yield common.to_batch(schema, [[c for c, _ in got], [x for _, x in got]])

    picked = docs.join(wanted.hint("merge"), match).select("text", "spots").mapInArrow(pick, "c long, line string")
    found = picked.groupBy("c").agg(F.first("line").alias("line"))  # repeated rows give a line again
    return w.table(marked.join(found, "c"), "op2-candidates")


def variants(found: DataFrame) -> DataFrame:
    """v, place and c: the variants of the candidates, and with place -1 the lines themselves."""
    schema = pa.schema([("v", pa.int64()), ("place", pa.int32()), ("c", pa.int64())])

    def run(batches):
        for b in common.slices(batches):
            for c, line, parts in zip(b.column("c").to_pylist(), common.texts_of(b, "line"), b.column("parts").to_pylist(), strict=True):
                n, parts = len(line), set(parts)
                if parts & {2, 3}:
                    yield common.to_batch(schema, [[whole_hash(line)], [-1], [c]])
                # where the first half is shared, the edit is behind it, and the other way round
                ahead = (n - 1) // 2
                first, last = (0 if 1 in parts else ahead), (n if 0 in parts else ahead + 1)
                if parts & {0, 1}:
                    made = variant_hashes(line, first, last).view(np.int64)
                    yield common.to_batch(schema, [pa.array(made), pa.array(np.arange(first, last, dtype=np.int32)), pa.array(np.full(len(made), c))])

    return found.mapInArrow(run, "v long, place int, c long")


def near_lines(docs: DataFrame, firsts: DataFrame, w: Workspace) -> DataFrame:
    """h of the lines that have an earlier line within one edit."""
    found = candidates(docs, firsts, w)
    order = found.select("c", "at")
    made = w.table(variants(found), "op2-variants")
    # one length: all lines of a variant and place are within one edit of each other, so the earliest removes the rest
    changed = made.where("place >= 0")
    crowd = changed.groupBy("v", "place").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v", "place")
    met = w.table(changed.join(crowd, ["v", "place"]).join(order, "c"), "op2-met")
    star = met.groupBy("v", "place").agg(F.min(F.struct("at", "c")).alias("first")).select("v", "place", F.col("first.c").alias("by"))
    claims = met.join(star, ["v", "place"]).where(F.col("c") != F.col("by")).select("c", "by")
    # one character more or less: of a variant and the line that equals it, the later goes
    whole = made.where("place < 0").select("v", F.col("c").alias("w_c"))
    longer = changed.select("v", "c").join(whole, "v").where(F.col("c") != F.col("w_c")).select("c", "w_c").distinct()
    longer = longer.join(order, "c").join(order.select(F.col("c").alias("w_c"), F.col("at").alias("w_at")), "w_c")
    later = F.col("at") > F.col("w_at")
    claims = claims.union(longer.select(F.when(later, F.col("c")).otherwise(F.col("w_c")), F.when(later, F.col("w_c")).otherwise(F.col("c")))).distinct()
    schema = pa.schema([("c", pa.int64())])

    def check(batches):
        for b in common.slices(batches):
            kept = [c for c, x, y in zip(b.column("c").to_pylist(), common.texts_of(b, "x"), common.texts_of(b, "y"), strict=True) if within_one(x, y)]
            yield common.to_batch(schema, [kept])

    of = lambda key, text: found.select(F.col("c").alias(key), F.col("line").alias(text))
    near = claims.join(of("c", "x"), "c").join(of("by", "y"), "by").select("c", "x", "y").mapInArrow(check, "c long").distinct()
    return w.table(near.join(found.select("c", "h"), "c").select("h"), "op2-near")


def removals(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, rk and the numbers of the lines that go, of each document with any; ``docs`` as ``keyed`` gives them."""
    names = ("k0", "k1", "k2", "k3")
    with Workspace(docs.sparkSession) as w:
        placed = w.table(lines_of(docs).select("h", "at", *half_keys(least)), "op2-placed")  # read twice, so that texts are split and hashed once for both
        grouped = placed.groupBy("h").agg(F.min("at").alias("at"), (F.min("at") != F.max("at")).alias("again"), *(F.min(k).alias(k) for k in names))
        firsts = w.table(grouped.withColumn("c", F.monotonically_increasing_id()), "op2-firsts")
        near = near_lines(docs, firsts, w).withColumn("near", F.lit(True))
        gone = firsts.join(near, "h", "left").where("again or near").select("h", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
        hit = placed.join(gone, "h").where(F.col("near") | (F.col("at") != F.col("first")))
        listed = hit.groupBy("at.doc_id", "at.rk").agg(F.collect_set("at.no").alias("gone"))  # one document's lines
        return materialize(listed, "op2-removals")


@shipped
def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones; its columns, and __lines and __gone, how many lines a text had and lost.

    Where the table has columns of these names, the two get further underscores in front. ``least`` is the length from which on
    lines are compared by edits: one edit in a list mark, a year or a name mostly makes another line.
    """
    names = docs.columns
    lines_name, gone_name = common.fresh(names, "__lines"), common.fresh(names, "__gone")
    keys = removals(keyed(docs), least)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key().alias("rk"))
    match = rows["id"].eqNullSafe(keys["doc_id"]) & (rows["rk"] == keys["rk"])
    joined = rows.join(keys, match, "left").select("row.*", keys["gone"].alias(gone_name))
    schema = docs.select("*", F.lit(0).cast("long").alias(lines_name), F.lit(0).cast("long").alias(gone_name)).schema

    def run(batches):
        for b in common.slices(batches):
            columns = {n: b.column(n) for n in names}
            texts, total, lost = b.column("text").to_pylist(), [], []
            sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
            for i, gone in enumerate(b.column(gone_name).to_pylist()):
                parts = texts[i].split("\n") if texts[i] is not None else []
                gone = set(gone or ())
                total.append(len(parts))
                lost.append(len(gone))
                if gone:
                    texts[i] = "\n".join(p for n, p in enumerate(parts) if n not in gone)
                    if sizes:
                        sizes[i] = len(texts[i])
            columns["text"] = pa.array(texts, b.column("text").type)
            if sizes:
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            columns |= {lines_name: pa.array(total, pa.int64()), gone_name: pa.array(lost, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(run, schema)

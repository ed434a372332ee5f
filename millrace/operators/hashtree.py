"""Hash trees over tables of any size: one fingerprint, and where two tables differ.

A row's place is its own SHA-256, so that leaves are equally full whatever the keys; repeats are counted before anything is
listed. The tree has as many levels as the number of distinct rows needs for leaves of about ``leaf`` rows; a node lists at
most 16 children. Two trees are compared from the root down: only children of unequal nodes are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import canonical as C
from millrace.sources.tables import Workspace, materialize

LEAF = 4096
#: The deepest level at which ``differing`` sums rows: 4,096 nodes, whatever the tables.
NODES = 3
#: Differing rows up to which 8 bytes of each are broadcast to leave out other rows; of more, all rows are joined by a shuffle.
FEW = 1 << 21


@dataclass
class Tree:
    """rows: digest and n of the distinct rows; levels: node (a digest's first hex digits) and hash of each level's nodes, from the root on."""

    rows: DataFrame
    count: int
    levels: list[DataFrame]


def row_digest(columns: list[str]) -> Column:
    """The SHA-256 of a row's columns, any of which may be null; values count as their texts."""
    return C.digest(C.record(*(C.nullable(c, F.col(f"`{c}`").cast("string")) for c in columns)))


def depth_for(count: int, leaf: int = LEAF) -> int:
    """Levels below the root, so that leaves have ``leaf`` rows or fewer on average."""
    depth = 0
    while count > leaf * 16**depth:
        depth += 1
    return depth


def digests(table: DataFrame, columns: list[str], w: Workspace) -> tuple[DataFrame, int]:
    """digest and n of the distinct rows, written, and how many there are."""
    rows = w.table(table.select(row_digest(columns).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")), "digests")
    return rows, rows.count()


def build(rows: DataFrame, count: int, depth: int, w: Workspace) -> Tree:
    """The tree of this depth; each level is written and made from the one below it."""
    own = F.concat("digest", F.lit(":"), F.col("n").cast("string"))
    members = F.array_join(F.array_sort(F.collect_list("member")), ",")
    low = rows.select(F.substring("digest", 1, depth).alias("node"), own.alias("member"))
    levels = [w.table(low.groupBy("node").agg(F.sha2(members, 256).alias("hash")), "leaves")]
    for d in range(depth - 1, -1, -1):
        up = levels[0].select(F.substring("node", 1, d).alias("node"), F.concat("node", F.lit(":"), "hash").alias("member"))
        levels.insert(0, w.table(up.groupBy("node").agg(F.sha2(members, 256).alias("hash")), "nodes"))
    return Tree(rows, count, levels)


def tree_fingerprint(table: DataFrame, columns: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """fingerprint, rows (distinct ones) and depth of a table, one row; equal for equal rows in any order, repeats counted.

    The root's hash is null for an empty table. ``leaf`` is part of the value.
    """
    with Workspace(table.sparkSession) as w:
        rows, count = digests(table, columns or table.columns, w)
        depth = depth_for(count, leaf)
        root = build(rows, count, depth, w).levels[0]
        told = root.agg(F.max("hash").alias("fingerprint")).select("fingerprint", F.lit(count).cast("long").alias("rows"), F.lit(depth).alias("depth"))
        return materialize(told, "tree")


def unequal_leaves(left: Tree, right: Tree, w: Workspace) -> DataFrame:
    """The leaves (node) in which two trees of one depth differ; only children of nodes that differ are compared."""
    open_ = None
    for a, b in zip(left.levels, right.levels, strict=True):
        if open_ is not None:
            inside = F.expr("substring(node, 1, length(node) - 1)")
            a, b = (t.withColumn("parent", inside).join(open_.select(F.col("node").alias("parent")), "parent", "left_semi").drop("parent") for t in (a, b))
        met = a.join(b.select("node", F.col("hash").alias("other")), "node", "full")
        open_ = w.table(met.where("not hash <=> other").select("node"), "unequal")
    return open_


def unequal_nodes(sides: list[DataFrame], depth: int, w: Workspace) -> DataFrame:
    """The nodes (node) of this depth below which two tables' rows (digest) differ, told by counts and sums of hashes of the digests.

    A task sums its rows before anything is sent, so what is sent grows with tasks and nodes, not with rows.
    """
    hashes = [F.xxhash64(F.lit(i), "digest") for i in (1, 2)]
    words = [x for h in hashes for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]  # 32 bits: no sum overflows
    sums = [F.struct(F.count("*"), *(F.sum(x) for x in words)).alias("told")]
    a, b = (t.groupBy(F.substring("digest", 1, depth).alias("node")).agg(*sums) for t in sides)
    met = a.join(b.withColumnRenamed("told", "other"), "node", "full")
    return w.table(met.where("not told <=> other").select("node"), "unequal")


def differing(left: DataFrame, right: DataFrame, columns: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """The rows that two tables don't have equally often, with n_left and n_right (J6, W9): ``exceptAll`` both ways, counted.

    ``columns`` (all of left's where none are given) are what is compared and returned; both tables have them. Columns named
    n_left or n_right are refused. Both tables are at hand, so no tree is written: the nodes of one level, NODES deep at most and
    with ``leaf`` rows or more, are compared by sums, and only the digests below unequal ones are sent, once, in 32 bytes. Rows are read
    in full only where they differ.
    """
    columns = columns or left.columns
    if taken := {"n_left", "n_right"} & set(columns):
        raise ValueError(f"the tables already have {sorted(taken)}")
    with Workspace(left.sparkSession) as w:
        depth = min(depth_for(max(t.count() for t in (left, right)), leaf), NODES)
        sides = [t.select(row_digest(columns).alias("digest")) for t in (left, right)]
        open_ = F.broadcast(unequal_nodes(sides, depth, w))  # 16^NODES rows at most
        ones = [(F.lit(x).cast("long").alias("n_left"), F.lit(y).cast("long").alias("n_right")) for x, y in ((1, 0), (0, 1))]
        inside = [t.withColumn("node", F.substring("digest", 1, depth)).join(open_, "node", "left_semi").select(F.unhex("digest").alias("digest"), *n) for t, n in zip(sides, ones, strict=True)]
        met = inside[0].union(inside[1]).groupBy("digest").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
        gone = w.table(met.where("n_left <> n_right"), "differing")
        few = gone.count() <= FEW
        named = {c: f"c{i}" for i, c in enumerate(columns)}  # columns may be called digest
        slim = [t.select(F.unhex(row_digest(columns)).alias("digest"), *(F.col(f"`{c}`").alias(n) for c, n in named.items())) for t in (left, right)]
        if few:  # most rows go before they are sent
            short = F.broadcast(gone.select(F.xxhash64("digest").alias("short")).distinct())
            slim = [t.withColumn("short", F.xxhash64("digest")).join(short, "short", "left_semi").drop("short") for t in slim]
        slim = [t.join(gone.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]) for t in slim]
        whole = slim[0].union(slim[1]).dropDuplicates(["digest"])
        return materialize(whole.join(gone, "digest").select(*(F.col(n).alias(c) for c, n in named.items()), "n_left", "n_right"), "differing-rows")

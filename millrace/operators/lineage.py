"""File records, their lineages and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.validators import checked_count
from millrace.sources.tables import Workspace, materialize

FLAGS = ("is_committed", "is_staged", "is_unstaged", "is_untracked", "is_conflicted")


def union_file_records(committed: DataFrame, working: DataFrame) -> DataFrame:
    """Committed changes and working-tree entries that aren't ignored, repeats kept."""
    no = F.lit(False)
    left = committed.select("path", "original_path", F.lit(True).alias("is_committed"), *(no.alias(f) for f in FLAGS[1:]))
    right = working.where(~F.col("is_ignored")).select("path", "original_path", no.alias("is_committed"), *FLAGS[1:])
    return left.unionByName(right)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and root, the least node that it is connected to (G1); edges are a, b, and further nodes a column node.

    Rounds of contraction: each node hooks to the neighbour of least rank, if that is below its own, follows that one's
    hook, and gives way to it in all edges. Ranks are a fresh hash in each round, so that no order of the nodes makes
    long chains of hooks, and about half of the nodes or more go each time: the rounds grow with the logarithm of the
    nodes, on chains in any order too. What a round reads is written to the shared folder, and deleted after the next.
    """
    edges = edges.select("a", "b")
    with Workspace(edges.sparkSession) as w:
        tidy = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null")
        label = w.table((ends if nodes is None else ends.union(nodes.select("node"))).distinct().withColumn("root", F.col("node")), "nodes")
        left, hooks = w.table(tidy(edges), "edges"), []
        while left.limit(1).count():
            rank = lambda c, n=len(hooks): F.struct(F.xxhash64(F.lit(n), c), F.col(c))
            both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
            least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            up = w.table(least.select(F.col("a").alias("node"), F.when(F.col("m") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("up")), "hooks")
            after = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            hop = lambda df, after=after: df.join(after, "up").select("node", F.col("next").alias("up"))
            hook = w.table(hop(hop(up)), "hooks")
            moved = [hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b")]
            rest = w.table(tidy(left.join(moved[0], "a").join(moved[1], "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))), "edges")
            w.drop(left, up)
            left = rest
            hooks.append(hook)
        for hook in hooks:
            label = label.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        label = w.table(label, "labels")
        least = label.groupBy("root").agg(F.min("node").alias("least"))
        return materialize(label.join(least, "root").select("node", F.col("least").alias("root")), "components")


def lineages(records: DataFrame) -> DataFrame:
    """Records with the root of their lineage; renames connect the old path with the new."""
    edges = records.where("original_path is not null").select(F.col("original_path").alias("a"), F.col("path").alias("b"))
    roots = components(edges, records.select(F.col("path").alias("node")))
    return records.join(roots.withColumnRenamed("node", "path"), "path")


def distinct_counts(df: DataFrame, key: str, predicates: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Distinct keys under each predicate, in one pass: a row for each key first, then a row for the group (A1)."""
    keys = df.groupBy(*(by or []), key).agg(*(F.bool_or(F.coalesce(p, F.lit(False))).alias(n) for n, p in predicates.items()))
    return keys.groupBy(*(by or [])).agg(*(F.count_if(n).alias(n) for n in predicates))


def file_summary(records: DataFrame) -> DataFrame:
    """The six counts of lineages (A1), as 32-bit integers."""
    counts = distinct_counts(
        lineages(records), "root",
        {"changed": F.lit(True), "uncommitted": ~F.col("is_committed"), "staged": F.col("is_staged"), "unstaged": F.col("is_unstaged"), "untracked": F.col("is_untracked"), "conflicted": F.col("is_conflicted")},
    )
    return counts.select(*(checked_count(F.col(c)).alias(c) for c in counts.columns))


def readiness(conflicted: Column, own_commits: Column, changed: Column) -> Column:
    """conflicts, empty or ready."""
    return F.when(conflicted > 0, "conflicts").when((own_commits == 0) & (changed == 0), "empty").otherwise("ready")


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys that occur more than once, and how often (A3)."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def zero_filled_counts(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each approved key with its number of rows, 0 included (A4); the rows are counted before they are joined."""
    return keys.select(key).join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def limitation_count(steps: DataFrame) -> DataFrame:
    """Steps of each run that succeeded with limitations, null for none."""
    return steps.groupBy("run_id").agg(F.nullif(F.count_if(F.col("state") == "succeededWithLimitations"), F.lit(0)).alias("limitation_count"))

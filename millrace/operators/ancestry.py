"""Histories as graphs of commits: which are ahead or behind, and the best common ancestors of two tips.

The commits are dealt into chains, each an unbroken run of first parents. What a tip reaches of a chain is always its beginning,
up to some commit, so a tip's whole history is one position for each chain that it touches: counts are sums of differences
of positions, and a common history takes the lesser of two positions. No table holds a row for a tip and each ancestor of it.

All joins are merges: every round would send a table through the driver again if it were broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import Workspace, materialize

PART = 4096  #: exits of a chain that meet its tips in one task


def _first_parents(commits: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """All edges (node, parent), once each, and all nodes with up, their first parent or null; parents that aren't listed have none."""
    listed = commits.where("commit is not null")
    edges = w.table(listed.where("parent is not null").groupBy(F.col("commit").alias("node"), "parent").agg(F.min("n").alias("n")), "edges")
    first = edges.groupBy("node").agg(F.min_by("parent", F.struct("n", "parent")).alias("up"))
    every = listed.select(F.col("commit").alias("node")).union(edges.select("parent")).distinct()
    return edges.select("node", "parent"), w.table(every.join(first.hint("merge"), "node", "left"), "nodes")


def _round(state: DataFrame, rounds: int, n: int) -> bool:
    """Whether some pointer of the state has more to go; in a cycle there would always be one."""
    if not state.where("ptr is not null").limit(1).count():
        return False
    if 1 << rounds > n:
        raise ValueError("the first parents of some commits form a cycle")
    return True


def _sizes(nodes: DataFrame, w: Workspace) -> DataFrame:
    """node, up, size: how many commits go back to it by first parents, itself included.

    In round k a commit knows those less than 2^k steps above it, and its ancestor 2^k steps below, to which it adds them.
    """
    n, rounds = nodes.count(), 0
    state = w.table(nodes.select("node", "up", F.col("up").alias("ptr"), F.lit(1).cast("long").alias("size")), "sizes")
    while _round(state, rounds, n):
        more = state.where("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(F.sum("size").alias("more"))
        hops = state.where("ptr is not null").select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
        moving = state.where("ptr is not null").join(hops.hint("merge"), "ptr", "left").select("node", "up", F.col("next").alias("ptr"), "size")
        rest = state.where("ptr is null").select("node", "up", "ptr", "size")
        grown = moving.union(rest).join(more.hint("merge"), "node", "left").select("node", "up", "ptr", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        after = w.table(grown, "sizes")
        w.drop(state)
        state, rounds = after, rounds + 1
    return state.drop("ptr")


def chains(nodes: DataFrame, w: Workspace) -> DataFrame:
    """node, chain (the commit that it begins with) and pos, from 1, of each commit (node, up).

    A chain goes on with the child of which the most commits come, so that a way along first parents leaves a chain at most
    log2(commits) times. Every chain's commits are followed to its beginning by hops that double; those still on their way all hop to different commits.
    """
    sizes = _sizes(nodes, w)
    heirs = sizes.where("up is not null").groupBy("up").agg(F.max_by("node", F.struct("size", "node")).alias("heir"))
    linked = nodes.join(heirs.select(F.col("heir").alias("node"), F.col("up").alias("ptr")).hint("merge"), "node", "left")
    begins = F.col("ptr").isNull()
    state = w.table(linked.select("node", "ptr", F.when(begins, F.col("node")).alias("chain"), F.when(begins, 0).otherwise(1).cast("long").alias("far")), "chains")
    n, rounds = nodes.count(), 0
    while _round(state, rounds, n):
        below = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("chain").alias("found"), F.col("far").alias("further"))
        moved = state.where("ptr is not null").drop("chain").join(below.hint("merge"), "ptr").select("node", F.col("next").alias("ptr"), F.col("found").alias("chain"), (F.col("far") + F.col("further")).alias("far"))
        after = w.table(state.where("ptr is null").union(moved), "chains")
        w.drop(state)
        state, rounds = after, rounds + 1
    return w.table(state.select("node", "chain", (F.col("far") + 1).alias("pos")), "places")


def _exits(edges: DataFrame, places: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """Edges between chains (chain, pos, target, lands, part), and the number of parts of each chain with many of them."""
    child = places.withColumnRenamed("node", "commit")
    parent = places.select(F.col("node").alias("parent"), F.col("chain").alias("target"), F.col("pos").alias("lands"))
    found = w.table(edges.withColumnRenamed("node", "commit").join(child.hint("merge"), "commit").join(parent.hint("merge"), "parent").where("chain <> target").groupBy("chain", "target", "lands").agg(F.min("pos").alias("pos")), "exits")
    parts = w.table(found.groupBy("chain").agg(F.ceil(F.count("*") / PART).alias("parts")), "parts")
    dealt = found.join(parts.hint("merge"), "chain").select("chain", "pos", "target", "lands", F.pmod(F.xxhash64("target", "lands"), "parts").alias("part"))
    return w.table(dealt, "exits"), parts


def _leave(found: DataFrame, key: list[str], exits: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Where the exits of positions (key, chain, pos, and before: up to where exits are known) land: key, chain, pos, the furthest of each chain.

    A chain with many exits is asked in parts, so no task has a chain's tips times all its exits.
    """
    asked = found.join(exits[1].hint("merge"), "chain").select(*key, "chain", F.col("pos").alias("to"), "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    out = asked.join(exits[0].hint("merge"), ["chain", "part"]).where("pos <= to and pos > before")
    return out.groupBy(*key, F.col("target").alias("chain")).agg(F.max("lands").alias("pos"))


def reach(tips: DataFrame, places: DataFrame, exits: tuple[DataFrame, DataFrame], w: Workspace) -> DataFrame:
    """tip, chain, pos: how far each tip (tip) reaches into every chain of its history, itself included.

    Each round follows the exits that the round before came upon; the rounds are as many as chains on a shortest way at most.
    """
    known = w.table(tips.join(places.withColumnRenamed("node", "tip").hint("merge"), "tip").select("tip", "chain", "pos"), "reach")
    fresh = w.table(known.withColumn("before", F.lit(0).cast("long")), "fresh")
    while fresh.limit(1).count():
        old = known.withColumnRenamed("pos", "before")
        landed = _leave(fresh, ["tip"], exits).join(old.hint("merge"), ["tip", "chain"], "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
        after = w.table(landed.where("pos > before").select("tip", "chain", "pos", "before"), "fresh")
        both = w.table(known.union(after.drop("before")).groupBy("tip", "chain").agg(F.max("pos").alias("pos")), "reach")
        w.drop(known, fresh)
        known, fresh = both, after
    return known


def compare_tips(commits: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (left, right, ahead, behind, bases) of each pair of tips, and every best common ancestor (left, right, base).

    ``commits`` has commit, parent and n, the parent's place among the commit's parents: a row for each parent, or one with a
    null parent. A parent that has no row of its own begins a history, as in a shallow copy. Repeated rows and null commits change
    nothing; commits whose first parents form a cycle raise. ``pairs`` has left and right. ahead counts the commits that only
    left reaches, behind those that only right does. A best common ancestor is one that no other common one reaches: two histories
    may have none, or several. A pair with a null or unknown tip has null counts and no base. Repeated pairs have one row.
    """
    pairs = pairs.select("left", "right").distinct()
    with Workspace(commits.sparkSession) as w:
        edges, nodes = _first_parents(commits, w)
        places = chains(nodes, w)
        exits = _exits(edges, places, w)
        pairs = w.table(pairs, "pairs")
        tips = pairs.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("tip")).distinct()
        far = reach(tips, places, exits, w)
        known = places.select("node")
        whole = w.table(pairs.join(known.withColumnRenamed("node", "left").hint("merge"), "left", "left_semi").join(known.withColumnRenamed("node", "right").hint("merge"), "right", "left_semi").select("left", "right"), "whole")
        side = lambda name: whole.join(far.withColumnRenamed("tip", name).hint("merge"), name).select("left", "right", "chain", *(F.when(F.lit(name == s), F.col("pos")).otherwise(0).alias(s[0]) for s in ("left", "right")))
        met = w.table(side("left").union(side("right")).groupBy("left", "right", "chain").agg(F.max("l").alias("l"), F.max("r").alias("r")), "met")
        common = w.table(met.select("left", "right", "chain", F.least("l", "r").alias("pos"), F.lit(0).cast("long").alias("before")).where("pos > 0"), "common")
        lesser = _leave(common, ["left", "right"], exits)  # the common history is closed: an exit from it lands at most at a chain's last common commit
        best = common.select("left", "right", "chain", "pos").join(lesser.hint("merge"), ["left", "right", "chain", "pos"], "left_anti")
        bases = materialize(best.join(places.hint("merge"), ["chain", "pos"]).select("left", "right", F.col("node").alias("base")), "bases")
        only = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
        counts = met.groupBy("left", "right").agg(only("l", "r").alias("ahead"), only("r", "l").alias("behind"))
        counts = counts.join(bases.groupBy("left", "right").agg(F.count("*").alias("bases")).hint("merge"), ["left", "right"], "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
        same = lambda c: F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}"))
        told = pairs.alias("p").join(counts.alias("c").hint("merge"), same("left") & same("right"), "left").select("p.left", "p.right", "ahead", "behind", "bases")
        return materialize(told, "counts"), bases

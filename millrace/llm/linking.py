"""Classes of alike items from candidate keys: every two items that share a key are compared, or are in one class already.

Each key's group is first compared with one hub, a star as long as the group. The hub is the group's most central item, the
one that meets the most others over all its keys: what is alike to anything there is most likely alike to it, or to the
hub of another of its keys. Verified links give components. In groups that are then not in one component, the items of
different components are compared too if their sets may be alike (``across``: an exact filter, not a cap), so no link between
items of a key is missed.

These comparisons are dealt into tiles of two slots of items. A slot holds items of one home (the most central hub that they
share a group with) and of bounded size, so a tile gets each of its items' elements once, however many pairs it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.operators import lineage
from millrace.sources.tables import Workspace, materialize

#: Elements of the items of a slot on average; a tile has those of two slots in memory.
SLOT = 1 << 18
#: Sizes of sets are told apart in steps of this factor; it changes how many rows meet, not which pairs are found.
STEP = 1.1


def components(links: DataFrame) -> DataFrame:
    """id and root, the least id of its component, of every end of the links (a, b)."""
    return lineage.components(links).withColumnRenamed("node", "id")


def gather(texts: DataFrame, elements: Callable[[str], np.ndarray]) -> DataFrame:
    """id and the sorted elements of each text, of (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("e", pa.list_(pa.int64()))])

    def run(batches):
        for b in common.slices(batches):
            yield common.to_batch(schema, [b.column("id"), [np.sort(elements(t).view(np.int64)) for t in common.texts_of(b)]])

    return texts.select("id", "text").mapInArrow(run, "id long, e array<long>")


#: Whether two sorted sets are at least as alike as a ratio.
Alike = Callable[[np.ndarray, np.ndarray, float], bool]


def whole_alike(x: np.ndarray, y: np.ndarray, ratio: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``ratio``, by one merge."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common_part = int(np.count_nonzero(both[1:] == both[:-1]))
    return common_part >= ratio * (len(both) - common_part)


def verify(pairs: DataFrame, bodies: DataFrame, ratio: float, alike: Alike = whole_alike) -> DataFrame:
    """The pairs (a, b) whose elements' Jaccard similarity is at least ``ratio``, as ``alike`` tells."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in common.slices(batches):
            arrays = []
            for name in ("x", "y"):
                column = batch.column(name)
                flat, cuts = column.values.to_numpy(), column.offsets.to_numpy()
                arrays.append([flat[s:e] for s, e in zip(cuts, cuts[1:], strict=False)])
            keep = pa.array([alike(x, y, ratio) for x, y in zip(*arrays, strict=True)], pa.bool_())
            yield common.to_batch(schema, [batch.column(c).filter(keep) for c in ("a", "b")])

    x = bodies.select(F.col("id").alias("a"), F.col("e").alias("x"))
    y = bodies.select(F.col("id").alias("b"), F.col("e").alias("y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def star(groups: DataFrame, ratio: float) -> DataFrame:
    """Pairs (a, b) of each key's hub, its most central item, and its other items of a size that allows it; no others are asked here."""
    hubs = groups.groupBy("key").agg(F.min(F.struct(-F.col("degree"), "id", "size")).alias("hub")).select("key", F.col("hub.id").alias("a"), F.col("hub.size").alias("s"))
    close = (F.col("id") != F.col("a")) & (F.least("s", "size") >= ratio * F.greatest("s", "size"))
    return groups.join(hubs, "key").where(close).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def strays(rooted: DataFrame, w: Workspace) -> DataFrame:
    """id, root, keys and slot of the items of those keys whose items have more than one root; keys are these only.

    ``rooted`` has key, id, size, degree and root.
    """
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(-F.col("degree"), "id")).alias("home")).where("lo <> hi").select("key", "home")
    stray = rooted.join(split, "key").groupBy("id", "size", "root")
    homes = w.table(stray.agg(F.min("home").alias("home"), F.collect_set("key").alias("keys")), "strays")  # an item's own keys
    slots = homes.groupBy("home").agg(F.ceil(F.sum("size") / SLOT).alias("slots"))
    slot = F.xxhash64("home", F.pmod(F.xxhash64("id"), "slots"))
    return w.table(homes.join(slots, "home").select("id", "root", "keys", slot.alias("slot")), "slots")


def size_class(size: Column) -> Column:
    """The number of a size's class; sizes of one class are at most STEP from each other."""
    return F.floor(F.log(size) / math.log(STEP)).cast("int")


def across(held: DataFrame, ratio: float) -> DataFrame:
    """All pairs (a, b) of items of different roots whose sets may be as alike as ``ratio``, of id, root and e.

    Sets are taken in one order of all elements, rarest first, and elements that only items of one root have before all.
    Alike sets have an early element in common: if the first common one is the p-th of a set of n, no more than n - p + 1
    are common, and sets of n and m need ratio / (1 + ratio) * (n + m). So the smaller set is found by as many of its first
    elements as a set of its own size allows, the larger one by as many as a size of the smaller one's class allows.
    Copies of one text that are too far from each other have their own changes there, not what they share.

    Most items that share a common element are in one component. Rows are therefore dealt by whether they are of the
    largest one (``main``) that has the element, and no two of that meet.
    """
    members = held.groupBy("root").agg(F.count("*").alias("members"))
    each = held.join(members, "root").select("id", "root", "members", F.size("e").alias("n"), F.explode("e").alias("x"))
    holders = each.groupBy("x").agg(F.count("*").alias("often"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("members", "root")).alias("main"))
    holders = holders.where("lo <> hi").select("x", "often", (F.col("main.root")).alias("main"))
    own = Window.partitionBy("id")
    p = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "x"))
    needed = lambda n, m: F.ceil(F.lit(ratio / (1 + ratio)) * (n + m) - 1e-6)
    early = each.join(holders, "x").select("id", "x", "n", "root", p.alias("p"), (F.col("root") == F.col("main")).alias("is_main")).where(F.col("p") <= F.col("n") - needed(F.col("n"), ratio * F.col("n")) + 1)

    # sides: 0, none is of the main component; 1, the smaller set is; 2, the larger one is
    sided = lambda df, main: df.withColumn("side", F.explode(F.when(F.col("is_main"), F.array(F.lit(main))).otherwise(F.array(F.lit(0), F.lit(3 - main))))).drop("is_main")
    small = early.where(F.col("p") <= F.col("n") - needed(F.col("n"), F.col("n")) + 1)
    small = sided(small, 1).select("x", "side", size_class(F.col("n")).alias("c"), *(F.col(c).alias(f"s_{c}") for c in ("id", "n", "root", "p")))
    classes = F.sequence(size_class(F.col("n") * (ratio * (1 - 1e-9))), size_class(F.col("n")))
    least = F.greatest(ratio * F.col("n"), F.floor(F.pow(F.lit(STEP), F.col("c"))))
    large = early.withColumn("c", F.explode(classes)).where(F.col("p") <= F.col("n") - needed(F.col("n"), least) + 1)
    order = F.struct("s_n", "s_id") < F.struct("n", "id")
    rest = F.least(F.col("n") - F.col("p"), F.col("s_n") - F.col("s_p")) + 1
    met = sided(large, 2).join(small, ["x", "c", "side"]).where(order & (F.col("root") != F.col("s_root")) & (rest >= needed(F.col("n"), F.col("s_n"))))
    return met.select(F.least("id", "s_id").alias("a"), F.greatest("id", "s_id").alias("b")).distinct()


def tiled(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs with their tiles (x, y), from the items' slots."""
    for end, name in (("a", "p"), ("b", "q")):
        pairs = pairs.join(places.select(F.col("id").alias(end), F.col("slot").alias(name)), end)
    return pairs.select("a", "b", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))


def sharing(links: DataFrame, places: DataFrame) -> DataFrame:
    """The links (a, b) whose items share a key, with their roots: classes don't depend on which items are strays."""
    for end in ("a", "b"):
        links = links.join(places.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"), F.col("keys").alias(f"{end}_keys")), end)
    return links.where(F.arrays_overlap("a_keys", "b_keys")).select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))


def verify_tiles(pairs: DataFrame, bodies: DataFrame, ratio: float, alike: Alike = whole_alike) -> DataFrame:
    """The pairs (a, b) of tiles (x, y) that ``verify`` would keep; each tile gets the elements of its items once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        sets = {}
        for batch in held.to_batches():
            column = batch.column("e")
            flat, cuts = column.values.to_numpy(), column.offsets.to_numpy()
            sets.update((k, flat[s:e]) for k, s, e in zip(batch.column("id").to_pylist(), cuts, cuts[1:], strict=False))
        ends = zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True)
        keep = pa.array([alike(sets[a], sets[b], ratio) for a, b in ends], pa.bool_())
        return asked.select(["a", "b"]).filter(keep).cast(schema)

    wanted = pairs.select(F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.array("a", "b")).alias("id")).distinct()
    held = wanted.join(bodies, "id").select("u", "v", "id", "e")
    return pairs.groupBy("x", "y").cogroup(held.groupBy("u", "v")).applyInArrow(run, "a long, b long")


def classes(items: DataFrame, texts: DataFrame, elements: Callable[[str], np.ndarray], ratio: float, alike: Alike = whole_alike) -> DataFrame:
    """id and root of all items that are linked to another.

    ``items`` has id, digest, size and keys (an array): each distinct item once, its digest, its size and what it is found by;
    alike items' sizes have at least ``ratio`` as their quotient. ``texts`` has digest and text, of any number of rows an
    item. ``elements`` gives a text's set; likeness is the Jaccard similarity of these sets,
    and ``alike`` compares two.
    """
    with Workspace(items.sparkSession) as w:
        keys = items.select(F.explode("keys").alias("key"), "id", "size")
        met = w.table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
        shared = w.table(keys.join(met, "key"), "keyed-items")
        w.drop(met)
        degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
        groups = w.table(shared.join(degree, "id").select("key", "id", "size", "degree"), "groups")
        w.drop(shared)
        wanted = groups.select("id").distinct().join(items.select("id", "digest"), "id")
        # one row of an item is left before rows meet: many copies of a text don't come to one task
        once = texts.groupBy("digest").agg(F.first("text").alias("text"))
        bodies = w.table(gather(once.join(wanted, "digest"), elements), "candidates")
        links = w.table(verify(star(groups, ratio), bodies, ratio, alike), "links")
        roots = components(links)  # id, root
        rooted = w.table(groups.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        w.drop(groups)
        places = strays(rooted, w)
        held = w.table(bodies.join(places.select("id", "root"), "id").select("id", "root", "e"), "stray-elements")
        more = verify_tiles(w.table(tiled(across(held, ratio), places), "across"), held, ratio, alike)
        own = rooted.select("id", "root").distinct()
        joined = components(w.table(sharing(more, places), "links"))
        top = joined.select(F.col("id").alias("root"), F.col("root").alias("top"))
        placed = own.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        met = roots.select("id").union(joined.select("id")).distinct()
        return materialize(placed.join(met, "id", "left_semi"), "linked")

"""Histories against plain walks over all parents."""

import random

import pytest

from millrace.operators import ancestry
from millrace.sources.tables import Workspace

SCHEMA = "commit string, parent string, n int"


def history(parents, tip):
    """All that a tip reaches."""
    seen, left = set(), [tip]
    while left:
        c = left.pop()
        if c not in seen:
            seen.add(c)
            left += parents.get(c, [])
    return seen


def plain(parents, pairs):
    """Counts and bases of each pair, from whole histories."""
    known = set(parents) | {p for ps in parents.values() for p in ps}
    counts, bases = set(), set()
    for a, b in pairs:
        if a not in known or b not in known:
            counts.add((a, b, None, None, None))
            continue
        left, right = history(parents, a), history(parents, b)
        common = left & right
        best = common - {p for c in common for p in parents.get(c, [])}
        counts.add((a, b, len(left - right), len(right - left), len(best)))
        bases |= {(a, b, c) for c in best}
    return counts, bases


def compared(spark, parents, pairs, extra=()):
    rows = [(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)] + [(c, None, 0) for c, ps in parents.items() if not ps]
    random.Random(1).shuffle(rows)
    commits = spark.createDataFrame([*rows, *extra], SCHEMA)
    counts, bases = (df.collect() for df in ancestry.compare_tips(commits, spark.createDataFrame(list(pairs), "left string, right string")))
    want = plain(parents, pairs)
    assert {tuple(r) for r in counts} == want[0] and len(counts) == len(want[0])
    assert {tuple(r) for r in bases} == want[1] and len(bases) == len(want[1])
    return want


def test_random_histories(spark):
    """Several histories with merges across branches, repeated rows, null commits, unknown and null tips, and a parent that isn't listed."""
    rng = random.Random(5)
    parents = {}
    for h in "abc":
        names = []
        for i in range(90):
            near = names[-6:]
            parents[f"{h}{i}"] = rng.sample(near, min(len(near), rng.choice([1, 1, 1, 2, 2, 3]))) if near and rng.random() > 0.03 else []
            names.append(f"{h}{i}")
    parents["a0"] = ["elsewhere"]
    every = sorted(parents)
    pairs = {(rng.choice(every), rng.choice(every)) for _ in range(120)} | {(f"{h}{89 - i}", f"{h}{89 - j}") for h in "abc" for i in range(4) for j in range(4)}
    pairs |= {("a5", "nowhere"), (None, "a5"), ("elsewhere", "a80")}
    counts, _ = compared(spark, parents, pairs, [("a7", parents["a7"][0], 0)] * 3 + [(None, "a1", 0), (None, None, 0)])
    assert {c[4] for c in counts} >= {0, 1, 2}


def test_crossed_merges_have_two_bases(spark):
    """Two branches that have merged each other's tips have two best common ancestors."""
    parents = {"r": [], "x1": ["r"], "y1": ["r"], "x2": ["x1", "y1"], "y2": ["y1", "x1"]}
    _, bases = compared(spark, parents, {("x2", "y2"), ("x2", "x2"), ("x2", "r"), ("r", "y1")})
    assert {b for a, c, b in bases if (a, c) == ("x2", "y2")} == {"x1", "y1"}


def test_long_history_with_many_branches(spark, monkeypatch):
    """A long main line that half of all commits branch from and merge into, its exits asked in parts, and a commit with many children."""
    monkeypatch.setattr(ancestry, "PART", 16)
    parents = {"m0": []}
    for i in range(1, 300):
        parents[f"m{i}"] = [f"m{i - 1}"] + ([f"s{i - 1}"] if i % 2 == 0 else [])
        parents[f"s{i}"] = [f"m{i - 1}"]
    parents |= {f"k{i}": ["m3"] for i in range(200)}
    compared(spark, parents, {("m299", f"s{i}") for i in range(280, 300)} | {("k7", "k8"), ("k7", "m299"), ("s299", "m150"), ("m0", "m299")})
    with Workspace(spark) as w:
        rows = [(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)]
        edges, nodes = ancestry._first_parents(spark.createDataFrame(rows, SCHEMA), w)
        places = ancestry.chains(nodes, w)
        assert places.where("node in ('m0', 'm298')").select("chain").distinct().count() == 1  # the line is not broken by its branches; at its end m299 and s299 are alike
        assert ancestry._exits(edges, places, w)[1].where("parts > 1").count() >= 1


def test_empty_and_cycle(spark):
    """Without commits every tip is unknown; without pairs there are no rows; a cycle of first parents raises."""
    none = spark.createDataFrame([], SCHEMA)
    pairs = spark.createDataFrame([("a", "b")], "left string, right string")
    counts, bases = ancestry.compare_tips(none, pairs)
    assert [tuple(r) for r in counts.collect()] == [("a", "b", None, None, None)] and not bases.count()
    counts, bases = ancestry.compare_tips(spark.createDataFrame([("a", "b", 0)], SCHEMA), pairs.limit(0))
    assert not counts.count() and not bases.count()
    for cycle in ([("a", "b", 0), ("b", "c", 0), ("c", "a", 0)], [("a", "a", 0)]):
        with pytest.raises(ValueError, match="cycle"):
            ancestry.compare_tips(spark.createDataFrame(cycle, SCHEMA), pairs)


def test_nothing_is_broadcast(spark, tmp_path):
    """Each round's joins are merges: a broadcast would send its table through the driver, once a round."""
    commits = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(6)], "commit long, parent long, n int")
    with ancestry.Workspace(spark) as w:
        edges, nodes = ancestry._first_parents(commits, w)
        made, table = [], w.table
        w.table = lambda df, label: (made.append(df._jdf.queryExecution().executedPlan().toString()), table(df, label))[1]
        places = ancestry.chains(nodes, w)
        ancestry._exits(edges, places, w)
    assert made and not [p for p in made if "Broadcast" in p]

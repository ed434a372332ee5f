"""Hash trees against a plain version and exceptAll."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import hashtree
from millrace.sources.tables import Workspace

SCHEMA = "digest string, k int"


def plain(rows, leaf):
    """Root, number of distinct rows and depth, from a list of rows."""
    part = lambda v: len(v.encode()).to_bytes(4, "big") + v.encode()
    whole = lambda r: b"".join(part(c) + (part("absent") if v is None else part("present") + part(str(v))) for c, v in zip(("digest", "k"), r, strict=True))
    count = Counter(hashlib.sha256(whole(r)).hexdigest() for r in rows)
    depth = next(d for d in range(99) if len(count) <= leaf * 16**d)
    level = {}
    for d, n in count.items():
        level.setdefault(d[:depth], []).append(f"{d}:{n}")
    for d in range(depth, -1, -1):
        level = {k: hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for k, v in level.items()}
        if d:
            up = {}
            for k, v in level.items():
                up.setdefault(k[: d - 1], []).append(f"{k}:{v}")
            level = up
    return level.get(""), len(count), depth


def rows_of(n):
    """Rows with repeats, nulls, and a key that half of them have."""
    rng = random.Random(n)
    return [(rng.choice(["x", None, "é", f"v{i}"]), rng.choice([1, i, None])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 60, 900])
def test_fingerprint(spark, n):
    """The root of every depth, in any order of rows; one more repeat changes it."""
    rows = rows_of(n)
    got = hashtree.tree_fingerprint(spark.createDataFrame(rows, SCHEMA).repartition(5), leaf=4).first()
    assert tuple(got) == plain(rows, 4)
    if n:
        assert hashtree.tree_fingerprint(spark.createDataFrame([*rows, rows[0]], SCHEMA), leaf=4).first()["fingerprint"] != got["fingerprint"]


def test_differing_rows(spark):
    """What differs is exceptAll both ways, with counts; equal tables differ nowhere, and an empty one everywhere."""
    rows = rows_of(900)
    other = [*rows[3:], rows[5], rows[5], ("new", None), (None, None)]
    a, b = (spark.createDataFrame(r, SCHEMA) for r in (rows, other))
    for x, y in ((rows, other), (rows, []), (rows, rows[::-1])):
        left, right = Counter(x), Counter(y)
        want = {(*r, left[r], right[r]) for r in {*left, *right} if left[r] != right[r]}
        got = hashtree.differing(spark.createDataFrame(x, SCHEMA), spark.createDataFrame(y, SCHEMA), leaf=4).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    less = {tuple(r) for r in a.exceptAll(b).collect()}
    assert less == {tuple(r)[:2] for r in hashtree.differing(a, b, leaf=4).where("n_left > n_right").collect()}
    with pytest.raises(ValueError, match="n_left"):
        hashtree.differing(a.withColumn("n_left", F.lit(1)), b.withColumn("n_left", F.lit(1)))


def test_only_unequal_subtrees(spark):
    """One changed row opens at most two leaves."""
    a = spark.range(5000).select("id", F.lit("v").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 77, "w").otherwise(F.col("v")))
    with Workspace(spark) as w:
        trees = [hashtree.build(*hashtree.digests(t, ["id", "v"], w), 3, w) for t in (a, b)]
        assert 1 <= hashtree.unequal_leaves(*trees, w).count() <= 2


@pytest.mark.parametrize("few", [hashtree.FEW, 0])
def test_only_what_differs_is_written(spark, monkeypatch, few):
    """One changed row of 5,000: nothing as long as the tables is written, by either way to the whole rows."""
    monkeypatch.setattr(hashtree, "FEW", few)
    table, written = Workspace.table, []

    def noted(self, df, label):
        made = table(self, df, label)
        written.append(made.count())
        return made

    monkeypatch.setattr(Workspace, "table", noted)
    a = spark.range(5000).select("id", F.lit("v").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 77, "w").otherwise(F.col("v")))
    got = {tuple(r) for r in hashtree.differing(a, b, leaf=4).collect()}
    assert got == {(77, "v", 1, 0), (77, "w", 0, 1)} and sum(written) <= 4

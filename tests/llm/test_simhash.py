"""Operator 12 against all pairs, the library's hash and plain counting."""

import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import queries, simhash
from millrace.sources.tables import Workspace, load

ODD = [(1, "a b c d e"), (2, "A  b\tc\nd e"), (3, None), (4, ""), (5, " \x0b\x0c "), (6, "a b"), (6, "a b"), (None, "zz yy xx ww"), (None, "only here " * 9), (9, "é😀 " * 40_000), (10, "ÀB ÀB"), (11, "\x1ca \xa0b")]


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius):
    """The least value that each is connected to, by all pairs."""
    distinct = np.unique(np.array(list(values), np.uint64))
    near = np.bitwise_count(distinct[:, None] ^ distinct[None, :]) <= radius
    label = np.arange(len(distinct))
    while (new := np.where(near, label[None, :], len(label)).min(axis=1)).tolist() != label.tolist():
        label = new
    return {int(v): int(distinct[k]) for v, k in zip(distinct, label, strict=True)}


def plain(rows):
    found = [(k, plain_print(t)) for k, t in rows]
    root, least = plain_components({p for _, p in found}, 4), {}
    for k, p in found:
        if k is not None:
            least[root[p]] = min(k, least.get(root[p], k))
    return sorted((str(k), f"{p:016x}", str(least.get(root[p]))) for k, p in found)


def got(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def near_prints(n, seed=3):
    """Fingerprints of a few families whose members are some bits from each other, and of strangers."""
    rnd = random.Random(seed)
    heads = [rnd.getrandbits(64) for _ in range(4)]
    near = [rnd.choice(heads) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(n)]
    return np.unique(np.array(near + [rnd.getrandbits(64) for _ in range(n // 4)] + [0, 1, 2**64 - 1], np.uint64))


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, sf, "documents").collect()]
    assert got(queries.queries()["op12_simhash"](spark, sf)) == plain(rows)


def test_odd(spark):
    table = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, print int, fixed string")
    assert got(simhash.components(table)) == plain(ODD)
    assert simhash.components(table.limit(0)).count() == 0
    zero = spark.createDataFrame([(5, None), (4, ""), (7, " ")], "doc_id long, text string")
    assert got(simhash.components(zero)) == [(str(k), "0" * 16, "4") for k in (4, 5, 7)]


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_connect(radius):
    values = near_prints(700)
    buckets = np.sort(np.random.default_rng(1).integers(0, 3, len(values)))
    a, b = simhash.connect(values, buckets, radius)
    assert (np.bitwise_count(a ^ b) <= radius).all() and len(a) < len(values)
    label = {int(v): int(v) for v in values}
    want = {}
    for k in range(3):
        want |= plain_components(values[buckets == k], radius)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        label[max(x, y)] = min(x, y)
    assert {v: root(v) for v in label} == want


def test_lanes():
    """Each lane's distance is told exactly, at offsets within and beyond a word."""
    values = near_prints(300)
    plane = simhash.planes(values)
    for radius in (0, 2, 4, 7):
        for offset in (1, 5, 63, 64, 65, 130):
            words = np.arange((len(values) - offset) // 64)
            near = simhash.near_lanes(plane, words, np.full(len(words), offset), np.full(len(words), 2**64 - 1, np.uint64), radius)
            lanes = np.unpackbits(near.view(np.uint8), bitorder="little").astype(bool)
            assert (lanes == (np.bitwise_count(values[: len(lanes)] ^ values[offset : offset + len(lanes)]) <= radius)).all()


def test_large_buckets(spark):
    """Buckets over the limit meet again by further pieces, and no link is lost."""
    values = near_prints(900, 9)
    once = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long")
    with Workspace(spark) as w:
        rows = simhash.links(once, w, limit=32).collect()
    assert len(rows) < 40 * len(values)
    label = {int(v): int(v) for v in values}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in rows:
        x, y = root(r["a"] % 2**64), root(r["b"] % 2**64)
        label[max(x, y)] = min(x, y)
    assert {v: root(v) for v in label} == plain_components(values, 4)
    with Workspace(spark) as w, pytest.raises(ValueError):
        simhash.links(once, w, limit=8)


def test_pieces():
    """Any few different bits leave a choice of pieces untouched."""
    rnd = random.Random(5)
    for fixed in (0, 0xFFFF, rnd.getrandbits(64)):
        masks = simhash.pieces(fixed)
        assert len(masks) <= 35 and all(m & fixed == fixed and m != fixed for m in masks)
        free = [b for b in range(64) if not fixed >> b & 1]
        for _ in range(300):
            differ = sum(1 << b for b in rnd.sample(free, 4))
            assert any(not m & differ for m in masks)

"""Operator 11 against plain scoring of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import k2treap, queries
from millrace.sources.tables import load

DOCS = [(3, "the cat sat"), (1, "The CAT, sat!"), (2, None), (4, ""), (5, "-- \x7f"), (7, "cat cat dog"), (7, "cat cat dog"), (None, "dog É é"), (6, "cat " * 70_000 + "dog"), (8, "bird"), (9, "naïve 42x")]
ITEMS = [(1, "cat dog dog"), (2, None), (3, "nowhere to be"), (1, "É naïve 42X"), (None, "the the sat"), (5, "")]


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    N, L, df = len(counted), sum(n for _, _, n in counted), Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(str(item), i + 1, str(None if null else d), -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(df):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in load(spark, sf, "benchmark").collect()]
    assert got(queries.queries()["op11_k2treap"](spark, sf)) == plain(docs, items)


@pytest.mark.parametrize("block_docs, k", [(2, 20), (8192, 2), (3, 1)])
def test_odd(spark, monkeypatch, block_docs, k):
    monkeypatch.setattr(k2treap, "ITEM_BYTES", 16)  # several rounds
    docs = spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id long, text string, score int, place string")
    items = spark.createDataFrame([(*r, 1, "x") for r in ITEMS], "item_id long, text string, doc_id int, place string")
    assert got(k2treap.search(k2treap.build(docs, block_docs), items, k)) == plain(DOCS, ITEMS, k)


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert k2treap.search(k2treap.build(docs.limit(0)), items).count() == 0
    assert k2treap.search(k2treap.build(docs), items.limit(0)).count() == 0


def test_treap():
    """Packing is exact, and the best columns are those of plain sums, ties included."""
    rnd = np.random.default_rng(4)
    for n_rows, n_columns, cells in ((1, 1, 1), (40, 300, 2500), (900, 70, 4000), (5, 2000, 3000)):
        grid = np.zeros((n_rows, n_columns), np.int64)
        grid[rnd.integers(0, n_rows, cells), rnd.integers(0, n_columns, cells)] = rnd.integers(1, 9, cells)
        rows, columns = np.nonzero(grid)
        built = k2treap.Treap.build(rows, columns, grid[rows, columns])
        treap = k2treap.Treap.unpacked(built.height, *built.packed())
        assert np.array_equal(treap.tops, built.tops) and np.array_equal(treap.kids, built.kids)
        for k in (1, 5, 20, 5000):
            for least in (1, 12):
                asked = rnd.choice(n_rows, min(n_rows, 6), replace=False)
                weights = rnd.integers(1, 4, len(asked))
                sums = weights @ grid[asked]
                order = np.sort(sums)[::-1]
                limit = max(least, int(order[k - 1]) if k <= len(order) else 1)
                found, scores = treap.best(asked, weights, k, least, batch=4)
                assert sorted(found.tolist()) == np.flatnonzero(sums >= limit).tolist() and (sums[found] == scores).all()


def test_sizes(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    counts = [len(plain_terms(t)) for _, t in DOCS]
    assert k2treap.sizes(docs) == (sum(n > 0 for n in counts), sum(counts))


def test_few_blocks_a_file(spark):
    """A task that makes many blocks writes several files: a reader holds all blocks of a file at once."""
    docs = spark.createDataFrame([(i, "cat sat") for i in range(11)], "doc_id long, text string").coalesce(1)
    files = k2treap.build(docs, 1).blocks.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 11 and max(r["count"] for r in files) <= k2treap.FILE_BLOCKS

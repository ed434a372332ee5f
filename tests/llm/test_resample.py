"""Operator 13 against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import queries, resample
from millrace.sources.tables import Workspace, load

ODD = [(1, "Éa b c " * 9), (2, None), (3, ""), (4, "_-[]{} \x7f"), (5, "one two " * 12), (5, "one two " * 12), (5, "one three " * 11), (None, "no id here " * 8), (None, "no id here " * 8), (6, "x1Y2 " * 50_000), (7, "short")]


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(words, longest):
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, buckets=10_000, longest=1, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(k, plain_words(t)) for k, t in docs]
    listed = [[bucket(f) for f in plain_features(w, longest)] for _, w in found]
    source, wanted = Counter(b for x in listed for b in x), Counter(bucket(f) for t in target for f in plain_features(plain_words(t), longest))
    S, T = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((source[b] + 1) * (T + buckets))))
    rows = []
    for (k, words), held in zip(found, listed, strict=True):
        weight = sum(map(gain, held)) // len(held) if held else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    usable = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = usable[: percent * len(usable) // 100]
    out = [(*map(str, r[:4]), str(i + 1)) for i, r in enumerate(drawn)]
    left = Counter(rows) - Counter(drawn)
    return sorted(out + [(*map(str, r[:4]), "None") for r in left.elements()])


def got(df):
    return sorted(tuple(str(r[c]) for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, sf, "documents").collect()]
    target = [r["text"] for r in load(spark, sf, "benchmark").collect()]
    assert got(queries.queries()["op13_resample"](spark, sf)) == plain(docs, target)


@pytest.mark.parametrize("longest, percent, buckets", [(1, 50, 10_000), (3, 100, 97), (2, 0, 500)])
def test_odd(spark, longest, percent, buckets):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], "doc_id long, text string, rank int, row string, score int")
    target = spark.createDataFrame([("one two three",), (None,)], "text string")
    found = resample.resample(table, target, percent=percent, longest=longest, buckets=buckets)
    assert got(found) == plain(ODD, ["one two three", None], buckets, longest, percent=percent)


def test_empty(spark):
    table = spark.createDataFrame(ODD, "doc_id long, text string")
    none = table.select("text").limit(0)
    assert got(resample.resample(table, none, percent=30)) == plain(ODD, [], percent=30)
    assert resample.resample(table.limit(0), none).count() == 0


def test_bracket_is_widened(spark):
    """A sketch that is off, or one score that most rows share, still brackets the last row."""
    rnd = random.Random(2)
    values = [rnd.choice([5, 5, 5, 5, rnd.randrange(1000)]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "score long")
    ordered = sorted(values, reverse=True)
    for rank in (1, 2, 300, 1500, 2999, 3000):
        for accuracy in (3, 100, 10_000):
            low, high, above = resample.bracket(table, rank, len(values), accuracy)
            assert low <= ordered[rank - 1] <= high and above == sum(v > high for v in values)
            assert above < rank <= above + sum(low <= v <= high for v in values)


def test_numbered(spark):
    rows = [(s % 7, None if s % 11 == 0 else s % 50, s % 3, s) for s in range(1000)]
    table = spark.createDataFrame(rows, "score long, doc_id long, n_features long, row long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3]))
    with Workspace(spark) as w:
        assert [tuple(r)[:4] for r in sorted(resample.numbered(table, w).collect(), key=lambda r: r["position"])] == order

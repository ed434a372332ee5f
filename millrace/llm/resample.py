"""Operator 13: importance resampling towards a target distribution.

A text's words are its maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased; its
features are all runs of 1 to ``longest`` words, each hashed to one of ``buckets`` by CRC-32. Each bucket's gain is the
thousandfold log ratio of its smoothed shares in the target and in the documents, rounded down; a text's weight is the
mean gain of its features, rounded down, from arrays of its buckets and their counts. Adding Gumbel noise of a hash of
doc_id and drawing the highest scores is drawing without repeats in proportion to the weights.

The cutoff: an approximate quantile sketch of the scores brackets the score of the last row to be drawn. Exact counts
above and inside the bracket validate it; where they don't, it is widened, and counted again. Only the bracket's rows are
sorted to find the last one that is drawn. Ranks come from range partitions of the drawn rows, each numbered on its own,
and their row counts; no row count of a single task follows the input.

Rules: null and empty texts have no feature and weight 0; texts with fewer than ``least`` words are scored, but never
drawn; ties go to the smaller doc_id (nulls last, hashed as "null"), then fewer features, then to either of the rows; each repeated row
is a row of its own; an empty target or an empty table is smoothed as counts of 0; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.sources.tables import Workspace, materialize

BUCKETS = 10_000
LONGEST = 1
LEAST = 20
PERCENT = 10
SEED = 2024
#: Accuracy of the quantile sketch, and how many of its steps the first bracket has on either side.
ACCURACY = 10_000
STEPS = 4
#: Features whose buckets are kept between texts.
KEPT = 200_000


class Buckets(dict):
    """The bucket of each feature."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.n
        if len(self) >= KEPT:
            self.clear()
        if len(feature) <= 64:
            self[feature] = found
        return found


def features(text: bytes, longest: int) -> tuple[int, list[bytes]]:
    """The number of words and all features of a text in UTF-8."""
    words = common.terms_of(text)
    found = list(words)
    for size in range(2, longest + 1):
        found += [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len(words), found


def arrays(docs: DataFrame, keep: str | None = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """n_words, n_features, and each text's buckets with their counts (two arrays); with the column ``keep``."""
    kinds = [("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    schema = pa.schema(([("doc_id", pa.int64())] if keep else []) + kinds)

    def run(batches):
        known = Buckets(buckets)
        for b in common.slices(batches):
            words, sizes, places, counts = [], [], [], []
            for text in common.bytes_of(b):
                n, found = features(text, longest)
                held = Counter(map(known.__getitem__, found))
                words.append(n)
                sizes.append(len(found))
                places.append(list(held))
                counts.append(list(held.values()))
            yield common.to_batch(schema, ([b.column(keep)] if keep else []) + [words, sizes, places, counts])

    named = [F.col(keep).cast("long").alias(keep)] if keep else []
    return docs.select(*named, "text").mapInArrow(run, ("doc_id long, " if keep else "") + "n_words long, n_features long, buckets array<int>, counts array<int>")


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All buckets and counts of a batch's texts, and where each text's begin and end."""
    places = batch.column("buckets")
    return places.flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())])


def totals(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all texts have in each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            places, counts, _ = flat(b)
            total += np.bincount(places, counts, buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield common.to_batch(schema, [pa.array(used), pa.array(total[used])])

    out = np.zeros(buckets, np.int64)
    for r in table.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in thousandths, rounded down."""
    t, s, n = target.astype(float), source.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each text, from its arrays."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for b in batches:
            places, counts, cuts = flat(b)
            sums = np.concatenate([[0], np.cumsum(gain[places] * counts)])
            n = b.column("n_features").to_numpy()
            weight = (sums[cuts[1:]] - sums[cuts[:-1]]) // np.maximum(n, 1)
            yield common.to_batch(schema, [b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(weight)])

    return table.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 8 hex digits of SHA-256 of "seed:doc_id"."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def order() -> list[Column]:
    """The order in which rows are drawn; the rows' own numbers settle what is left."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]


def numbered(rows: DataFrame, w: Workspace) -> DataFrame:
    """The rows with position, from 1, in their order: range partitions are numbered each on its own, then shifted by the rows before."""
    spread = rows.repartitionByRange(common.partitions(rows), *order()).sortWithinPartitions(*order())
    local = F.monotonically_increasing_id()  # a partition's number in the upper bits, the row's place there in the lower 33
    table = w.table(spread.withColumn("part", F.shiftright(local, 33)).withColumn("place", local.bitwiseAND(F.lit((1 << 33) - 1))), "op13-ranges")
    before, shifts = 0, []
    for r in table.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each shuffle partition
        shifts.append((r["part"], before))
        before += r["n"]
    known = rows.sparkSession.createDataFrame(shifts, "part long, before long")
    return table.join(F.broadcast(known), "part").withColumn("position", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def bracket(scores: DataFrame, rank: int, total: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Scores low and high with the ``rank``-th highest of ``total`` between them, and the exact number of rows above high.

    The sketch's guess is widened until exact counts show that the rank is inside; at the widest the ends are the least
    and the highest score.
    """
    at, steps = (total - rank) / total, STEPS
    while True:
        ends = [max(0.0, at - steps / accuracy), min(1.0, at + steps / accuracy)]
        low, high = scores.agg(F.percentile_approx("score", ends, accuracy).alias("q")).first()["q"]
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < rank <= above + inside:
            return low, high, above
        if ends == [0.0, 1.0]:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
            return low, high, 0
        steps *= 8


def draw(scored: DataFrame, least: int, percent: int, w: Workspace) -> DataFrame:
    """``scored`` (written, with row) with rank: 1, 2, ... for the highest ``percent`` of the rows of at least ``least`` words."""
    usable = scored.where(F.col("n_words") >= least)
    total = usable.count()
    wanted = percent * total // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return scored.withColumn("rank", none)
    low, high, above = bracket(usable, wanted, total)
    last = numbered(usable.where(F.col("score").between(low, high)), w).where(F.col("position") == wanted - above)
    cut = last.select(*(F.col(c).alias(f"cut_{c}") for c in ("score", "doc_id", "n_features", "row")))  # one row
    met = scored.join(F.broadcast(cut))
    key = lambda c="": F.struct(-F.col(f"{c}score"), F.col(f"{c}doc_id").isNull(), f"{c}doc_id", f"{c}n_features", f"{c}row")
    told = w.table(met.withColumn("drawn", (F.col("n_words") >= least) & (key() <= key("cut_"))).select(*scored.columns, "drawn"), "op13-drawn")
    ranked = numbered(told.where("drawn"), w).withColumnRenamed("position", "rank").drop("drawn")
    return ranked.unionByName(told.where("not drawn").drop("drawn").withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of each row of ``docs``; ``target`` has a column text."""
    with Workspace(docs.sparkSession) as w:
        table = w.table(arrays(docs, "doc_id", buckets, longest), "op13-arrays")
        gain = gains(totals(table, buckets), totals(arrays(target, None, buckets, longest), buckets))
        rows = weighted(table, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        scored = w.table(rows.withColumn("row", F.monotonically_increasing_id()), "op13-scores")  # a row's number is its own once it is written
        return materialize(draw(scored, least, percent, w).select("doc_id", "n_features", "weight", "score", "rank"), "op13-ranks")

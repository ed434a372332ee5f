"""Scans over ordered rows of any number: positions, running sums and maxima, next rows, chains of hops.

Rows are dealt into ranges of their order, written once, and each range is scanned on its own. What a range adds to those
behind it is one value, so what the driver gathers has a row for each range, whatever the rows; a key that most rows have
is spread over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import Workspace


def ranged(rows: DataFrame, order: list[str | Column], w: Workspace, label: str = "ranges") -> DataFrame:
    """The rows, written, with part (the number of their range of ``order``) and place (where they are in it).

    Rows that are equal in all of ``order`` share a range, in any order.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's place
    return w.table(spread.withColumn("part", F.shiftright(local, 33)).withColumn("place", local.bitwiseAND(F.lit((1 << 33) - 1))), label)


def running(table: DataFrame, value: Column, how: str, name: str) -> DataFrame:
    """A ranged table with ``name``, the sum or the max of ``value`` (a number, or a struct for max) over all rows up to this one."""
    fold = {"sum": F.sum, "max": F.max}[how]
    local = table.withColumn(name, fold(value).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    totals = table.groupBy("part").agg(fold(value).alias("total"))
    before, carried = None, []
    for r in totals.orderBy("part").collect():  # a row for each range
        carried.append((r["part"], before))
        if r["total"] is not None:
            before = r["total"] if before is None else before + r["total"] if how == "sum" else max(before, r["total"])
    kind = totals.schema["total"].dataType.simpleString()
    known = table.sparkSession.createDataFrame(carried, f"part long, __before {kind}")
    whole = F.coalesce(F.col(name) + F.col("__before"), name, "__before") if how == "sum" else F.greatest(name, "__before") if not kind.startswith("struct") else F.coalesce(F.when(F.col(name) > F.col("__before"), F.col(name)), "__before", name)
    return local.join(F.broadcast(known), "part").withColumn(name, whole).drop("__before")


def positions(rows: DataFrame, order: list[str | Column], w: Workspace, label: str = "positions") -> DataFrame:
    """The rows as a ranged table with pos: 1, 2, ... in ``order``, which tells all rows apart."""
    return running(ranged(rows, order, w, label), F.lit(1), "sum", "pos")


def next_rows(rows: DataFrame, queries: DataFrame, by: list[str], equal: bool, w: Workspace) -> DataFrame:
    """pos and next of each query: the pos of the first row beyond the query's ``by``, or also at it if ``equal``.

    Both have ``by`` and pos; the rows' pos, from 1, goes by ``by``. A next beyond the last row is no row's.
    """
    first, second = (queries, rows) if equal else (rows, queries)
    tagged = [df.select(*by, F.lit(i).alias("turn"), "pos", F.lit(int(df is rows)).alias("is_row")) for i, df in enumerate((first, second))]
    met = running(ranged(tagged[0].unionByName(tagged[1]), [*by, "turn", "pos"], w, "met"), F.col("is_row").cast("long"), "sum", "passed")
    return met.where("is_row = 0").select("pos", (F.col("passed") + 1).alias("next"))


def reached(starts: DataFrame, hops: DataFrame, w: Workspace) -> DataFrame:
    """The pos of all rows that the starts (pos) lead to by hops (pos, next), themselves included.

    The hops double in each round, so the rounds grow with the logarithm of the longest chain.
    """
    found, hops = w.table(starts.select("pos").distinct(), "reached"), w.table(hops.select("pos", "next"), "hops")
    while True:
        more = w.table(found.join(hops, "pos").select(F.col("next").alias("pos")), "more")
        if not more.limit(1).count():
            w.drop(more, hops)
            return found
        both = w.table(found.union(more).distinct(), "reached")
        after = hops.select(F.col("pos").alias("next"), F.col("next").alias("then"))
        twice = w.table(hops.join(after, "next").select("pos", F.col("then").alias("next")), "hops")
        w.drop(found, more, hops)
        found, hops = both, twice

"""Order, limits and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.canonical import utf16
from millrace.operators import scan
from millrace.sources.tables import Workspace, materialize

#: Fixed values.
RECENT, PAGE_BYTES = 20, 48 * 1024
#: Bytes of a JSON null.
NULL_BYTES = 4
#: Digits that a count of rows may have.
DIGITS = 10


def order_targets(targets: DataFrame) -> DataFrame:
    """Local before remote, then by name in UTF-16 order (O1)."""
    return targets.orderBy("kind_ord", utf16(F.col("full_name")))


def recent_top(rows: DataFrame, newest: str, key: str, n: int = RECENT) -> DataFrame:
    """The newest rows, ties by key."""
    return rows.orderBy(F.desc_nulls_last(newest), key).limit(n)


def retention_victims(rows: DataFrame, newest: str, key: str, n: int = RECENT) -> DataFrame:
    """All rows but the newest (O6): an anti join with the few that stay, so that nothing is ranked in one task."""
    return rows.join(recent_top(rows, newest, key, n).select(key), key, "left_anti")


def next_per_key(rows: DataFrame, by: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The first row of each key, as an aggregate without a sort."""
    first = F.min(F.struct(*order, *(v for v in value if v not in order)))
    return rows.groupBy(*by).agg(first.alias("f")).select(*by, *(F.col(f"f.{c}").alias(c) for c in dict.fromkeys([*order, *value])))


def keyset_page(rows: DataFrame, order: list[str], cursor: tuple, size: int) -> DataFrame:
    """The rows after a cursor in an order."""
    after = F.struct(*order) > F.struct(*(F.lit(v).cast(rows.schema[c].dataType) for c, v in zip(order, cursor, strict=True)))
    return rows.where(after).orderBy(*order).limit(size)


def cursor_exists(rows: DataFrame, key: str, cursor: str) -> DataFrame:
    """One row: whether a cursor names a row; paging from an unknown one is an error."""
    return rows.agg((F.count_if(F.col(key) == cursor) == 1).alias("known"))


def json_bytes(*columns: str) -> Column:
    """The size of a row's JSON in UTF-8 bytes, as Spark writes it."""
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def byte_budget_page(rows: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """The longest beginning of the ordered rows whose sizes fit the budget, with running.

    A page holds at most as many rows as bytes, so the window reads only that many, picked by a distributed top-k.
    """
    few = rows.withColumn("bytes", size).where(F.col("bytes") <= budget).orderBy(*order).limit(budget)
    running = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("running", running).where(F.col("running") <= budget)


def oversize(rows: DataFrame, size: Column, budget: int) -> DataFrame:
    """One row: how many rows fit no page by themselves."""
    return rows.agg(F.count_if(size > budget).alias("excluded"))


def target_page(targets: DataFrame, envelope: int, budget: int = PAGE_BYTES) -> tuple[DataFrame, int]:
    """A page of targets within a response's budget, and the number that fit no page.

    The number is part of the response, so more digits may exclude further rows: repeated until it stays.
    """
    size = json_bytes("kind", "name", "full_name", "revision") + 1
    count = 0
    while True:
        room = budget - envelope - len(str(count))
        found = oversize(targets, size, room).first()["excluded"]
        if found == count:
            return byte_budget_page(targets, ["kind_ord", "full_name"], size, room), count
        count = found


def pages(rows: DataFrame, key: str, order: list[str | Column], size: Column, cursor: Column, envelope: Column, probe: Column, budget: int = PAGE_BYTES, suggested: Column | None = None, excluded: Column | None = None, skip: Column | None = None) -> DataFrame:
    """All pages of all lists at once (A2, O9): the rows with supported, unsupported_count, page and with_suggestion.

    A list is the rows of a ``key`` in ``order``, which tells them apart. A response's bytes are its ``envelope``, its rows'
    ``size`` with commas between them, the cursor (that of its last row, or null at the list's end), the suggestion (the
    size of the row that is ``suggested``, or null) and the digits of the count of unsupported rows, which starts from
    ``excluded``. Only a list's first page has the suggestion, and not even that one if its first row doesn't fit beside it.
    Rows to ``skip``, up to a cursor, are on no page, and pages begin behind them. A row is unsupported if a response of ``probe`` bytes with it alone is over the budget; as the count is
    part of that response, this is the least fixpoint. Pages take as many rows as fit, numbered from 1. Envelope, probe and excluded are the same for all rows of a list.

    page is null for unsupported and skipped rows, and from a row on that fits no page even without the suggestion. Rows
    without a key are left out.

    Each row leads to the row that would begin the page behind it, found by the running sums; the rows that a list's
    first one leads to begin its pages. No list is gathered in one task.
    """
    taken = [c for c in ("supported", "unsupported_count", "page", "with_suggestion") if c in rows.columns]
    if taken:
        raise ValueError(f"rows already have {taken}")
    null, digits = F.lit(NULL_BYTES).cast("long"), range(1, DIGITS + 1)
    flag = F.lit(False) if suggested is None else F.coalesce(suggested, F.lit(False))
    start = F.lit(0) if excluded is None else excluded
    past = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    values = {"size": size, "cursor": cursor, "envelope": envelope, "probe": probe, "start": start}
    with Workspace(rows.sparkSession) as w:
        ordered = {f"o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
        slim = rows.select(F.struct("*").alias("row"), F.col(key).alias("k"), *(c.alias(n) for n, c in ordered.items()), *(c.cast("long").alias(n) for n, c in values.items()), flag.alias("suggested"), past.alias("skip"))
        placed = w.table(scan.positions(slim.where("k is not null"), ["k", *ordered], w).drop("part", "place", *ordered), "rows")
        # for each number of digits: the last row that fits with a null cursor ends the list, rows before it need their own
        alone = F.col("probe") + F.col("size") + null
        last = F.array(*(F.max(F.when(alone + null + d <= budget, F.col("pos"))) for d in digits))
        joined = w.table(placed.join(placed.groupBy("k").agg(last.alias("last")), "k"), "ends")
        fits = lambda d: F.coalesce((F.col("pos") == d["last"]) | ((F.col("pos") < d["last"]) & (alone + F.col("cursor") + d["n"] <= budget)), F.lit(False))
        unfit = F.array(*(F.count_if(~fits({"last": F.get("last", F.lit(d - 1)), "n": d})) for d in digits))
        lists = joined.groupBy("k").agg(unfit.alias("unfit"), F.min("start").alias("start"))
        length = lambda n: F.length(n.cast("string"))
        count = F.aggregate(F.sequence(F.lit(0), F.lit(DIGITS)), F.col("start"), lambda n, _: F.col("start") + F.get("unfit", length(n) - 1))
        lists = lists.select("k", count.alias("unsupported_count"), length(count).alias("n"))
        told = joined.join(lists, "k")
        told = w.table(told.withColumn("supported", fits({"last": F.get("last", F.col("n") - 1), "n": F.col("n")})).withColumn("ends", F.col("pos") == F.get("last", F.col("n") - 1)), "told")
        shown = told.where("supported").withColumn("cur", F.when(F.col("ends"), null).otherwise(F.col("cursor")))
        room = F.lit(budget) - F.col("envelope") - F.col("n") + 1  # beside rows with a comma each, and the cursor
        most = shown.groupBy("k").agg(F.max(F.when(F.col("suggested"), F.col("size"))).alias("beside"), F.min(F.when(~F.col("skip"), F.col("pos"))).alias("first"))
        shown = shown.where("not skip").join(most, "k")
        step = F.col("size") + 1 + F.when(F.col("pos") == F.col("first"), F.lit(budget)).otherwise(F.lit(0))  # lists lie a budget apart
        dense = scan.positions(shown.withColumn("step", step).withColumnRenamed("pos", "old"), ["old"], w)
        sums = w.table(scan.running(dense, F.col("step"), "sum", "total"), "sums")
        reach = w.table(scan.running(sums, F.col("total") + F.col("cur"), "max", "v").drop("part", "place"), "reach")
        beside = (F.col("old") == F.col("first")) & F.coalesce((F.col("size") + 1 + F.col("cur") <= room - F.col("beside")), F.lit(False))
        starts = reach.withColumn("with_suggestion", beside).withColumn("room", room - F.when(beside, F.col("beside")).otherwise(null))
        starts = starts.withColumn("stuck", F.col("size") + 1 + F.col("cur") > F.col("room"))
        begins = w.table(starts.select("pos", "k", (F.col("old") == F.col("first")).alias("is_first"), "with_suggestion", "stuck", (F.col("total") - F.col("size") - 1 + F.col("room")).alias("v")), "starts")
        hops = scan.next_rows(reach.select("v", "pos"), begins.where("not stuck").select("v", "pos"), ["v"], False, w)
        own, other = begins.select("pos", F.col("k").alias("a")), begins.select(F.col("pos").alias("next"), F.col("k").alias("b"))
        hops = hops.join(own, "pos").join(other, "next").where("a = b").select("pos", "next")
        chosen = scan.reached(begins.where("is_first").select("pos"), hops, w).withColumn("begins", F.lit(True))
        paged = scan.ranged(begins.join(chosen, "pos", "left"), ["pos"], w, "paged")
        numbers = w.table(scan.running(paged, F.when(F.col("begins"), 1).otherwise(0).cast("long"), "sum", "number"), "numbers")
        held = scan.running(numbers, F.when(F.col("begins"), F.struct("pos", "with_suggestion", "stuck")), "max", "page_start")
        held = scan.running(w.table(held, "held"), F.when(F.col("is_first"), F.col("number")), "max", "base")
        page = F.when(~F.col("page_start.stuck"), F.col("number") - F.col("base") + 1)
        found = held.select("pos", page.alias("page"), F.when(~F.col("page_start.stuck"), F.col("page_start.with_suggestion")).alias("with_suggestion"))
        found = found.join(reach.select("pos", F.col("old").alias("old")), "pos").select(F.col("old").alias("pos"), "page", "with_suggestion")
        whole = told.join(found, "pos", "left").select("row.*", "supported", "unsupported_count", "page", "with_suggestion")
        return materialize(whole, "pages")


def merge_last_wins(pages: DataFrame, key: str, seq: str) -> DataFrame:
    """Pages in one list: the last row of each key, at its first position."""
    rest = [c for c in pages.columns if c not in (key, seq)]
    grouped = pages.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("v"), F.min(seq).alias("position"))
    return grouped.select(key, *(F.col(f"v.{c}").alias(c) for c in rest), "position")

"""Queries that write a store and read it back, and those over hash trees and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import ancestry, hashtree
from millrace.operators.captures import CaptureStore
from millrace.plans.catalog import query
from millrace.sources.tables import _file_system, load, materialize, shared_dir

#: An order's run: known unless it is of low priority; those that are filled capture, and open ones do later.
KNOWN_SQL = "SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'"
JUDGED_SQL = f"""
SELECT o.o_orderkey AS run_id, o.o_totalprice > 400000 AS other, o.o_orderstatus AS s, k.o_orderkey IS NOT NULL AS known FROM orders o LEFT JOIN ({KNOWN_SQL}) k ON k.o_orderkey = o.o_orderkey
"""


def outcome_sql(states: str) -> str:
    """A batch's outcomes, where runs of these states take a capture."""
    return f"CASE WHEN NOT known THEN 'unknownRun' WHEN other THEN 'identityMismatch' WHEN s IN ({states}) THEN 'committed' ELSE 'movedOn' END"


@query(f"""
WITH j AS ({JUDGED_SQL}), e AS (SELECT l_orderkey, count(*) AS entry_count, sum(l_linenumber) AS lines FROM lineitem GROUP BY 1), a AS (SELECT 0 AS batch, run_id, {outcome_sql("'F'")} AS outcome FROM j UNION ALL SELECT 1, run_id, {outcome_sql("'O'")} FROM j)
SELECT a.batch, a.run_id, a.outcome, CASE WHEN outcome = 'committed' THEN coalesce(entry_count, 0) END AS entry_count, CASE WHEN outcome = 'committed' THEN CAST(lines AS BIGINT) END AS lines FROM a LEFT JOIN e ON l_orderkey = run_id
""")
def committed_captures(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs, their lines as entries; two batches of captures, the first given twice, and what the store shows then."""
    orders = load(spark, d, "orders")
    key, none = F.col("o_orderkey"), F.lit(None).cast("long")
    identity = [F.col("o_custkey").cast("string").alias("canonical_path_key"), F.col("o_orderpriority").alias("target"), F.col("o_orderdate").cast("string").alias("target_revision")]
    head = F.concat(F.lit("h"), key.cast("string"))
    open_, filled = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    known = orders.where("o_orderpriority <> '5-LOW'")
    runs = lambda capturing: known.select(key.alias("run_id"), *identity, head.alias("head_revision"), F.when(capturing, "capturing").otherwise("completed").alias("state"), none.alias("captured_at_unix_ms"), none.alias("cancellation_requested_at_unix_ms"))
    made = lambda batch: orders.select(key.alias("run_id"), F.concat(F.lit(f"{batch}-"), key.cast("string")).alias("snapshot_id"), *identity, F.when(F.col("o_totalprice") > 400000, "moved").otherwise(head).alias("head_revision"), F.lit(batch).cast("long").alias("captured_at_unix_ms"))
    lines = lambda batch: load(spark, d, "lineitem").select(F.concat(F.lit(f"{batch}-"), F.col("l_orderkey").cast("string")).alias("snapshot_id"), F.col("l_linenumber").cast("long").alias("line"))
    root = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    store = CaptureStore(spark, root, made(0), lines(0))
    system, where = _file_system(spark, root)
    for batch, capturing in ((0, filled), (0, filled), (1, open_ | filled)):  # the runs' own state isn't updated between batches: the store knows what it has
        store.commit(batch, runs(capturing), made(batch), lines(batch), ["captured_at_unix_ms"])
    system.deleteOnExit(where)
    told = store.outcomes(0).withColumn("batch", F.lit(0)).union(store.outcomes(1).withColumn("batch", F.lit(1)))
    sums = store.entries().groupBy("run_id").agg(F.sum("line").alias("lines"))
    shown = store.headers().join(sums, "run_id", "left").select("snapshot_id", "entry_count", "lines")
    return told.join(shown, "snapshot_id", "left").select("batch", "run_id", "outcome", "entry_count", "lines")


LINES_SQL = "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem"
COPY_SQL = """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' AND quantity = 50 AND l_linenumber = 7 THEN 0 ELSE quantity END AS quantity FROM a WHERE NOT (l_returnflag = 'N' AND quantity = 1 AND l_linenumber = 2)
UNION ALL SELECT * FROM a WHERE l_returnflag = 'A' AND quantity = 2 AND l_linenumber = 3"""


@query(f"""
WITH a AS ({LINES_SQL}), b AS ({COPY_SQL})
SELECT l_orderkey, l_linenumber, l_returnflag, quantity, CAST(sum(x) AS BIGINT) AS n_left, CAST(sum(y) AS BIGINT) AS n_right FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2, 3, 4 HAVING sum(x) <> sum(y)
""")
def differing_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows in which the lines and a copy with changed, missing and repeated ones differ, by descent into unequal nodes of their hash trees."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"))
    changed = F.expr("CASE WHEN l_returnflag = 'R' AND quantity = 50 AND l_linenumber = 7 THEN 0L ELSE quantity END")
    missing = F.expr("l_returnflag = 'N' AND quantity = 1 AND l_linenumber = 2")
    copy = lines.where(~missing).withColumn("quantity", changed).union(lines.where("l_returnflag = 'A' AND quantity = 2 AND l_linenumber = 3"))
    return hashtree.differing(lines, copy)


@query()
def tree_hash(spark: SparkSession, d: str) -> DataFrame:
    """A7 for tables of any size, as the root of a hash tree over all documents; the tests hold trees against hashlib."""
    return hashtree.tree_fingerprint(load(spark, d, "documents"))


#: A document's branch, told by the digest of its text: half of all are of the main branch.
BRANCH_SQL = "CASE WHEN substr(h, 1, 1) < '8' THEN 0 WHEN substr(h, 1, 1) < 'b' THEN 1 WHEN substr(h, 1, 1) < 'e' THEN 2 ELSE 3 END"


def by_branch(of: str, value: str) -> str:
    """The value of branch number ``of``; value has {} where the number goes."""
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {value.format(i)}" for i in range(4)) + " END"


#: Every 8th commit merges the next branch, every 16th is compared; so is each branch's last.
MERGES, COMPARED = "substr(h, 2, 1) < '2'", "substr(h, 3, 1) = 'f'"


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id AS c, doc_id // 1000 AS r, sha256(coalesce(text, '')) AS h FROM documents), k AS (SELECT *, {BRANCH_SQL} AS b FROM d),
l AS (SELECT *, {", ".join(f"max(c) FILTER (b = {i}) OVER w AS m{i}" for i in range(4))} FROM k WINDOW w AS (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT c, p FROM (SELECT c, coalesce({by_branch("b", "m{}")}, m0) AS p FROM l UNION SELECT c, {by_branch("(b + 1) % 4", "m{}")} FROM l WHERE {MERGES}) WHERE p IS NOT NULL),
heads AS (SELECT r, b, max(c) AS c FROM k GROUP BY 1, 2),
pairs AS (SELECT DISTINCT x.c AS "left", m.c AS "right" FROM (SELECT r, c FROM heads UNION SELECT r, c FROM k WHERE {COMPARED}) x JOIN heads m ON m.r = x.r AND m.b = 0),
tips AS (SELECT "left" AS t FROM pairs UNION SELECT "right" FROM pairs), reach AS (SELECT t, t AS c FROM tips UNION SELECT t, p FROM reach JOIN e USING (c)),
common AS (SELECT "left", "right", x.c FROM pairs JOIN reach x ON x.t = "left" JOIN reach y ON y.t = "right" AND y.c = x.c),
best AS (SELECT "left", "right", c AS base FROM common WHERE ("left", "right", c) NOT IN (SELECT ("left", "right", p) FROM common JOIN e USING (c))),
n AS (SELECT t, count(*) AS n FROM reach GROUP BY 1), both_ AS (SELECT "left", "right", count(*) AS n FROM common GROUP BY 1, 2)
SELECT p."left", p."right", x.n - coalesce(q.n, 0) AS ahead, y.n - coalesce(q.n, 0) AS behind, (SELECT count(*) FROM best z WHERE z."left" = p."left" AND z."right" = p."right") AS bases, base
FROM pairs p JOIN n x ON x.t = p."left" JOIN n y ON y.t = p."right" LEFT JOIN both_ q ON q."left" = p."left" AND q."right" = p."right" LEFT JOIN best z ON z."left" = p."left" AND z."right" = p."right"
""")
def merge_bases(spark: SparkSession, d: str) -> DataFrame:
    """Documents as commits of four branches in repositories of 1,000 ids; tips against their main branch, ahead and behind, with a row for each best common ancestor."""
    digests = load(spark, d, "documents").select(F.col("doc_id").alias("commit"), F.expr("doc_id div 1000").alias("repository"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    docs = materialize(digests.withColumn("branch", F.expr(BRANCH_SQL)), "commits")
    before = Window.partitionBy("repository").orderBy("commit").rowsBetween(Window.unboundedPreceding, -1)
    seen = docs.select("*", *(F.max(F.when(F.col("branch") == i, F.col("commit"))).over(before).alias(f"m{i}") for i in range(4)))
    first, merged = F.expr(f"coalesce({by_branch('branch', 'm{}')}, m0)"), F.expr(f"CASE WHEN {MERGES} THEN {by_branch('(branch + 1) % 4', 'm{}')} END")
    commits = seen.select("commit", F.posexplode(F.array(first, merged)).alias("n", "parent"))
    heads = docs.groupBy("repository", "branch").agg(F.max("commit").alias("commit"))
    tips = heads.select("repository", F.col("commit").alias("left")).union(docs.where(COMPARED).select("repository", "commit"))
    pairs = tips.join(heads.where("branch = 0").select("repository", F.col("commit").alias("right")), "repository")
    counts, bases = ancestry.compare_tips(commits, pairs)
    return counts.join(bases.hint("merge"), ["left", "right"], "left").select("left", "right", "ahead", "behind", "bases", "base")

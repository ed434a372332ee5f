"""The engine's queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import canonical as C
from millrace.functions import validators as V
from millrace.operators import classify, lineage, paging, state
from millrace.operators.contract import strict_object
from millrace.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KINDS = ("click", "view", "purchase", "signup", "error")


def query(sql: str | None = None):
    """Register a builder under its own name, with its oracle SQL."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE[build.__name__] = sql
        return build

    return register


@query("SELECT count(DISTINCT user_id) AS users, " + ", ".join(f"count(DISTINCT user_id) FILTER (WHERE event_type = '{k}') AS {k}_users" for k in KINDS) + " FROM events")
def lineage_counts(spark: SparkSession, d: str) -> DataFrame:
    """A1: distinct keys under six predicates, one row."""
    kinds = {f"{k}_users": F.col("event_type") == k for k in KINDS}
    return lineage.distinct_counts(load(spark, d, "events"), "user_id", {"users": F.lit(True)} | kinds)


@query("SELECT conv_id * 1000 + min(turn) AS root, count(*) AS n FROM conversations GROUP BY conv_id")
def lineage_components(spark: SparkSession, d: str) -> DataFrame:
    """G1: each turn is linked to the one before it; the components' least turns and sizes."""
    turns = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "turn")
    edges = turns.where("turn > 0").select(F.col("node").alias("a"), (F.col("node") - 1).alias("b"))
    return lineage.components(edges, turns).groupBy("root").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey AS id, o_orderstatus AS label, true AS is_order, false AS is_event FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT event_id, event_type, false, true FROM events
""")
def union_records(spark: SparkSession, d: str) -> DataFrame:
    """Two projections with flags, one of them filtered, repeats kept."""
    orders = load(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), F.lit(True).alias("is_order"), F.lit(False).alias("is_event"))
    events = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.lit(False).alias("is_order"), F.lit(True).alias("is_event"))
    return orders.unionByName(events)


CLASS_SQL = """CASE WHEN p_size > 45 THEN 'unsupported' WHEN p_type = 'PROMO' THEN 'default' WHEN p_name LIKE 'red %' THEN 'local'
WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'remote' ELSE 'unsupported' END"""


@query(f"SELECT {CLASS_SQL} AS class, count(*) AS n, count(*) FILTER (WHERE {CLASS_SQL} = 'unsupported') AS unsupported FROM part GROUP BY 1")
def classify_case(spark: SparkSession, d: str) -> DataFrame:
    """First condition that holds, and the count of unsupported rows."""
    cases = [(F.col("p_size") > 45, "unsupported"), (F.col("p_type") == "PROMO", "default"), (F.col("p_name").startswith("red "), "local"), (F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), "remote")]
    parts = load(spark, d, "part").select(classify.first_match(cases, "unsupported").alias("class"))
    return parts.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "unsupported").alias("unsupported"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def search_ci(spark: SparkSession, d: str) -> DataFrame:
    """Substring in any case."""
    return load(spark, d, "part").where(classify.search(F.col("p_name"), "RED")).select("p_partkey", "p_name")


@query("""
SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'conflicts'
WHEN count(*) FILTER (WHERE o_orderstatus = 'O') = 0 AND count(*) FILTER (WHERE o_orderpriority LIKE '1%') = 0 THEN 'empty' ELSE 'ready' END AS readiness
FROM orders GROUP BY o_custkey
""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """A state from aggregates."""
    n = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("u"))
    return n.select("o_custkey", lineage.readiness(F.col("p"), F.col("o"), F.col("u")).alias("readiness"))


@query(
    "SELECT user_id, concat_ws(', ', " + ", ".join(f"CASE WHEN {k} > 0 THEN {k} || ' {k}' END" for k in KINDS) + ") AS facts FROM (SELECT user_id, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id)"
)
def facts_text(spark: SparkSession, d: str) -> DataFrame:
    """The counts that aren't zero, as text."""
    n = load(spark, d, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in KINDS))
    return n.select("user_id", classify.nonzero_clauses({k: F.col(k) for k in KINDS}).alias("facts"))


@query("""
WITH best AS (SELECT s_nationkey, arg_max(s_name, (s_acctbal, -s_suppkey)) AS s_name FROM supplier GROUP BY 1),
regional AS (SELECT n_regionkey, arg_max(s_name, (s_acctbal, -s_suppkey)) AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey, coalesce(b.s_name, r.s_name) AS suggested FROM nation LEFT JOIN best b ON b.s_nationkey = n_nationkey LEFT JOIN regional r USING (n_regionkey)
""")
def suggest_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Two lookups, the first that finds something wins."""
    nation = load(spark, d, "nation")
    supplier = load(spark, d, "supplier")
    top = F.max_by("s_name", F.struct("s_acctbal", -F.col("s_suppkey")))
    best = supplier.groupBy("s_nationkey").agg(top.alias("own")).withColumnRenamed("s_nationkey", "n_nationkey")
    regional = supplier.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey").groupBy("n_regionkey").agg(top.alias("other"))
    return nation.join(best, "n_nationkey", "left").join(regional, "n_regionkey", "left").select("n_nationkey", F.coalesce("own", "other").alias("suggested"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left_outer_last(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the left, matched or not."""
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_member(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a match."""
    return classify.members(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a match."""
    return classify.excluded(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels"), "doc_id")


@query("""
WITH prefixes AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS prefix FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)/', 1) FROM pages WHERE page_id % 3 = 0)
SELECT page_id, (SELECT arg_max(prefix, length(prefix)) FROM prefixes WHERE prefix <> '' AND starts_with(url, prefix || '/') AND length(url) > length(prefix) + 1) AS prefix FROM pages
""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The longest of many prefixes that ends at a slash."""
    pages = load(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("prefix"))
    roots = pages.where("page_id % 3 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[^/]+)/", 1).alias("prefix"))
    return classify.longest_prefix(pages, "url", hosts.union(roots).where("prefix <> ''").distinct()).select("page_id", "prefix")


@query()
def longest_prefix_all(spark: SparkSession, d: str) -> DataFrame:
    """J5 with the prefixes of all pages; the tests hold it against brute force, as the SQL compares every page with every prefix."""
    pages = load(spark, d, "pages").select("page_id", "url")
    found = [pages.select(F.regexp_extract("url", p, 1).alias("prefix")) for p in ("^(https?://[^/]+)", "^(https?://[^/]+/[^/]+)/")]
    return classify.longest_prefix(pages, "url", found[0].union(found[1]).where("prefix <> ''").distinct()).select("page_id", "prefix")


@query("SELECT (SELECT count(*) FROM ((SELECT * FROM region EXCEPT ALL SELECT * FROM region) UNION ALL (SELECT * FROM region EXCEPT ALL SELECT * FROM region))) = 0 AS equal")
def multiset_equal(spark: SparkSession, d: str) -> DataFrame:
    """A table and its reordered copy hold the same rows as often."""
    region = load(spark, d, "region")
    return classify.multiset_equal(region, region.orderBy(F.desc("r_name")))


COPY_SQL = {
    "reordered": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "changed": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linenumber = 1 THEN -1 ELSE l_quantity END FROM lineitem",
    "repeated": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem UNION ALL (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY 1, 2, 3 LIMIT 1)",
}


@query(" UNION ALL ".join(
    f"SELECT '{k}' AS copy, (SELECT count(*) FROM (({COPY_SQL['reordered']} EXCEPT ALL ({c})) UNION ALL (({c}) EXCEPT ALL {COPY_SQL['reordered']}))) = 0 AS equal" for k, c in COPY_SQL.items()
))
def multiset_copies(spark: SparkSession, d: str) -> DataFrame:
    """J6 on a large table: a reordered copy, one in which a row differs, and one in which a row is once more there."""
    items = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    least = items.agg(F.min("l_orderkey").alias("least"))
    hit = (F.col("l_orderkey") == F.col("least")) & (F.col("l_linenumber") == 1)
    changed = items.join(F.broadcast(least)).select("l_orderkey", "l_linenumber", F.when(hit, F.lit(-1).cast(items.schema["l_quantity"].dataType)).otherwise(F.col("l_quantity")).alias("l_quantity"))
    copies = {"reordered": items.repartition("l_quantity"), "changed": changed, "repeated": items.union(items.orderBy(*items.columns).limit(1))}
    rows = [classify.multiset_equal(items, c).select(F.lit(k).alias("copy"), "equal") for k, c in copies.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """A3: texts that occur more than once, by digest."""
    return lineage.duplicate_keys(load(spark, d, "documents"), F.sha2("text", 256))


@query("SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    """A4: every key with its count, 0 included."""
    supplier = load(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return lineage.zero_filled_counts(load(spark, d, "nation"), supplier, "n_nationkey")


HASH_SQL = """sha256(unhex('000000027631' || printf('%08x', strlen(count(*)::varchar)) || hex(encode(count(*)::varchar))
|| string_agg(printf('%08x', strlen(n_nationkey::varchar)) || hex(encode(n_nationkey::varchar)) || printf('%08x', strlen(n_name)) || hex(encode(n_name)), '' ORDER BY n_nationkey)))"""


@query(f"SELECT n_regionkey, {HASH_SQL} AS fingerprint, count(*) AS record_count FROM nation GROUP BY n_regionkey")
def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    """One fingerprint for each region, over its nations in order."""
    body = C.record(C.field(F.col("n_nationkey").cast("string")), C.field(F.col("n_name")))
    return C.fingerprint(load(spark, d, "nation"), C.field("v1"), [F.col("n_nationkey")], body, ["n_regionkey"])


@query()
def bulk_hash(spark: SparkSession, d: str) -> DataFrame:
    """A7 for tables of any size: one fingerprint of all documents; the tests hold it against hashlib."""
    body = C.record(C.nullable("text", F.col("text")), C.nullable("lang", F.col("lang")))
    return C.bulk_fingerprint(load(spark, d, "documents"), "doc_id", body)


LAST_SQL = "SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1"


def _last_orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))


@query(f"SELECT o_custkey, last FROM ({LAST_SQL}) ORDER BY last DESC, o_custkey LIMIT 20")
def recent_top20(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20."""
    return paging.recent_top(_last_orders(spark, d), "last", "o_custkey")


@query(f"SELECT o_custkey, last FROM ({LAST_SQL}) QUALIFY row_number() OVER (ORDER BY last DESC, o_custkey) > 20")
def retention_rest(spark: SparkSession, d: str) -> DataFrame:
    """All but the newest 20."""
    return paging.retention_victims(_last_orders(spark, d), "last", "o_custkey")


@query("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1")
def next_pending(spark: SparkSession, d: str) -> DataFrame:
    """The first of each status."""
    return paging.next_per_key(load(spark, d, "orders"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], [])


@query("SELECT p_type, p_name, p_partkey FROM part WHERE (p_type, p_name, p_partkey) > ('LARGE', 'm', 50) ORDER BY 1, 2, 3 LIMIT 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """100 rows after a cursor."""
    return paging.keyset_page(load(spark, d, "part").select("p_type", "p_name", "p_partkey"), ["p_type", "p_name", "p_partkey"], ("LARGE", "m", 50), 100)


@query("""
SELECT p_partkey, p_name, running FROM (SELECT *, sum(strlen(p_name) + strlen(p_brand) + strlen(p_type) + 10) OVER (ORDER BY p_name, p_partkey ROWS UNBOUNDED PRECEDING)::bigint AS running FROM part)
WHERE running <= 5000
""")
def byte_budget_page(spark: SparkSession, d: str) -> DataFrame:
    """The rows that fit a byte budget."""
    size = F.octet_length("p_name") + F.octet_length("p_brand") + F.octet_length("p_type") + 10
    return paging.byte_budget_page(load(spark, d, "part"), ["p_name", "p_partkey"], size, 5000).select("p_partkey", "p_name", "running")


@query("""
WITH pages AS (SELECT doc_id, lang, n_chars, doc_id AS seq FROM documents UNION ALL SELECT doc_id, 'xx', n_chars + 1, doc_id + 1000000000 FROM documents WHERE doc_id % 7 = 0)
SELECT doc_id, arg_max(lang, seq) AS lang, arg_max(n_chars, seq) AS n_chars, min(seq) AS position FROM pages GROUP BY doc_id
""")
def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each key at its first position."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars", F.col("doc_id").alias("seq"))
    over = docs.where("doc_id % 7 = 0").select("doc_id", F.lit("xx").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"), (F.col("seq") + 1_000_000_000).alias("seq"))
    return paging.merge_last_wins(docs.unionByName(over), "doc_id", "seq")


@query("""
SELECT o_custkey, o_orderkey, first_value(o_orderkey) OVER w AS active_run, o_orderkey = first_value(o_orderkey) OVER w AS accepted
FROM orders WHERE o_orderstatus = 'O' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def one_active_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The first active row of each key holds it, the others are refused."""
    active = load(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderdate")
    return state.one_active(active, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey", "active_run", "accepted")


#: The events' kinds as steps of a run; what a step may start from is in the transition table.
STEPS = {"signup": "capture", "view": "discover", "click": "collect", "purchase": "persist", "error": "complete"}


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, 0::bigint AS i, 'pendingCapture' AS state FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.i, CASE WHEN event_type = 'signup' AND state = 'pendingCapture' THEN 'capturing' WHEN event_type = 'view' AND state = 'capturing' THEN 'discovering'
WHEN event_type = 'click' AND state = 'discovering' THEN 'collecting' WHEN event_type = 'purchase' AND state = 'collecting' THEN 'persisting'
WHEN event_type = 'error' AND state = 'persisting' THEN 'completed' ELSE state END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, arg_max(state, i) AS state, max(i) AS events FROM f GROUP BY user_id
""")
def state_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events in order, through the transition table."""
    steps = F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv))
    events = load(spark, d, "events").select("user_id", "ts", "event_id", F.try_element_at(steps, F.col("event_type")).alias("event"))
    return state.fold_runs(events, "user_id", ["ts", "event_id"], "event")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'interrupted' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus IN ('O', 'P') AS changed FROM orders")
def bulk_transition(spark: SparkSession, d: str) -> DataFrame:
    """All rows in some states move to another."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return state.bulk_transition(orders, "o_orderstatus", F.col("o_orderstatus").isin("O", "P"), "interrupted")


@query("""
SELECT c AS "constraint", l_orderkey * 10 + l_linenumber AS key FROM (SELECT *, unnest(list_filter([CASE WHEN NOT l_quantity < 45 THEN 'quantity' END, CASE WHEN NOT l_discount <= 0.08 THEN 'discount' END,
CASE WHEN NOT ((l_returnflag = 'R') = (l_linestatus = 'F')) THEN 'flags' END], lambda x: x IS NOT NULL)) AS c FROM lineitem)
""")
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    """The rows that fail each named check."""
    rows = load(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    checks = {"quantity": F.col("l_quantity") < 45, "discount": F.col("l_discount") <= 0.08, "flags": (F.col("l_returnflag") == "R") == (F.col("l_linestatus") == "F")}
    return state.violations(rows, "k", checks)


@query("""
SELECT doc_id, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS token, length(text) AS scalars, strlen(text) AS bytes, strlen(text) <= 4096 AS bounded,
regexp_matches(text, '[^\\s]') AS non_blank, regexp_full_match(left(sha256(text), 40), '[0-9a-f]{40}|[0-9a-f]{64}') AS object_id FROM documents
""")
def validators(spark: SparkSession, d: str) -> DataFrame:
    """F1, F3, F9, F10, F20 over texts."""
    text = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", V.is_token(F.sha2(text, 256)).alias("token"), F.length(text).cast("long").alias("scalars"), F.octet_length(text).cast("long").alias("bytes"),
        V.bounded_utf8(text, 4096).alias("bounded"), V.non_blank(text).alias("non_blank"), V.is_object_id(F.substring(F.sha2(text, 256), 1, 40)).alias("object_id"),
    )


@query("SELECT event_id, json_keys(props) = ['k'] AS strict, (props ->> 'k')::int AS k FROM events")
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    """an object with exactly the known members, and its typed value."""
    return load(spark, d, "events").select("event_id", strict_object(F.col("props"), ("k",), ("k",)).alias("strict"), F.from_json("props", "k int").k.alias("k"))


@query("""
SELECT page_id, CASE WHEN url = root THEN 'site' WHEN starts_with(url, root || '/') THEN 'site' || substr(url, length(root) + 1) ELSE '<outside>' END AS relative
FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) ELSE 'http://elsewhere' END AS root FROM pages)
""")
def relative_path(spark: SparkSession, d: str) -> DataFrame:
    """the part of a path below a root."""
    root = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("url", "^(https?://[^/]+)", 1)).otherwise("http://elsewhere")
    return load(spark, d, "pages").select("page_id", V.relative_path(F.col("url"), root, F.lit("site")).alias("relative"))


@query("SELECT user_id, event_id FROM events QUALIFY date_trunc('day', ts) = max(date_trunc('day', ts)) OVER (PARTITION BY user_id)")
def latest_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each user's last day."""
    events = load(spark, d, "events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    return state.latest_epoch(events, "user_id", "day").select("user_id", "event_id")


RUN_SQL = "user_id * 10 + (day(ts) - 1) // 7"
EVENT_SQL = "CASE event_type WHEN 'signup' THEN 'capture' WHEN 'view' THEN 'discover' WHEN 'click' THEN 'collect' WHEN 'purchase' THEN 'persist' ELSE ['complete', 'completeWithLimitations', 'fail', 'cancel', 'interrupt'][(event_id % 5 + 1)::int] END"
AFTER_SQL = "CASE " + " ".join(f"WHEN event = '{e}' AND state IN ({', '.join(repr(s) for s in sources)}) THEN '{to}'" for e, (to, sources) in state.TRANSITIONS.items()) + " ELSE state END"
OBSERVED_SQL = f"""
WITH RECURSIVE e AS (SELECT {RUN_SQL} AS run, ts, event_id, {EVENT_SQL} AS event, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT run, 0::bigint AS i, NULL::timestamp AS ts, NULL::bigint AS event_id, '' AS event, '' AS before, 'pendingCapture' AS state FROM (SELECT DISTINCT run FROM e)
UNION ALL SELECT e.run, e.i, e.ts, e.event_id, e.event, f.state, {AFTER_SQL.replace("event =", "e.event =").replace("state IN", "f.state IN").replace("ELSE state", "ELSE f.state")} FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1)
"""


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Each user's week is a run; the kinds of events and, for errors, their number tell what the run is asked to do."""
    kinds = F.create_map(*(F.lit(x) for kv in {"signup": "capture", "view": "discover", "click": "collect", "purchase": "persist"}.items() for x in kv))
    ends = F.array(*map(F.lit, ("complete", "completeWithLimitations", "fail", "cancel", "interrupt")))
    event = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.get(ends, (F.col("event_id") % 5).cast("int")))
    run = F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)
    return state.observed_states(load(spark, d, "events").select(run.alias("run"), "ts", "event_id", event.alias("event")), "run", ["ts", "event_id"], "event")


@query(OBSERVED_SQL + "SELECT run, event_id, event, before AS state_before, before <> state AS accepted, state AS state_after FROM f WHERE i > 0")
def observed_states(spark: SparkSession, d: str) -> DataFrame:
    """Every event's state before and after, and whether it was accepted."""
    return _observed(spark, d).select("run", "event_id", "event", "state_before", "accepted", "state_after")


@query(OBSERVED_SQL + """SELECT run, arg_max(state, i) AS state, min(ts) FILTER (WHERE before <> state AND state = 'discovering') AS analysis_started_at,
min(ts) FILTER (WHERE before <> state AND state IN ('completed', 'completedWithLimitations', 'cancelled', 'failed')) AS terminal_at,
min(ts) FILTER (WHERE before <> state AND state = 'interrupted') AS interrupted_at, count(*) FILTER (WHERE before <> state) AS accepted_events FROM f WHERE i > 0 GROUP BY run""")
def run_times(spark: SparkSession, d: str) -> DataFrame:
    """Each run's state, when it entered discovering and when it ended, from its observed events."""
    return state.run_times(_observed(spark, d), "run", ["ts", "event_id"], "ts")


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS run, o_orderdate AS t, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days((o_orderkey % 400)::int) END AS e FROM orders),
n AS (SELECT run, (SELECT arg_min(p.run, (p.t, p.run)) FROM o p WHERE p.k = o.k AND p.t >= o.e AND (p.t, p.run) > (o.t, o.run)) AS nxt FROM o),
a AS (SELECT arg_min(run, (t, run)) AS run FROM o GROUP BY k UNION ALL SELECT nxt FROM a JOIN n USING (run) WHERE nxt IS NOT NULL),
h AS (SELECT o.* FROM o JOIN a USING (run))
SELECT o.k AS o_custkey, o.run AS o_orderkey, o.run IN (SELECT run FROM a) AS accepted, (SELECT arg_max(h.run, (h.t, h.run)) FROM h WHERE h.k = o.k AND (h.t, h.run) <= (o.t, o.run)) AS active_run FROM o
""")
def admitted_requests(spark: SparkSession, d: str) -> DataFrame:
    """D1 over time: an order is accepted if its customer has no accepted one that is still open; some never close."""
    orders = load(spark, d, "orders")
    closed = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 400).cast("int")))
    return state.admitted(orders.select("o_custkey", "o_orderkey", "o_orderdate", closed.alias("closed")), "o_custkey", "o_orderdate", "o_orderkey", "closed").select("o_custkey", "o_orderkey", "accepted", "active_run")


@query("""
WITH RECURSIVE r AS (SELECT p_brand AS k, p_partkey, strlen(p_name) * p_size AS size, strlen(p_name) + 2 AS cur, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS sugg,
row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS i FROM part),
l AS (SELECT k, d, max(i) FILTER (WHERE 50 + size + 8 + d <= 700) AS last FROM r, range(1, 11) t(d) GROUP BY ALL),
u AS (SELECT k, d, any_value(last) AS last, count(*) - count(*) FILTER (WHERE i = last OR (i < last AND 50 + size + 4 + cur + d <= 700)) AS unfit FROM r JOIN l USING (k) GROUP BY ALL),
c AS (SELECT DISTINCT k, 0 AS step, 0::bigint AS n FROM r UNION ALL SELECT c.k, step + 1, unfit FROM c JOIN u ON u.k = c.k AND u.d = length(c.n::varchar) WHERE step < 10),
f AS (SELECT k, n, length(n::varchar) AS d, last FROM c JOIN u USING (k) WHERE step = 10 AND u.d = length(n::varchar)),
s AS (SELECT r.*, f.n, 700 - 45 - f.d + 1 AS room, coalesce(i = last OR (i < last AND 50 + size + 4 + cur + f.d <= 700), false) AS ok, CASE WHEN i = last THEN 4 ELSE cur END AS c2 FROM r JOIN f USING (k)),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS j, max(size) FILTER (WHERE sugg) OVER (PARTITION BY k) AS sb FROM s WHERE ok),
v AS (SELECT *, j = 1 AND coalesce(size + 1 + c2 <= room - sb, false) AS fits FROM t),
p AS (SELECT k, j, p_partkey, 1 AS page, size + 1 AS used, fits FROM v WHERE j = 1
UNION ALL SELECT v.k, v.j, v.p_partkey, CASE WHEN p.used + v.size + 1 + v.c2 <= v.room - CASE WHEN p.fits THEN v.sb ELSE 4 END THEN p.page ELSE p.page + 1 END,
CASE WHEN p.used + v.size + 1 + v.c2 <= v.room - CASE WHEN p.fits THEN v.sb ELSE 4 END THEN p.used + v.size + 1 ELSE v.size + 1 END,
CASE WHEN p.used + v.size + 1 + v.c2 <= v.room - CASE WHEN p.fits THEN v.sb ELSE 4 END THEN p.fits ELSE v.fits END FROM p JOIN v ON v.k = p.k AND v.j = p.j + 1)
SELECT s.p_partkey, ok AS supported, n AS unsupported_count, page::bigint AS page, p.fits AS with_suggestion FROM s LEFT JOIN p USING (p_partkey)
""")
def all_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every brand's parts in pages of 700 bytes, the brand's first part as suggestion of the first page; parts that fit no page are counted in the page."""
    part = load(spark, d, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    first = part.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("least"))
    rows = part.join(first, (part["p_brand"] == first["brand"]) & (part["p_partkey"] == first["least"]), "left")
    name = F.octet_length("p_name")
    found = paging.pages(rows, "p_brand", ["p_name", "p_partkey"], name * F.col("p_size"), name + 2, F.lit(45), F.lit(50), 700, F.col("least").isNotNull())
    return found.select("p_partkey", "supported", "unsupported_count", "page", "with_suggestion")

"""Queries over the driver's tables for the smaller operators, negative cases included, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import validators as V
from millrace.operators import classify, contract, fingerprint, lineage, paging, state
from millrace.plans.catalog import query
from millrace.sources.tables import load


def pick(values, index: Column) -> Column:
    """The value at an index, modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def picked(values, index: str) -> str:
    """The same in SQL."""
    return "list_extract([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"], ({index}) % {len(values)} + 1)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, event_type and i, which is event_id."""
    return load(spark, d, "events").select("event_id", "user_id", "event_type", F.col("event_id").alias("i"))


@query(f"SELECT event_id, CASE {picked('AMDRT', 'event_id')} WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' ELSE 'typeChanged' END AS category FROM events")
def change_categories(spark: SparkSession, d: str) -> DataFrame:
    """P5: the category of each change letter."""
    return events(spark, d).select("event_id", classify.change_category(pick("AMDRT", F.col("i"))).alias("category"))


ACTIVE_SQL = ", ".join(f"'{s}'" for s in classify.ACTIVE)


@query(f"SELECT event_id, s AS state, s IN ({ACTIVE_SQL}) AS active FROM (SELECT event_id, {picked(classify.STATES, 'event_id')} AS s FROM events)")
def stored_states(spark: SparkSession, d: str) -> DataFrame:
    """States as they are stored, and whether they are active."""
    s = pick(classify.STATES, F.col("i"))
    return events(spark, d).select("event_id", classify.state_literal(s).alias("state"), classify.is_active(s).alias("active"))


@query("SELECT event_id, CASE WHEN (CASE WHEN event_type <> 'error' THEN (user_id % 3)::varchar END) = '1' THEN 'current' ELSE 'stale' END AS freshness FROM events")
def freshness_states(spark: SparkSession, d: str) -> DataFrame:
    """Current for an equal token, stale for another and for none."""
    token = F.when(F.col("event_type") != "error", (F.col("user_id") % 3).cast("string"))
    return events(spark, d).select("event_id", classify.freshness(token, F.lit("1")).alias("freshness"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'noRemote' WHEN event_type = 'click' THEN 'current' ELSE 'moved' END AS baseline FROM events")
def baseline_states(spark: SparkSession, d: str) -> DataFrame:
    """No remote, current or moved."""
    return events(spark, d).select("event_id", classify.baseline(F.col("user_id") % 2, F.col("event_type"), F.lit("click")).alias("baseline"))


@query("SELECT event_id, CASE WHEN event_id % 5 < event_id // 5 % 5 THEN 'complete' WHEN event_id % 5 = event_id // 5 % 5 THEN 'active' ELSE 'pending' END AS progress FROM events")
def stage_states(spark: SparkSession, d: str) -> DataFrame:
    """Each stage against the current one."""
    return events(spark, d).select("event_id", classify.stage_progress(pick(classify.STAGES, F.col("i")), pick(classify.STAGES, F.floor(F.col("i") / 5))).alias("progress"))


SAID = ("fatal: Not a git repository", "Permission denied here", "warning: Needed a single revision", "unsafe repository, not a git repository", "fatal: could not read Username", "Permission denied (publickey).", "boom")


@query(
    f"""SELECT event_id, CASE WHEN contains(t, 'not a git repository') THEN 'notGitRepository' WHEN contains(t, 'unsafe repository') OR contains(t, 'permission denied') THEN 'accessDenied'
WHEN contains(t, 'needed a single revision') THEN 'headUnavailable' ELSE 'inspectionFailed' END AS local_class,
CASE WHEN contains(t, 'could not read username') OR contains(t, 'permission denied (publickey') THEN 'remoteAuthenticationRequired' ELSE 'remoteUnreachable' END AS remote_class
FROM (SELECT event_id, lower({picked(SAID, 'event_id')}) AS t FROM events)"""
)
def diagnostic_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of diagnostics, of local and of remote tools."""
    said = pick(SAID, F.col("i"))
    return events(spark, d).select("event_id", classify.classify_diagnostic(said).alias("local_class"), classify.classify_diagnostic(said, True).alias("remote_class"))


@query("SELECT o_custkey, CASE WHEN n = 0 THEN 'unrelated' WHEN n = 1 THEN 'single' ELSE 'ambiguous' END AS bases FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS n FROM orders GROUP BY 1)")
def merge_base_states(spark: SparkSession, d: str) -> DataFrame:
    """None, one or several bases."""
    n = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    return n.select("o_custkey", classify.merge_base_state(F.col("n")).alias("bases"))


@query("SELECT event_id, epoch_us(ts::timestamp) // 1000 AS ms FROM events")
def epoch_times(spark: SparkSession, d: str) -> DataFrame:
    """milliseconds since 1970."""
    return load(spark, d, "events").select("event_id", classify.epoch_ms(F.col("ts").cast("timestamp")).alias("ms"))


RUN_STATE_SQL = "CASE o_orderstatus WHEN 'O' THEN 'collecting' WHEN 'P' THEN 'pendingCapture' ELSE 'completed' END"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of their customers' repositories."""
    status = F.when(F.col("o_orderstatus") == "O", "collecting").when(F.col("o_orderstatus") == "P", "pendingCapture").otherwise("completed")
    return load(spark, d, "orders").select(F.col("o_custkey").alias("canonical_repository_path_key"), F.col("o_orderkey").alias("run_id"), status.alias("state"))


@query("SELECT c_custkey AS canonical_path_key, o_orderkey AS run_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus IN ('O', 'P')")
def active_runs(spark: SparkSession, d: str) -> DataFrame:
    """Repositories with their active runs, if any."""
    entries = load(spark, d, "customer").select(F.col("c_custkey").alias("canonical_path_key"))
    return classify.active_run_of(entries, runs(spark, d))


REFUSED_SQL = ", ".join(f"'{a}'" for a in contract.REFUSED_WHILE_ACTIVE)


@query(
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalidJson' WHEN a IN ({REFUSED_SQL}) AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')) THEN 'repositoryBusy' END AS error
FROM (SELECT *, {picked(contract.ACTIONS, 'event_id')} AS a FROM events)"""
)
def busy_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that an active run's repository refuses; bad ones keep their error."""
    asked = events(spark, d).select("event_id", F.col("user_id").alias("canonical_path_key"), pick(list(contract.ACTIONS), F.col("i")).alias("action"), F.when(F.col("event_type") == "error", "invalidJson").alias("error"))
    active = runs(spark, d).where(classify.is_active(F.col("state"))).select(F.col("canonical_repository_path_key").alias("canonical_path_key"))
    return contract.refuse_busy(asked, active).select("event_id", "error")


@query("SELECT user_id AS run_id, nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS limitation_count FROM events GROUP BY 1")
def limitation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Steps with limitations, null for none."""
    step = F.when(F.col("event_type") == "error", "succeededWithLimitations").otherwise("succeeded")
    return lineage.limitation_count(events(spark, d).select(F.col("user_id").alias("run_id"), step.alias("state")))


@query("""
WITH e AS (SELECT user_id AS run_id, event_id % 7 AS step_id, event_id AS m, event_type AS t FROM events),
s AS (SELECT run_id, step_id, min(m) FILTER (WHERE t IN ('view', 'click')) AS b, min(m) FILTER (WHERE t = 'purchase' OR t = 'error') AS f FROM e GROUP BY 1, 2)
SELECT s.run_id, s.step_id, b AS started_at, CASE WHEN f >= b THEN f END AS finished_at,
CASE WHEN f >= b THEN (SELECT any_value(CASE t WHEN 'error' THEN 'failed' ELSE 'succeeded' END) FROM e WHERE e.run_id = s.run_id AND e.step_id = s.step_id AND e.m = s.f) WHEN b IS NOT NULL THEN 'running' ELSE 'pending' END AS state FROM s
""")
def step_states(spark: SparkSession, d: str) -> DataFrame:
    """Steps from their begin and finish events."""
    kind = F.when(F.col("event_type").isin("view", "click"), "begin").when(F.col("event_type").isin("purchase", "error"), "finish")
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded")
    return state.step_fold(events(spark, d).select(F.col("user_id").alias("run_id"), (F.col("i") % 7).alias("step_id"), F.col("i").alias("at"), kind.alias("event"), outcome.alias("outcome")))


@query(f"""
SELECT o_orderkey AS run_id, CASE WHEN s IN ({ACTIVE_SQL}) THEN coalesce(old, asked) ELSE old END AS cancelled_at FROM (SELECT o_orderkey, {RUN_STATE_SQL} AS s, CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS old FROM orders)
LEFT JOIN (SELECT user_id, min(event_id) AS asked FROM events GROUP BY 1) ON user_id = o_orderkey
""")
def first_cancellations(spark: SparkSession, d: str) -> DataFrame:
    """The first cancellation of an active run sticks."""
    old = runs(spark, d).withColumn("cancellation_requested_at_unix_ms", F.when(F.col("run_id") % 4 == 0, F.lit(1)).cast("long"))
    asked = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("i").alias("at"))
    return state.request_cancel(old, asked).select("run_id", F.col("cancellation_requested_at_unix_ms").alias("cancelled_at"))


@query("SELECT user_id AS run_id, min(event_id) AS first_at, arg_min(event_type, event_id) AS kind FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def new_captures(spark: SparkSession, d: str) -> DataFrame:
    """Of each run that isn't stored yet, the first capture."""
    stored = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    return state.commit_captures(stored, events(spark, d).select(F.col("user_id").alias("run_id"), F.col("i").alias("first_at"), F.col("event_type").alias("kind")), ["first_at"])


@query(f"SELECT o_orderkey AS run_id, CASE WHEN s IN ({ACTIVE_SQL}) THEN 'interrupted' ELSE s END AS state, CASE WHEN s IN ({ACTIVE_SQL}) THEN 77 END AS interrupted_at FROM (SELECT o_orderkey, {RUN_STATE_SQL} AS s FROM orders)")
def recovered_runs(spark: SparkSession, d: str) -> DataFrame:
    """At a start, active runs become interrupted."""
    found = state.recover(runs(spark, d).withColumn("interrupted_at_unix_ms", F.lit(None).cast("long")), 77)
    return found.select("run_id", "state", F.col("interrupted_at_unix_ms").alias("interrupted_at"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    """Children of deleted parents go."""
    customers = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return state.delete_cascade(customers, customers.where("c_acctbal < 0"), load(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey")[1].select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def nulled_references(spark: SparkSession, d: str) -> DataFrame:
    """References to deleted rows become null."""
    gone = load(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return state.set_null(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_versions(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each key."""
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return state.latest_per_key(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 15 = 0 THEN 'path,target' WHEN o_orderkey % 3 = 0 THEN 'path' ELSE 'target' END AS columns FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def identity_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Manifests whose identity differs from their run's; one side is null in some."""
    made = load(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("path"), F.col("o_orderpriority").alias("target"))
    other = made.select("run_id", F.when(F.col("run_id") % 3 != 0, F.col("path")).alias("path"), F.when(F.col("run_id") % 5 == 0, "x").otherwise(F.col("target")).alias("target"))
    return fingerprint.identity_violations(other, made, ["path", "target"]).select("run_id", F.array_join("columns", ",").alias("columns"))


@query("SELECT 'same' AS reading, false AS changed UNION ALL SELECT 'one row less', true UNION ALL SELECT 'one value', true")
def changed_readings(spark: SparkSession, d: str) -> DataFrame:
    """Whether a second reading differs from the first."""
    first = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    least = first.agg(F.min("o_orderkey")).first()[0]
    other = {"same": first.repartition("o_orderstatus"), "one row less": first.where(F.col("o_orderkey") != least), "one value": first.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == least, "?").otherwise(F.col("o_orderstatus")))}
    rows = [fingerprint.changed_between(first, o, first.columns).select(F.lit(k).alias("reading"), "changed") for k, o in other.items()]
    return rows[0].union(rows[1]).union(rows[2])


BEFORE, AFTER = ("refs/heads/", "refs/remotes/", "refs/tags/", "heads/", ""), ("", "/.x", "/a.lock", "..b", "//c", "@{d", " e", "/", ".", "~1", "/f/g")
NAME_SQL = f"{picked(BEFORE, 'page_id')} || regexp_replace(url, '^https?://', '') || {picked(AFTER, 'page_id // 5')}"


@query(f"""
SELECT page_id, ok AS full_ref, ok AND length(n) <= 4096 AND regexp_matches(n, '^refs/(heads/.|remotes/[^/]+/.)') AS target_ref FROM (SELECT page_id, n, starts_with(n, 'refs/') AND length(n) > 5 AND NOT contains(n, '..') AND NOT contains(n, '@{{')
AND NOT regexp_matches(n, '[ ~^:?*\\[\\\\]') AND NOT regexp_matches(n, '[/.]$') AND len(list_filter(string_split(n, '/'), lambda p: p = '' OR starts_with(p, '.') OR ends_with(p, '.lock'))) = 0 AS ok FROM (SELECT page_id, {NAME_SQL} AS n FROM pages))
""")
def reference_names(spark: SparkSession, d: str) -> DataFrame:
    """Good and bad reference names."""
    i = F.col("page_id")
    name = F.concat(pick(BEFORE, i), F.regexp_replace("url", "^https?://", ""), pick(AFTER, F.floor(i / 5)))
    return load(spark, d, "pages").select("page_id", V.is_full_ref(name).alias("full_ref"), V.is_target_ref(name).alias("target_ref"))


OIDS = ("0" * 40, "a" * 40, "b" * 40)
TYPES_SQL = {m: {"100644": "f", "100755": "f", "120000": "l", "160000": "g"}.get(m, "") for m in V.MODES}
GRID_SQL = f"""SELECT event_id, {picked('ADMTR', 'event_id // 225')} AS s, {picked(V.MODES, 'event_id')} AS m, {picked(V.MODES, 'event_id // 5')} AS n, {picked(OIDS, 'event_id // 25')} AS o, {picked(OIDS, 'event_id // 75')} AS p FROM events"""
TYPE_SQL = "CASE WHEN {0} IN ('100644', '100755') THEN 'f' WHEN {0} = '120000' THEN 'l' WHEN {0} = '160000' THEN 'g' ELSE '' END"


@query(f"""
SELECT event_id, CASE s WHEN 'A' THEN old_none AND new_there WHEN 'D' THEN old_there AND new_none WHEN 'M' THEN old_there AND new_there AND t = u AND NOT (m = n AND o = p)
WHEN 'T' THEN old_there AND new_there AND t <> u ELSE old_there AND new_there AND t = u END AS fits, m = '160000' AS gitlink, n <> '000000' AS present
FROM (SELECT *, m = '000000' AND o = '{OIDS[0]}' AS old_none, m <> '000000' AND o <> '{OIDS[0]}' AS old_there, n = '000000' AND p = '{OIDS[0]}' AS new_none, n <> '000000' AND p <> '{OIDS[0]}' AS new_there,
{TYPE_SQL.format('m')} AS t, {TYPE_SQL.format('n')} AS u FROM ({GRID_SQL}))
""")
def change_rules(spark: SparkSession, d: str) -> DataFrame:
    """letters against modes and object ids, all kinds of them."""
    i = F.col("i")
    s, m, n, o, p = pick("ADMTR", F.floor(i / 225)), pick(V.MODES, i), pick(V.MODES, F.floor(i / 5)), pick(OIDS, F.floor(i / 25)), pick(OIDS, F.floor(i / 75))
    return events(spark, d).select("event_id", V.transition_ok(s, m, n, o, p).alias("fits"), V.is_gitlink(m).alias("gitlink"), V.is_present_mode(n).alias("present"))


PAIRS = ("DD", "AU", "UD", "UA", "DU", "AA", "UU", "XX")
SCORES = ("R100", "R050", "R049", "R101", "R75", "R075", "75", "R7")


@query(f"""
SELECT event_id, CASE c WHEN 'DD' THEN a AND NOT b AND NOT e WHEN 'AU' THEN NOT a AND b AND NOT e WHEN 'UD' THEN a AND b AND NOT e WHEN 'UA' THEN NOT a AND NOT b AND e WHEN 'DU' THEN a AND NOT b AND e
WHEN 'AA' THEN NOT a AND b AND e WHEN 'UU' THEN a AND b AND e ELSE false END AS conflict, r IN ('R100', 'R050', 'R075') AS padded, r IN ('R100', 'R75') AS plain
FROM (SELECT event_id, {picked(PAIRS, 'event_id')} AS c, event_id // 8 % 2 = 1 AS a, event_id // 16 % 2 = 1 AS b, event_id // 32 % 2 = 1 AS e, {picked(SCORES, 'event_id // 64')} AS r FROM events)
""")
def conflict_rules(spark: SparkSession, d: str) -> DataFrame:
    """conflict letters against stages, and rename scores."""
    bit = lambda n: F.floor(F.col("i") / n) % 2 == 1
    score = pick(SCORES, F.floor(F.col("i") / 64))
    return events(spark, d).select("event_id", V.unmerged_ok(pick(PAIRS, F.col("i")), bit(8), bit(16), bit(32)).alias("conflict"), V.rename_score_ok(score, True).alias("padded"), V.rename_score_ok(score, False).alias("plain"))


IDS = ("a" * 40, "a" * 64, "A" * 40, "a" * 39, "0" * 40, "g" * 40, "")
UUIDS = ("01234567-89ab-4def-8123-456789abcdef", "01234567-89ab-1def-8123-456789abcdef", "01234567-89AB-4def-8123-456789abcdef", "0123456789ab4def8123456789abcdef", "x")


@query(f"""
SELECT event_id, regexp_full_match(o, '[0-9a-f]{{40}}|[0-9a-f]{{64}}') AS object_id, regexp_full_match(o, '0+') AS zero, regexp_full_match(o, '[0-9a-f]{{64}}') AS token, regexp_full_match(u, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') AS uuid,
regexp_full_match(u, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') AS uuid_v4, event_id * 3000000 - 5000000 BETWEEN 0 AND 2147483647 AS count_ok
FROM (SELECT event_id, {picked(IDS, 'event_id')} AS o, {picked(UUIDS, 'event_id')} AS u FROM events)
""")
def id_shapes(spark: SparkSession, d: str) -> DataFrame:
    """object ids, tokens, UUIDs and counts, good and bad."""
    o, u = pick(IDS, F.col("i")), pick(UUIDS, F.col("i"))
    return events(spark, d).select("event_id", V.is_object_id(o).alias("object_id"), V.is_zero_oid(o).alias("zero"), V.is_token(o).alias("token"), V.is_uuid(u).alias("uuid"), V.is_uuid_v4(u).alias("uuid_v4"), V.is_count(F.col("i") * 3000000 - 5000000).alias("count_ok"))


HOMES = ("/home/a", "/home/a/b/c", "/home/ab", "/home", "x/home/a/b")


@query(f"SELECT event_id, CASE WHEN p = '/home/a' THEN '~' WHEN starts_with(p, '/home/a/') THEN '~' || substr(p, 8) ELSE p END AS shown, CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN 'branch' ELSE 'detached' END AS head FROM (SELECT *, {picked(HOMES, 'event_id')} AS p FROM events)")
def shown_paths(spark: SparkSession, d: str) -> DataFrame:
    """home directories as ~, heads by what could be read."""
    head = V.head_variant(F.col("i") % 2, F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("a" * 40))
    return events(spark, d).select("event_id", V.redact_home(pick(HOMES, F.col("i")), F.lit("/home/a")).alias("shown"), head.getField("kind").alias("head"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_type = 'error' THEN 'unexpected' ELSE 'conflict' END AS type, CASE WHEN event_id % 3 = 0 OR event_type = 'error' THEN 'unexpectedFailure' ELSE event_type END AS code FROM events
""")
def typed_errors(spark: SparkSession, d: str) -> DataFrame:
    """typed errors, or the default where a part is blank or missing."""
    message = F.when(F.col("i") % 3 == 0, F.lit(" ")).otherwise("m")
    found = contract.normalize_error(F.lit("conflict"), F.when(F.col("event_type") != "error", F.col("event_type")), message)
    return events(spark, d).select("event_id", found.getField("type").alias("type"), found.getField("code").alias("code"))


@query("SELECT p_partkey, strlen(to_json({'p_partkey': p_partkey, 'p_name': p_name})::varchar) AS bytes FROM part")
def json_sizes(spark: SparkSession, d: str) -> DataFrame:
    """bytes of a row's JSON."""
    return load(spark, d, "part").select("p_partkey", paging.json_bytes("p_partkey", "p_name").cast("long").alias("bytes"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS ok FROM events")
def checked_responses(spark: SparkSession, d: str) -> DataFrame:
    """F16: responses with the right id, another id, no result, and an error without an id."""
    good, bad = '{"protocolVersion":1,"type":"result","requestId":"q","result":null}', '{"protocolVersion":1,"type":"error","requestId":null,"errors":[{"type":"a","code":"b","message":"c"}]}'
    said = pick((good, bad, good.replace('"q"', '"r"'), '{"protocolVersion":1,"type":"result","requestId":"q"}'), F.col("i"))
    return events(spark, d).select("event_id", contract.response_ok(said, F.lit("q")).alias("ok"))


ASKED = {
    '{"protocolVersion":1,"requestId":"a","action":"engine.checkStatus"}': None, '{"protocolVersion":1,"requestId":"a","action":"repositories.open","parameters":{"path":"/x"}}': None,
    '{"protocolVersion":1,"requestId":"a","action":"repositories.open","parameters":{"path":5}}': "protocol.invalidRequest", '{"protocolVersion":1,"requestId":"a","action":"repositories.open","parameters":{}}': "protocol.invalidRequest",
    '{"protocolVersion":2,"requestId":"a","action":"engine.checkStatus"}': "protocol.unsupportedVersion", '{"protocolVersion":1,"requestId":7,"action":"engine.checkStatus"}': "protocol.invalidRequest",
    '{"protocolVersion":1,"requestId":"a","action":"x"}': "protocol.unknownAction", "{": "protocol.invalidJson", "": "protocol.invalidJson", '{"protocolVersion":1,"requestId":" ","action":"engine.checkStatus"}': "protocol.invalidRequest",
    '{"protocolVersion":1,"requestId":"a","action":"engine.checkStatus","more":1}': "protocol.invalidRequest",
}


@query(f"SELECT code, count(*) AS n FROM (SELECT {picked(ASKED.values(), 'event_id')} AS code FROM events) GROUP BY 1")
def answered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Request lines, good and bad, and the codes of their answers."""
    lines = events(spark, d).select(pick(list(ASKED), F.col("i")).alias("value"))
    answers = contract.responses(contract.parse_requests(lines))
    return answers.groupBy(F.get_json_object("value", "$.errors[0].code").alias("code")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT conv_id, turn, 'c' || conv_id || '/' || turn AS path FROM conversations)
SELECT count(DISTINCT conv_id) AS changed, count(DISTINCT conv_id) FILTER (WHERE turn = 0) AS uncommitted, count(DISTINCT conv_id) FILTER (WHERE turn = 0 AND conv_id % 2 = 0) AS staged,
count(DISTINCT conv_id) FILTER (WHERE turn = 0 AND conv_id % 3 = 0) AS unstaged, count(DISTINCT conv_id) FILTER (WHERE turn = 0 AND conv_id % 5 = 0) AS untracked, count(DISTINCT conv_id) FILTER (WHERE turn = 0 AND conv_id % 7 = 0) AS conflicted FROM t
""")
def rename_summary(spark: SparkSession, d: str) -> DataFrame:
    """Chains of renames as lineages, and the six counts."""
    turns = load(spark, d, "conversations")
    at = lambda n: F.concat(F.lit("c"), F.col("conv_id"), F.lit("/"), n)
    committed = turns.where("turn > 0").select(at(F.col("turn")).alias("path"), at(F.col("turn") - 1).alias("original_path"))
    by = lambda n: F.col("conv_id") % n == 0
    working = turns.where("turn = 0").select(at(F.col("turn")).alias("path"), F.lit(None).cast("string").alias("original_path"), by(2).alias("is_staged"), by(3).alias("is_unstaged"), by(5).alias("is_untracked"), by(7).alias("is_conflicted"), F.lit(False).alias("is_ignored"))
    ignored = working.limit(1).withColumn("path", F.lit("elsewhere")).withColumn("is_ignored", F.lit(True))
    return lineage.file_summary(lineage.union_file_records(committed, working.union(ignored)))


FULL = ("refs/heads/main", "refs/heads/a", "refs/remotes/up/HEAD", "refs/remotes/up/dev", "refs/tags/v", "refs/remotes/origin/HEAD")
FULL_SQL = f"SELECT event_id, {picked(FULL, 'event_id')} AS n, CASE WHEN event_id % 6 IN (2, 5) THEN 'refs/remotes/up/dev' END AS symbolic, CASE WHEN event_id // 6 % 4 = 0 THEN 'tag' ELSE 'commit' END AS kind FROM events"


@query(f"""
SELECT event_id, CASE WHEN kind = 'commit' AND n LIKE '%/HEAD' THEN 'default' WHEN kind <> 'commit' THEN 'unsupported' WHEN n = 'refs/heads/main' THEN 'current' WHEN n LIKE 'refs/heads/%' THEN 'local' WHEN n LIKE 'refs/remotes/%' THEN 'remote' ELSE 'unsupported' END AS class
FROM ({FULL_SQL})
""")
def target_classes(spark: SparkSession, d: str) -> DataFrame:
    """References by class."""
    i = F.col("i")
    full = pick(FULL, i)
    refs = events(spark, d).select(full.alias("full_name"), F.col("event_id").cast("string").alias("revision"), F.when(F.floor(i / 6) % 4 == 0, "tag").otherwise("commit").alias("object_type"), F.when((i % 6).isin(2, 5), "refs/remotes/up/dev").alias("symbolic_target"), F.lit(None).cast("string").alias("upstream_remote"))
    return classify.classify_targets(refs, F.lit("refs/heads/main")).select(F.col("revision").cast("long").alias("event_id"), "class")


@query("SELECT 'refs/remotes/r' || n_nationkey || '/main' AS full_name FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1)")
def suggested_target(spark: SparkSession, d: str) -> DataFrame:
    """The default of the current branch's remote, one remote for each nation."""
    nations = load(spark, d, "nation").select(F.concat(F.lit("refs/remotes/r"), "n_nationkey").alias("at"), F.concat(F.lit("r"), "n_nationkey").alias("r"), "n_nationkey", "n_regionkey")
    none, commit = F.lit(None).cast("string"), F.lit("commit")
    upstream = nations.where("n_regionkey = 1").agg(F.min_by("r", "n_nationkey").alias("upstream_remote"))
    heads = nations.select(F.concat("at", F.lit("/HEAD")).alias("full_name"), F.col("r").alias("revision"), commit.alias("object_type"), F.concat("at", F.lit("/main")).alias("symbolic_target"), none.alias("upstream_remote"))
    mains = nations.select(F.concat("at", F.lit("/main")), "r", commit, none, none)
    current = upstream.select(F.lit("refs/heads/work"), F.lit("x"), commit, none, "upstream_remote")
    found = classify.classify_targets(heads.union(mains).union(current), F.lit("refs/heads/work"))
    return classify.suggest_target(found).select("full_name")


@query("SELECT c_custkey AS last_repository_id, n_name FROM customer LEFT JOIN (SELECT n_nationkey * 7 AS k, n_name FROM nation) ON k = c_custkey")
def last_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Application states with their last repository, if it is known."""
    known = load(spark, d, "nation").select((F.col("n_nationkey") * 7).alias("repository_id"), "n_name")
    states = load(spark, d, "customer").select(F.col("c_custkey").alias("last_repository_id"))
    return classify.last_repository(states, known).select("last_repository_id", "n_name")


@query("""
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'changedFilesCaptured:' || o_orderkey ELSE 'changedFilesCaptured:' || o_orderkey || ';excludedUncommittedFiles:' || (o_orderkey % 4) || ':' ||
(o_orderkey % 4) || ' staged' END AS facts FROM orders
""")
def run_fact_lists(spark: SparkSession, d: str) -> DataFrame:
    """The facts of captured runs; none where the time or the count is missing."""
    k, zero = F.col("o_orderkey"), F.lit(0)
    made = load(spark, d, "orders").select(
        k.alias("run_id"), F.when(k % 3 != 0, k).alias("captured_at_unix_ms"), F.when(k % 5 != 0, k).cast("int").alias("captured_changed_file_count"), (k % 4).cast("int").alias("excluded_uncommitted_total"),
        (k % 4).cast("int").alias("excluded_staged_count"), zero.alias("excluded_unstaged_count"), zero.alias("excluded_untracked_count"), zero.alias("excluded_conflicted_count"),
    )
    shown = F.transform("facts", lambda f: F.concat_ws(":", f["kind"], f["count"], f["detail"]))
    return classify.run_facts(made).select("run_id", F.array_join(shown, ";").alias("facts"))

"""Run log, paging, strict JSON and streaming on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import canonical
from millrace.operators import classify, contract, paging, state
from millrace.sources import records
from millrace.streaming import runs


def test_recent_twenty(spark):
    rows = spark.createDataFrame([(f"r{i:02}", i) for i in range(22)], "id string, at long")
    assert [r["id"] for r in paging.recent_top(rows, "at", "id").collect()] == [f"r{i:02}" for i in range(21, 1, -1)]
    assert {r["id"] for r in paging.retention_victims(rows, "at", "id").collect()} == {"r00", "r01"}


def test_pages_concatenate(spark):
    names = [("local", 0, f"n{i:03}", f"refs/heads/n{i:03}", "a" * 40) for i in range(60)] + [("local", 0, "x" * 900, "refs/heads/" + "x" * 900, "a" * 40)]
    targets = spark.createDataFrame(names, "kind string, kind_ord int, name string, full_name string, revision string")
    seen, rest = [], targets
    while True:
        page, excluded = paging.target_page(rest, 100, 1000)
        rows = [r["full_name"] for r in page.orderBy("kind_ord", "full_name").collect()]
        assert excluded == 1
        if not rows:
            break
        seen += rows
        rest = targets.where(F.struct("kind_ord", "full_name") > F.struct(F.lit(0), F.lit(rows[-1])))
    assert seen == sorted(n[3] for n in names[:-1])
    assert paging.cursor_exists(targets, "full_name", "refs/heads/n001").first()["known"] is True


def test_claim_and_cancel(spark):
    rows = [("a", "pendingCapture", 2000, None), ("b", "pendingCapture", 1000, None), ("c", "pendingCapture", 500, 1), ("d", "completed", 1, None)]
    table = spark.createDataFrame(rows, "run_id string, state string, requested_at_unix_ms long, cancellation_requested_at_unix_ms long")
    assert state.next_pending(table).first()["run_id"] == "b"
    asked = spark.createDataFrame([("a", 7), ("a", 5), ("c", 9), ("d", 3)], "run_id string, at long")
    got = {r["run_id"]: r["cancellation_requested_at_unix_ms"] for r in state.request_cancel(table, asked).collect()}
    assert got == {"a": 5, "b": None, "c": 1, "d": None}


def test_fold(spark):
    events = [("a", 1, "capture"), ("a", 2, "discover"), ("a", 3, "collect"), ("a", 4, "persist"), ("a", 5, "complete"), ("a", 6, "cancel"), ("b", 1, "discover"), ("b", 2, "cancel"), ("c", 1, None)]
    got = {r["id"]: r["state"] for r in state.fold_runs(spark.createDataFrame(events, "id string, at int, event string"), "id", ["at"], "event").collect()}
    assert got == {"a": "completed", "b": "cancelled", "c": "pendingCapture"}


def test_fold_of_a_hot_key(spark):
    """A key with a quarter of all events is folded in several ranges, none of which lists its events."""
    rnd = random.Random(5)
    rows = []
    for i in range(60_000):
        who = rnd.choice(["hot", f"k{rnd.randrange(300)}", f"k{rnd.randrange(300)}", None if rnd.random() < 0.01 else "few"])
        # most runs stay on their way for long, as few events may end them
        rows.append((who, rnd.randrange(20_000), i, rnd.choice([*state.TRANSITIONS][:4] * 300 + [*state.TRANSITIONS, None, "other"])))
    want = {}
    for who, _, _, event in sorted(rows, key=lambda r: r[1:3]):
        now, n = want.get(who, ("pendingCapture", 0))
        to, sources = state.TRANSITIONS.get(event, (None, ()))
        want[who] = (to if now in sources else now, n + 1)
    table = spark.createDataFrame(rows, "id string, at int, no int, event string")
    got = state.fold_runs(table, "id", ["at", "no"], "event").collect()
    assert {r["id"]: (r["state"], r["events"]) for r in got} == want and len(got) == len(want)
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("false", "16"), strict=True):
        spark.conf.set(n, value)
    try:
        ranges = state.fold_ranges(table, "id", ["at", "no"], "event").collect()
        got = state.fold_runs(table, "id", ["at", "no"], "event").collect()
    finally:
        for n, value in zip(names, old, strict=True):
            spark.conf.set(n, value)
    hot = [r["n"] for r in ranges if r["key"] == "hot"]
    assert len(hot) > 3 and sum(hot) == want["hot"][1] and max(hot) < 0.5 * want["hot"][1]
    assert len(ranges) <= len(want) + 16
    assert {r["id"]: (r["state"], r["events"]) for r in got} == want
    assert state.fold_runs(table.limit(0), "id", ["at", "no"], "event").count() == 0


def test_fold_ties_and_numbers(spark):
    """Events of one time are ordered by name, and NaN is one key, as when they were listed."""
    rows = [(float("nan"), 1, "discover"), (float("nan"), 1, "capture"), (float("nan"), None, "cancel"), (0.5, 2, "fail"), (0.5, 1, "capture")]
    got = {str(r["id"]): (r["state"], r["events"]) for r in state.fold_runs(spark.createDataFrame(rows, "id double, at int, event string"), "id", ["at"], "event").collect()}
    assert got == {"nan": ("cancelled", 3), "0.5": ("failed", 2)}


def test_steps_and_cascade(spark):
    events = spark.createDataFrame([("r", "s1", 1, "begin", None), ("r", "s1", 4, "finish", "succeeded"), ("r", "s1", 5, "finish", "failed"), ("r", "s2", 2, "begin", None), ("r", "s3", 2, "finish", "failed")], "run_id string, step_id string, at long, event string, outcome string")
    assert {r["step_id"]: r["state"] for r in state.step_fold(events).collect()} == {"s1": "succeeded", "s2": "running", "s3": "pending"}
    parents, children = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id int, v string")
    left, kids = state.delete_cascade(parents, parents.where("id = 2"), children, "id")
    assert [r["id"] for r in left.collect()] == [1] and [r["v"] for r in kids.collect()] == ["x"]
    kept = state.set_null(spark.createDataFrame([(1, 2), (2, 1)], "k int, last int"), "last", parents.where("id = 2"), "id")
    assert {r["k"]: r["last"] for r in kept.collect()} == {1: None, 2: 1}


def test_checks(spark):
    entry = "run_id string, path string, original_path string, category string, merge_base_entry_mode string, head_entry_mode string, merge_base_object_id string, head_object_id string"
    rows = [("r", "ok", None, "added", "000000", "100644", "0" * 40, "a" * 40), ("r", "x", "y", "added", "000000", "100644", "0" * 40, "a" * 40), ("r", "m", None, "moved", "1", "100644", "0", "a" * 40)]
    got = {(r["key"], r["constraint"]) for r in state.violations(spark.createDataFrame(rows, entry), "path", state.entry_checks()).collect()}
    assert got == {("x", "original_path"), ("m", "category"), ("m", "modes"), ("m", "object_ids")}


def test_joins(spark):
    rows = spark.createDataFrame([(1, "a/b/c"), (2, "a/b"), (3, "ab/c"), (4, "a/b/"), (5, None)], "i int, t string")
    prefixes = spark.createDataFrame([("a",), ("a/b",), ("q",)], "prefix string")
    got = {r["i"]: r["prefix"] for r in classify.longest_prefix(rows, "t", prefixes).collect()}
    assert got == {1: "a/b", 2: "a", 3: None, 4: "a", 5: None}
    twice = classify.longest_prefix(rows.union(rows), "t", prefixes).collect()
    assert len(twice) == 10
    hot = spark.range(400).select("id", F.concat(F.lit("https://h/"), F.when(F.col("id") % 3 > 0, "x/").otherwise(""), F.col("id").cast("string")).alias("t"))
    found = spark.createDataFrame([("https://h",), ("https://h/x",), ("https://h/x",), (None,)], "prefix string")
    for salts in (1, 16):
        got = classify.longest_prefix(hot, "t", found, salts=salts).collect()
        assert len(got) == 400 and all(r["prefix"] == ("https://h/x" if r["id"] % 3 else "https://h") for r in got)
    assert {r["prefix"] for r in classify.longest_prefix(rows, "t", prefixes.limit(0)).collect()} == {None}
    with pytest.raises(ValueError, match="prefix"):
        classify.longest_prefix(rows.withColumn("prefix", F.col("t")), "t", prefixes)
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "i int, t string")
    assert classify.multiset_equal(a, a.orderBy("t")).first()[0] is True
    assert classify.multiset_equal(a, a.distinct()).first()[0] is False


def request(**changes):
    base = {"protocolVersion": 1, "requestId": "q", "action": "repositories.open", "parameters": {"path": "/x"}} | changes
    return json.dumps({k: v for k, v in base.items() if v is not ...})


CASES = {
    "good": (request(), None),
    "unknown member": (request(extra=1), "malformedRequest"),
    "repeated member": ('{"protocolVersion":1,"requestId":"q","requestId":"q","action":"engine.checkStatus"}', "malformedRequest"),
    "version": (request(protocolVersion=2), "unsupportedVersion"),
    "text version": (request(protocolVersion="1"), "unsupportedVersion"),
    "blank": (request(requestId=" "), "blankField"),
    "action": (request(action="x"), "unknownAction"),
    "parameter": (request(parameters={"path": "/x", "y": 1}), "invalidParameters"),
    "no json": ("{", "invalidJson"),
    "no parameters": (request(action="engine.checkStatus", parameters=...), None),
}


@pytest.mark.parametrize("name", CASES)
def test_requests(spark, name):
    text, error = CASES[name]
    frame = spark.createDataFrame([(text,)], "value string")
    parsed = contract.parse_requests(frame)
    assert parsed.first()["error"] == error
    reply = contract.responses(parsed)
    assert json.loads(reply.first()[0])["type"] == ("error" if error else "result")
    assert reply.select(contract.response_ok(F.col("value"), F.lit("q"))).first()[0] is True or name == "blank"


STRICT = {
    "parameters are a text": (request(parameters="text"), "invalidParameters"), "id is a number": (request(requestId=5), "malformedRequest"),
    "path is a number": (request(parameters={"path": 5}), "invalidParameters"), "path is null": (request(parameters={"path": None}), "invalidParameters"),
    "path is missing": (request(parameters={}), "invalidParameters"), "no parameters": (request(action="comparisons.prepare", parameters=...), "invalidParameters"),
    "optional is null": (request(action="comparisons.listTargets", parameters={"path": "/x", "query": None}), None), "optional is left out": (request(action="comparisons.listTargets"), None),
    "optional is a number": (request(action="comparisons.listTargets", parameters={"path": "/x", "after": 1}), "invalidParameters"), "blank line": ("", "invalidJson"), "half a line": ('{"a"', "invalidJson"),
    "text behind": (request() + " x", "invalidJson"), "object behind": (request() + '{"b":1}', "invalidJson"), "list behind": (request() + "," + request(), "invalidJson"), "closed early": (request() + "] [" + request(), "invalidJson"),
    "closed early twice": (request() + '}] [{"a":1', "invalidJson"), "comment behind": (request() + "//c", "invalidJson"), "single quotes": (request().replace('"', "'"), "invalidJson"), "a list": ("[" + request() + "]", "malformedRequest"), "a null": ("null", "malformedRequest"),
    "space around": ("  " + request() + " \t", None), "repeated inside": (request(action="comparisons.listTargets").replace('"path"', '"path":"/y","path"'), "malformedRequest"),
    "too large": (request() + " " * 70_000, "requestTooLarge"), "version is a fraction": (request(protocolVersion=1.5), "malformedRequest"),
}


def test_null_fields_raise(spark):
    """A record with a null in a field that may not be null isn't left out of a fingerprint; it is refused."""
    table = spark.createDataFrame([("zzz", None), ("b", 1)], "k string, v long")
    body = canonical.record(canonical.field(F.col("k")), canonical.field(F.col("v").cast("string")))
    for frame in (canonical.fingerprint(table, canonical.field("v1"), [F.col("k")], body), canonical.bulk_fingerprint(table, "k", body), table.select(canonical.boolean("m", F.col("v") > 0))):
        with pytest.raises(Exception, match="null"):
            frame.collect()
    body = canonical.record(canonical.field(F.col("k")), canonical.nullable("v", F.col("v").cast("string")))
    other = table.withColumn("k", F.when(F.col("k") == "zzz", "a").otherwise(F.col("k")))
    prints = [canonical.fingerprint(t, canonical.field("v1"), [F.col("k")], body).first()["fingerprint"] for t in (table, other)]
    assert prints[0] != prints[1]


def test_one_active_names(spark):
    table = spark.createDataFrame([("k", 1, 10, 3)], "key string, at int, run int, active_run int")
    with pytest.raises(ValueError, match="active_run"):
        state.one_active(table, "key", ["at"], "run")


def test_strict_requests(spark):
    table = spark.createDataFrame([(k, v[0]) for k, v in STRICT.items()], "name string, value string")
    parsed = contract.parse_requests(records.request_lines(table))
    assert {r["name"]: r["error"] for r in parsed.collect()} == {k: v[1] for k, v in STRICT.items()}
    lines = [json.loads(r[0]) for r in contract.responses(parsed).collect()]
    codes = {e["errors"][0]["code"] for e in lines if e["type"] == "error"}
    assert codes == {"protocol.requestTooLarge", "protocol.invalidJson", "protocol.invalidRequest"}


def test_result_payload_and_busy(spark):
    parsed = contract.parse_requests(spark.createDataFrame([(request(), "k1", '{"a":[1,null]}'), (request(action="engine.checkStatus", parameters=...), "k1", None), (request(requestId="r"), "k2", None)], "value string, canonical_path_key string, result string"))
    active = spark.createDataFrame([("k1",), ("k1",)], "canonical_path_key string")
    got = [json.loads(r[0]) for r in contract.responses(contract.refuse_busy(parsed, active)).collect()]
    assert sorted((g["type"], g.get("errors", [{}])[0].get("code")) for g in got) == [("error", "repository.busy"), ("result", None), ("result", None)]
    assert json.loads(contract.responses(parsed.limit(1)).first()[0])["result"] == {"a": [1, None]}


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(request() + "\n{\n\n")
    query = runs.answer(runs.request_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(json.loads(r[0])["type"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["error", "error", "result"]


def test_run_stream(spark, tmp_path):
    rows = [("a", 1, 1, "capture"), ("a", 2, 2, "discover"), ("b", 1, 3, "cancel")]
    spark.createDataFrame(rows, "run_id string, at long, event_id long, event string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("run_id string, at long, event_id long, event string").parquet(str(tmp_path / "in"))
    query = runs.run_states(events).writeStream.outputMode("update").format("memory").queryName("run_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert {tuple(r) for r in spark.sql("SELECT run_id, state, events FROM run_states").collect()} == {("a", "discovering", 2), ("b", "cancelled", 1)}


def test_line_limits(spark, tmp_path):
    frame = spark.createDataFrame([("x" * 70_000,), ("y",), ("",)], "value string")
    assert sorted(r["too_large"] for r in records.request_lines(frame).collect()) == [False, False, True]
    records.write_ndjson(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0]) == {"a": 1, "b": None}


def test_components_of_a_long_chain(spark, tmp_path):
    """Rounds stay few on a chain in random order, and the shared folder keeps only the result."""
    import random

    from millrace.operators import lineage
    from millrace.sources import tables

    order = list(range(2000))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(3000, 3001), (3001, 3001), (None, 3002)], "a long, b long")
    written, write = [], tables._write
    tables._write = lambda df, label: written.append(label) or write(df, label)
    try:
        found = lineage.components(links, spark.createDataFrame([(5000,)], "node long"))
    finally:
        tables._write = write
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {i: 0 for i in range(2000)} | {3000: 3000, 3001: 3000, 3002: 3002, 5000: 5000}
    assert written.count("edges") <= 16  # a round more than the logarithm of the nodes, and a few
    folder = tables.shared_dir(spark).removeprefix("file://")
    import os

    left = [f for f in os.listdir(folder) if f.split("-")[0] in ("edges", "hooks", "nodes", "labels")]
    assert left == []

"""The request loop: order, what requests see of each other, restarts, recovery, claims."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import lines
from millrace.streaming import loop

KEYS = {"/a": "ka", "/b": "kb", "/c": "kc"}
TOKEN = "f" * 64


def run_row(run_id, key, state, **more):
    """A run of the log."""
    return {"run_id": run_id, "state": state, "canonical_repository_path_key": key, "repository_id": "r", "repository_display_name": "n", "canonical_repository_path": "/" + key[1:], "head_revision": "h", "target": "t", "target_revision": "v", "freshness_token": TOKEN, "requested_at_unix_ms": 1} | more


def line(n, action, **parameters):
    """A request line."""
    return json.dumps({"protocolVersion": 1, "requestId": f"q{n:02}", "action": action, "parameters": parameters})


@pytest.fixture
def served(spark, tmp_path):
    """A loop over a folder, and a function that runs it on new lines and gives its answers in order."""
    (tmp_path / "in").mkdir()
    old = [run_row("old-b", "kb", "collecting"), run_row("end", "kc", "completedWithLimitations", terminal_at_unix_ms=9, limitation_count=2, captured_at_unix_ms=5, captured_changed_file_count=3, excluded_uncommitted_total=1, excluded_staged_count=1, excluded_unstaged_count=0, excluded_untracked_count=0, excluded_conflicted_count=0)]
    schema = spark.createDataFrame([], loop.RUNS).schema
    runs = spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in old], schema)
    paths = spark.createDataFrame(list(KEYS.items()), "path string, canonical_path_key string")
    facts = [F.lit(f"{c}!").alias(c) for c in loop.FACTS]
    check = lambda df: df.select("name", F.lit(None).cast("string").alias("error"), F.when(F.col("freshness_token") == TOKEN, "current").otherwise("stale").alias("freshness"), *facts)
    lines.register(spark)
    made = loop.RequestLoop(spark, f"file://{tmp_path}/store", runs, paths, check, clock=lambda: 100)

    def run(name, texts, checkpoint="cp"):
        if texts:
            (tmp_path / "in" / name).write_text("\n".join(texts))
        stream = spark.readStream.format(lines.NAME).option("path", str(tmp_path / "in")).load()
        query = made.run(stream, str(tmp_path / checkpoint))
        query.awaitTermination(200)
        assert query.exception() is None
        return [[json.loads(r[0]) for r in made.answers(b).collect()] for b in made.done()]

    return made, run


def test_order_and_restart(served):
    """Answers in the order of requests, each seeing those before it; a restarted stream adds none."""
    made, run = served
    start = {"path": "/a", "target": "t", "freshnessToken": TOKEN}
    texts = [
        line(0, "analysis.getActive", path="/a"), line(1, "comparisons.prepare", path="/a", target="t"), line(2, "analysis.start", **start), line(3, "analysis.start", **start), line(4, "analysis.getActive", path="/a"),
        line(5, "comparisons.prepare", path="/a", target="t"), line(6, "analysis.pollRun", runId="old-b"), line(7, "analysis.pollRun", runId="nowhere"), "{", line(9, "analysis.cancel", runId="END"), line(10, "analysis.cancel", runId="nowhere"),
        line(11, "analysis.start", path="/none", target="t", freshnessToken=TOKEN), line(12, "analysis.start", path="/b", target="t", freshnessToken="0" * 64), line(13, "analysis.getActive", path="/none"), line(14, "analysis.pollRun", runId="end"),
    ]
    (first,) = run("1", texts)
    assert [a["requestId"] for a in first] == [f"q{i:02}" if i != 8 else None for i in range(15)]
    code = lambda i: first[i]["errors"][0]["code"]
    assert first[0]["result"] == {"kind": "none"} and code(1) == "unexpectedFailure"
    run_id = first[2]["result"]["runId"]
    assert first[2]["result"] == {"state": "accepted", "runId": run_id, "requestedAt": 100} and first[3]["result"] == {"state": "rejectedActive", "activeRunId": run_id}
    assert first[4]["result"]["kind"] == "active" and first[4]["result"]["run"]["runId"] == run_id and first[4]["result"]["run"]["state"] == "pendingCapture"
    assert code(5) == "repository.busy"
    assert (first[6]["result"]["state"], first[6]["result"]["interruptedAt"], first[6]["result"]["terminal"]) == ("interrupted", 100, None)  # recovered at batch 0
    assert [code(i) for i in (7, 8, 10, 11, 13)] == ["analysis.unknownRun", "protocol.invalidJson", "analysis.unknownRun", "analysis.repositoryUnavailable", "analysis.repositoryUnavailable"]
    assert first[9]["type"] == "result" and first[9]["result"] is None and first[12]["result"] == {"state": "rejectedStale"}
    end = first[14]["result"]
    assert end["terminal"] == {"kind": "completedWithLimitations", "terminalAt": 9, "limitationCount": 2} and not end["cancellationRequested"]
    assert end["facts"] == [{"kind": "changedFilesCaptured", "count": 3, "detail": None}, {"kind": "excludedUncommittedFiles", "count": 1, "detail": "1 staged"}]
    assert {r["run_id"]: r["state"] for r in made.runs().collect()} == {"old-b": "interrupted", "end": "completedWithLimitations", run_id: "capturing"}

    assert run("1", None, "another") == [first]  # the stream lost its own record; the batch is marked
    both = run("2", [line(20, "analysis.pollRun", runId=run_id), line(21, "analysis.cancel", runId=run_id), line(22, "analysis.pollRun", runId=run_id), line(23, "analysis.start", path="/b", target="t", freshnessToken=TOKEN)])
    assert both[0] == first and [a["requestId"] for a in both[1]] == ["q20", "q21", "q22", "q23"]
    assert [both[1][i]["result"]["cancellationRequested"] for i in (0, 2)] == [False, True] and both[1][3]["result"]["state"] == "accepted"
    log = {r["run_id"]: (r["state"], r["cancellation_requested_at_unix_ms"]) for r in made.runs().collect()}
    assert log[run_id] == ("capturing", 100) and log[both[1][3]["result"]["runId"]] == ("pendingCapture", None)  # one run at a time is claimed


def test_killed_batch(served, monkeypatch):
    """A batch that ends after its answers were written is answered again, with the same runs, and shows once."""
    made, run = served
    with monkeypatch.context() as m:
        m.setattr(made, "step", lambda runs, now: (_ for _ in ()).throw(KeyError("killed")))
        with pytest.raises(Exception, match="killed"):
            run("1", [line(0, "analysis.start", path="/a", target="t", freshnessToken=TOKEN)])
    assert made.done() == [] and made.runs().count() == 2
    (first,) = run("1", None)
    assert len(first) == 1 and first[0]["result"]["state"] == "accepted" and made.runs().count() == 3

"""The composed actions over captured facts, and the checks of the smaller tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import actions, contract, state

A, B, C = "a" * 40, "b" * 40, "c" * 40
DIFF = f":100644 100644 {A} {B} M\0a.txt\0:100644 100644 {A} {A} R100\0old\0new\0"
STATUS = "? free.txt\0"
CONFLICT = f"u UU N... 100644 100644 100644 100644 {A} {B} {C} both.txt\0"
HEAD = ("branch", "main", B)
#: name, bases, counts, diff, before, after, and what comes out: the error, or the readiness
CASES = (
    ("ready", f"{A}\n", "1\t2\n", DIFF, STATUS, STATUS, "ready"),
    ("empty", f"{A}\n", "1\t0\n", "", "", "", "empty"),
    ("conflicts", f"{A}\n", "0\t1\n", DIFF, CONFLICT, CONFLICT, "conflicts"),
    ("unrelated", "", "0\t1\n", DIFF, "", "", "unrelatedHistory"),
    ("ambiguous", f"{A}\n{B}\n", "0\t1\n", DIFF, "", "", "ambiguousBase"),
    ("bad counts", f"{A}\n", "01\t1\n", DIFF, "", "", "inspectionFailed"),
    ("cut diff", f"{A}\n", "0\t1\n", DIFF[:-1], "", "", "inspectionFailed"),
    ("large", f"{A}\n", "0\t1\n", "x" * (8 * 1024 * 1024 + 1), "", "", "tooLarge"),
    ("moved", f"{A}\n", "0\t1\n", DIFF, STATUS, "", "changedDuringPreparation"),
    ("other head", f"{A}\n", "0\t1\n", DIFF, "", "", "changedDuringPreparation"),
    ("no target", f"{A}\n", "0\t1\n", DIFF, "", "", "targetInvalid"),
)
TARGET = "refs/heads/base"


@pytest.fixture(scope="module")
def prepared(spark):
    head = "struct<kind:string,name:string,revision:string>"
    schema = f"name string, target string, repository struct<canonical_path:string,name:string,head:{head}>, target_set_token string, ending_head {head}, ending_target_revision string, ending_target_set_token string"
    rows = [(c[0], TARGET, ("/w/x", "x", HEAD), "t", ("detached", None, B) if c[0] == "other head" else HEAD, C, "t") for c in CASES]
    targets = spark.createDataFrame([(c[0], "local", "base", TARGET, C) for c in CASES if c[0] != "no target"], "name string, kind string, short_name string, full_name string, revision string")
    outputs = {k: spark.createDataFrame([(c[0], c[i]) for c in CASES], "name string, content string") for i, k in enumerate(("bases", "counts", "diff", "before", "after"), 1)}
    out = actions.prepare(spark.createDataFrame(rows, schema), targets, outputs)
    return spark.createDataFrame(out.collect(), out.schema)


def token(*entries):
    flat = ["comparison.freshness.v1", "repository.canonical-path", "/w/x", "head.branch", "main", B, "target", TARGET, C, "target-set-token", "t", "working-tree-record-count", str(len(entries))]
    for path, untracked in entries:
        flat += ["working-tree-record", path, "original-path", "absent", *(x for f in ("staged", "unstaged", "untracked", "conflicted", "ignored") for x in (f, "true" if f == "untracked" and untracked else "false"))]
    return hashlib.sha256(b"".join(len(f).to_bytes(4, "big") + f.encode() for f in flat)).hexdigest()


def test_prepare(prepared):
    got = {r["name"]: r for r in prepared.collect()}
    assert {n: r["error"] or r["readiness"] for n, r in got.items()} == {c[0]: c[-1] for c in CASES}
    assert all((r["error"] is None) == (r["result"] is not None) for r in got.values())
    assert json.loads(got["ready"]["result"]) == {
        "repository": {"name": "x", "canonicalPath": "/w/x", "head": {"kind": "branch", "name": "main", "revision": B}}, "target": {"kind": "local", "name": "base", "fullName": TARGET, "revision": C},
        "mergeBaseRevision": A, "currentWorkCommitCount": 2, "targetOnlyCommitCount": 1, "changedFileTotal": 3, "uncommittedFileTotal": 1, "stagedFileCount": 0, "unstagedFileCount": 0, "untrackedFileCount": 1,
        "readiness": {"state": "ready"}, "freshnessToken": token(("free.txt", True)),
    }
    assert json.loads(got["conflicts"]["result"])["readiness"] == {"state": "conflicts", "conflictedFileCount": 1}
    assert got["empty"]["freshness_token"] == token()


def test_a_target_twice_is_invalid(spark):
    """A target that is listed twice gives one row, with an error."""
    head = "struct<kind:string,name:string,revision:string>"
    schema = f"name string, target string, repository struct<canonical_path:string,name:string,head:{head}>, target_set_token string, ending_head {head}, ending_target_revision string, ending_target_set_token string"
    rows = [(n, TARGET, ("/w/x", "x", HEAD), "t", HEAD, C, "t") for n in ("once", "twice")]
    targets = [(n, "local", "base", TARGET, C) for n in ("once", "twice", "twice")]
    outputs = {k: spark.createDataFrame([(n, CASES[0][i]) for n in ("once", "twice")], "name string, content string") for i, k in enumerate(("bases", "counts", "diff", "before", "after"), 1)}
    out = actions.prepare(spark.createDataFrame(rows, schema), spark.createDataFrame(targets, "name string, kind string, short_name string, full_name string, revision string"), outputs)
    assert sorted((r["name"], r["error"]) for r in out.collect()) == [("once", None), ("twice", "targetInvalid")]


def test_errors_are_responses(prepared):
    lines = contract.responses(prepared.select(F.col("name").alias("request_id"), "error", "result")).collect()
    said = {m["requestId"]: m for m in (json.loads(r[0]) for r in lines)}
    assert said["ready"]["type"] == "result" and said["ready"]["result"]["readiness"] == {"state": "ready"}
    assert said["moved"]["errors"][0]["code"] == "comparison.changedDuringPreparation" and said["large"]["errors"][0]["code"] == "comparison.tooLarge"


def test_freshness_and_start(spark, prepared):
    asked = [("ready", token(("free.txt", True))), ("empty", "0" * 64), ("conflicts", "short"), ("moved", "0" * 64), ("large", "0" * 64)]
    checked = actions.check_freshness(spark.createDataFrame(asked, "name string, freshness_token string"), prepared)
    assert {r["name"]: r["error"] or json.loads(r["result"])["state"] for r in checked.collect()} == {"ready": "current", "empty": "stale", "conflicts": "invalidFreshnessToken", "moved": "stale", "large": "tooLarge"}
    fresh = spark.createDataFrame([(n, None, "current") for n in ("one", "two", "held")] + [("old", None, "stale"), ("bad", "invalidFreshnessToken", "stale")], "name string, error string, freshness string")
    requests = spark.createDataFrame([("one", "k", "r1", 5), ("two", "k", "r0", 5), ("held", "h", "r2", 1), ("old", "k", "r3", 1), ("bad", "k", "r4", 1)], "name string, canonical_path_key string, run_id string, requested_at long")
    runs = spark.createDataFrame([("h", "capturing", "x"), ("k", "completed", "y")], "canonical_repository_path_key string, state string, run_id string")
    got = {r["name"]: r["error"] or json.loads(r["result"]) for r in actions.start(requests, fresh, runs).collect()}
    assert got == {
        "two": {"state": "accepted", "runId": "r0", "requestedAt": 5}, "one": {"state": "rejectedActive", "activeRunId": "r0"}, "held": {"state": "rejectedActive", "activeRunId": "x"},
        "old": {"state": "rejectedStale"}, "bad": "invalidFreshnessToken",
    }


def test_checks_of_the_smaller_tables(spark):
    bad = lambda rows, schema, checks: {(r["key"], r["constraint"]) for r in state.violations(spark.createDataFrame(rows, schema), "id", checks).collect()}
    assert bad([(1, "running"), (2, "done")], "id int, state string", state.step_checks()) == {(2, "step_state")}
    rows = [(1, 1, "p", 1), (2, 2, "q", 0)]
    assert bad(rows, "id int, singleton_id int, product_name string, schema_version int", state.metadata_checks("p")) == {(2, "metadata_singleton"), (2, "metadata_product"), (2, "metadata_schema")}
    assert bad([(1, 1, None), (2, 1, "blue"), (3, 0, "dark")], "id int, singleton_id int, color_theme string", state.application_checks()) == {(2, "application_color_theme"), (3, "application_singleton")}


def plain_token(path, query, unsupported, targets):
    flat = ["comparison.target-set.v1", "repository.canonical-path", path, "query", *(["absent"] if query is None else ["present", query]), "unsupported-target-count", str(unsupported), "target-count", str(len(targets))]
    for kind, short, full, revision in sorted(targets, key=lambda t: t[2].encode("utf-16-be")):
        flat += ["target", "local" if kind == 0 else "remote-tracking", short, full, revision]
    return hashlib.sha256(b"".join(len(f.encode()).to_bytes(4, "big") + f.encode() for f in flat)).hexdigest()


def test_list_targets(spark):
    """722 targets in pages that join to the whole list; queries, cursors and tokens that don't fit; an empty list; a suggestion."""
    large = [(0, f"local-{i:03}-" + "x" * 180, A) for i in range(360)] + [(1, f"origin/remote-{i:03}-" + "y" * 180, B) for i in range(360)] + [(0, 'with"quote', A), (1, 'origin/with"quote', B)]
    full = lambda kind, short: ("refs/heads/" if kind == 0 else "refs/remotes/") + short
    large = [(k, s, full(k, s), r) for k, s, r in large]
    small = [(0, "Base", "refs/heads/Base", A), (1, "origin/base", "refs/remotes/origin/base", B), (0, "other", "refs/heads/other", C)]
    lists = {"large": large, "small": small, "query": small, "none": [], "cursor": small, "changed": small, "pair": small, "gone": small, "long": small, "hit": small}
    where = {n: ("/w/x", "BASE" if n in ("query", "gone") else "q" * 257 if n == "long" else None, 7 if n == "small" else 0) for n in lists}
    tokens = {n: plain_token(path, query, unsupported, lists[n]) for n, (path, query, unsupported) in where.items()}
    after = {"cursor": ("refs/heads/Base", tokens["cursor"]), "changed": ("refs/heads/Base", "0" * 64), "pair": ("refs/heads/Base", None), "gone": ("refs/heads/other", tokens["gone"]), "hit": ("refs/remotes/origin/base", tokens["hit"])}

    def ask(rows):
        table = spark.createDataFrame([(n, n, *where[n][:2], *rows[n], where[n][2]) for n in rows], "name string, request_id string, canonical_path string, query string, after string, target_set_token string, unsupported int")
        targets = [(n, "local" if k == 0 else "remoteTracking", k, s, f, r, f in ("refs/remotes/origin/base", 'refs/heads/with"quote')) for n in rows for k, s, f, r in lists[n]]
        out = actions.list_targets(table, spark.createDataFrame(targets, "name string, kind string, kind_ord int, short_name string, full_name string, revision string, suggested boolean"))
        lines = contract.responses(out.withColumnRenamed("name", "request_id")).collect()
        assert all(len(r[0].encode()) <= 48 * 1024 for r in lines)
        return {m["requestId"]: m for m in (json.loads(r[0]) for r in lines)}

    said = ask({n: after.get(n, (None, None)) for n in lists})
    item = lambda k, s, f, r: {"kind": "local" if k == 0 else "remoteTracking", "name": s, "fullName": f, "revision": r}
    base, remote, other = (item(*t) for t in small)
    page = lambda n, targets, suggestion=None, cursor=None: {"targets": targets, "suggestedTarget": suggestion, "nextCursor": cursor, "targetSetToken": tokens[n], "unsupportedTargetCount": where[n][2]}
    assert said["small"]["result"] == page("small", [base, other, remote], remote)
    assert said["query"]["result"] == page("query", [base, remote]) and said["none"]["result"] == page("none", [])
    assert said["cursor"]["result"] == page("cursor", [other, remote]) and said["hit"]["result"] == page("hit", [])
    errors = {n: said[n]["errors"][0]["code"] for n in ("changed", "pair", "gone", "long")}
    assert errors == {"changed": "comparison.targetsChanged", "pair": "comparison.invalidTargetPage", "gone": "comparison.invalidTargetPage", "long": "comparison.invalidTargetQuery"}
    order = [t[2] for t in sorted(large, key=lambda t: (t[0], t[2].encode("utf-16-be")))]
    result = said["large"]["result"]
    assert result["suggestedTarget"]["fullName"] == 'refs/heads/with"quote' and 1 < len(result["targets"]) < 722
    seen = [t["fullName"] for t in result["targets"]]
    assert seen == order[: len(seen)] and result["nextCursor"] == seen[-1]
    more = ask({"large": (result["nextCursor"], result["targetSetToken"])})["large"]["result"]
    assert [t["fullName"] for t in more["targets"]] == order[len(seen) :][: len(more["targets"])] and more["suggestedTarget"] is None
    last = ask({"large": (order[-3], result["targetSetToken"])})["large"]["result"]
    assert [t["fullName"] for t in last["targets"]] == order[-2:] and last["nextCursor"] is None

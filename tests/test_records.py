"""Readers of captured output (S1-S8), lineages, targets and tokens on small tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import validators as V
from millrace.functions.canonical import bulk_fingerprint, field
from millrace.operators import classify, fingerprint, lineage
from millrace.plans import catalog
from millrace.sources import records
from millrace.sources.tables import load

A, B, Z = "a" * 40, "b" * 40, "0" * 40


def outputs(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "name string, content string")


def ref(name, oid=A, kind="commit", symbolic="", remote=""):
    return "\0".join([name, oid, kind, symbolic, remote, ""]) + "\n"


def test_refs(spark):
    good = ref("refs/heads/main", remote="origin") + ref("refs/remotes/origin/HEAD", symbolic="refs/remotes/origin/main") + ref("refs/heads/ünï", "c" * 64)
    bad = {
        "twice": ref("refs/heads/a") * 2, "cut": ref("refs/heads/a")[:-1], "oid": ref("refs/heads/a", "A" * 40), "name": ref("refs/heads/a..b"),
        "lock": ref("refs/heads/a.lock"), "dot": ref("refs/heads/.a"), "type": ref("refs/heads/a", kind="note"), "cr": ref("refs/heads/a")[:-1] + "\r\n",
    }
    table = outputs(spark, good=good, empty="", **bad)
    got = records.scan_refs(table).collect()
    assert {(r["full_name"], r["symbolic_target"], r["upstream_remote"]) for r in got} == {
        ("refs/heads/main", None, "origin"), ("refs/remotes/origin/HEAD", "refs/remotes/origin/main", None), ("refs/heads/ünï", None, None),
    }
    assert {r["name"] for r in got} == {"good"}
    assert {r["name"] for r in records.failures(records.ref_records(table)).collect()} == set(bad)


def test_raw_diff(spark):
    good = f":100644 100644 {A} {B} M\0a b\0" + f":000000 100644 {Z} {A} A\0n\0" + f":100644 000000 {A} {Z} D\0d\0" + f":100644 120000 {A} {B} T\0t\0" + f":100644 100644 {A} {B} R087\0:old\0new\0"
    bad = {
        "same": f":100644 100644 {A} {A} M\0a\0", "score": f":100644 100644 {A} {B} R049\0a\0b\0", "cut": f":100644 100644 {A} {B} M\0a", "nopath": f":100644 100644 {A} {B} M\0",
        "mode": f":100600 100644 {A} {B} M\0a\0", "width": f":100644 100644 {A} {'c' * 64} M\0a\0", "type": f":100644 120000 {A} {B} M\0a\0",
    }
    table = outputs(spark, good=good, empty="", **bad)
    got = {(r["path"], r["original_path"], r["status"]) for r in records.scan_raw_diff(table).collect()}
    assert got == {("a b", None, "modified"), ("n", None, "added"), ("d", None, "deleted"), ("t", None, "typeChanged"), ("new", ":old", "renamed")}
    assert {r["name"] for r in records.failures(records.raw_diff_records(table)).collect()} == set(bad)


def test_status(spark):
    good = (
        f"1 M. N... 100644 100644 100644 {A} {B} staged file\0" + f"1 .M N... 100644 100644 100644 {A} {A} un\0" + f"1 MM N... 100644 100644 100644 {A} {B} both\0"
        + f"2 R. N... 100644 100644 100644 {A} {A} R100 new\0old name\0" + f"u UU N... 100644 100644 100644 100644 {A} {B} {A} clash\0" + "? new file\0! ignored\0"
    )
    bad = {
        "index": f"1 M. N... 100644 100644 100644 {A} {A} x\0", "tree": f"1 .M N... 100644 100644 120000 {A} {A} x\0", "stages": f"u DD N... 100644 100644 000000 100644 {A} {B} {Z} x\0",
        "sub": f"1 M. S... 100644 100644 100644 {A} {B} x\0", "score": f"2 R. N... 100644 100644 100644 {A} {A} R010 new\0old\0", "kind": "# x y\0", "cut": "? a",
    }
    table = outputs(spark, good=good, **bad)
    got = {r["path"]: "".join("TF"[not r[c]] for c in ("is_staged", "is_unstaged", "is_untracked", "is_conflicted", "is_ignored")) for r in records.scan_status(table).collect()}
    assert got == {"staged file": "TFFFF", "un": "FTFFF", "both": "TTFFF", "new": "TFFFF", "clash": "TTFTF", "new file": "FFTFF", "ignored": "FFFFT"}
    assert {r["name"] for r in records.failures(records.status_records(table)).collect()} == set(bad)


@pytest.mark.parametrize(("read", "head", "end"), [("raw_diff", f":100644 100644 {A} {B} M\0", "\0"), ("status", "? ", "\0"), ("ref", "refs/heads/", "\0".join(["", A, "commit", "", "", "\n"]))])
def test_output_limit(spark, read, head, end):
    """An output at the limit is read, one a byte over it is a failure with its reason, and one without content is a failure."""
    fill = lambda n: head + "x" * (n - len(head) - len(end)) + end
    limit = records.MAX_OUTPUT_BYTES
    table = outputs(spark, small=fill(200), at=fill(limit), over=fill(limit + 1), none=None)
    found = getattr(records, f"{read}_records")(table)
    scan = getattr(records, "scan_refs" if read == "ref" else f"scan_{read}")
    assert {tuple(r) for r in records.failures(found).collect()} == {("over", 1, "tooLarge"), ("none", 1, None)}
    assert {r["name"] for r in scan(table).select("name").collect()} == {"small", "at"}


def test_output_limit_of_lines(spark):
    limit = records.MAX_OUTPUT_BYTES
    table = outputs(spark, at="r" * (limit - 1) + "\n", over="r" * limit + "\n")
    assert [r["name"] for r in records.scan_remotes(table).select("name").collect()] == ["at"]
    assert {r["name"] for r in records.scan_scalar_facts(table).select("name").collect()} == {"at"}
    assert [(r["name"], r["reason"], r["line"]) for r in records.lines(table).where("name = 'over'").collect()] == [("over", "tooLarge", None)]


def test_small_facts(spark):
    assert {r["revision"] for r in records.scan_merge_bases(outputs(spark, a=f"{A}\n{B}\n", b="", c="x\n")).collect()} == {A, B}
    counts = records.scan_commit_counts(outputs(spark, a="3\t12\n", b="03\t1\n", c="1\t2\n3\t4\n", d="1\n")).collect()
    assert [tuple(r) for r in counts] == [("a", 3, 12)]
    facts = {r["name"]: r for r in records.scan_scalar_facts(outputs(spark, v="git version 2.5\n", t="true\n", p="/a/b\n", h=A + "\n", two="a\nb\n", cr="a\r\n")).collect()}
    assert facts["v"]["version"] == "2.5" and facts["t"]["flag"] is True and facts["p"]["absolute_path"] == "/a/b" and facts["h"]["revision"] == A
    assert {r["remote"] for r in records.scan_remotes(outputs(spark, a="origin\nup\n", b="\n")).collect()} == {"origin", "up"}
    assert [r["revision"] for r in records.scan_ls_remote(outputs(spark, a=f"{A}\trefs/heads/x\n", b=f"{B}\trefs/heads/y\n"), F.lit("refs/heads/x")).collect()] == [A]
    repo = [("r", k, v, e) for k, v, e in (("version", "2", 0), ("inside", "true", 0), ("bare", "false", 0), ("top", "/x/name", 0), ("head", A, 0), ("branch", "main", 0))]
    row = records.describe_repository(spark.createDataFrame([*repo, ("q", "inside", "false", 0)], "repository string, fact string, value string, exit_code int")).collect()
    assert {r["repository"]: r["descriptor"] and (r["descriptor"]["name"], r["descriptor"]["head"]["kind"]) for r in row} == {"r": ("name", "branch"), "q": None}


def test_every_refused_output_is_listed(spark, tmp_path):
    """Empty, unended, doubled, over-long, null and non-UTF-8 outputs are failures, not silence."""
    limit = records.MAX_OUTPUT_BYTES
    table = outputs(spark, good=f"{A}\n", empty="", unended=A, twice=f"{A}\n{B}\n", over="r" * limit + "\n", none=None)
    names = lambda found: {(r["name"], r["reason"]) for r in records.failures(found).collect()}
    assert names(records.scalar_fact_records(table)) == {("empty", None), ("unended", None), ("twice", None), ("over", "tooLarge"), ("none", None)}
    assert names(records.merge_base_records(table)) == {("unended", None), ("over", "tooLarge"), ("none", None)}
    assert names(records.remote_records(table)) == {("unended", None), ("over", "tooLarge"), ("none", None)}
    counts = outputs(spark, good="1\t2\n", empty="", text="a\tb\n")
    assert names(records.commit_count_records(counts)) == {("empty", None), ("text", None)}
    assert names(records.ls_remote_records(outputs(spark, good=f"{A}\tr\n", empty="", other=f"{A}\tq\n"), F.lit("r"))) == {("empty", None), ("other", None)}
    (tmp_path / "bad").write_bytes(b"origin\n\xff\n")
    (tmp_path / "good").write_bytes("ürsprung\n".encode())
    captured = records.capture(spark, str(tmp_path))
    assert [r["reason"] for r in records.failures(records.remote_records(captured)).collect()] == ["notUtf8"]
    assert [r["remote"] for r in records.scan_remotes(captured).collect()] == ["ürsprung"]


WORKING = [("fixture.txt", None, True, True, False, False, False), ("unstaged.txt", None, False, True, False, False, False), ("staged.txt", None, True, False, False, False, False), ("untracked.txt", None, False, False, True, False, False), ("ignored.txt", None, False, False, False, False, True)]
WORKING_SCHEMA = "path string, original_path string, is_staged boolean, is_unstaged boolean, is_untracked boolean, is_conflicted boolean, is_ignored boolean"


def test_overlapping_states(spark):
    committed = spark.createDataFrame([], "path string, original_path string")
    files = lineage.union_file_records(committed, spark.createDataFrame(WORKING, WORKING_SCHEMA))
    assert tuple(lineage.file_summary(files).first()) == (4, 4, 2, 2, 1, 0)


def test_transitive_lineage(spark):
    committed = spark.createDataFrame([("b", "a")], "path string, original_path string")
    working = spark.createDataFrame([("c", "b", True, False, False, False, False), ("x", None, False, False, True, False, False)], WORKING_SCHEMA)
    assert tuple(lineage.file_summary(lineage.union_file_records(committed, working)).first()) == (2, 2, 1, 0, 1, 0)


def test_components_equal_union_find(spark):
    rnd = random.Random(11)
    links = [(rnd.randrange(50), rnd.randrange(50)) for _ in range(35)] + [(i, i + 1) for i in range(60, 90)]
    root = {i: i for i in range(95)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = spark.createDataFrame([(i,) for i in range(95)], "node long")
    got = {r["node"]: r["root"] for r in lineage.components(spark.createDataFrame(links, "a long, b long"), nodes).collect()}
    assert got == {i: find(i) for i in range(95)}


def test_targets_and_suggestion(spark):
    table = outputs(spark, a=ref("refs/heads/main", remote="up") + ref("refs/heads/release") + ref("refs/remotes/up/HEAD", symbolic="refs/remotes/up/dev") + ref("refs/remotes/up/dev", B) + ref("refs/tags/v1") + ref("refs/heads/tag", kind="tag"))
    found = classify.classify_targets(records.scan_refs(table), F.lit("refs/heads/main"))
    assert {r["full_name"]: r["class"] for r in found.collect()} == {"refs/heads/main": "current", "refs/heads/release": "local", "refs/remotes/up/HEAD": "default", "refs/remotes/up/dev": "remote", "refs/tags/v1": "unsupported", "refs/heads/tag": "unsupported"}
    assert classify.suggest_target(found).first()["full_name"] == "refs/remotes/up/dev"


def packed(*fields):
    return b"".join(len(f.encode()).to_bytes(4, "big") + f.encode() for f in fields)


def test_tokens_equal_hashlib(spark):
    targets = spark.createDataFrame([("remote-x", 1, "refs/remotes/x/�", A), ("😀", 0, "refs/heads/😀", B), ("a", 0, "refs/heads/a", A)], "name string, kind_ord int, full_name string, revision string")
    rows = sorted(targets.collect(), key=lambda r: r["full_name"].encode("utf-16-be"))
    want = packed("comparison.target-set.v1", "repository.canonical-path", "/r", "query", "absent", "unsupported-target-count", "2", "target-count", "3")
    for r in rows:
        want += packed("target", "local" if r["kind_ord"] == 0 else "remote-tracking", r["name"], r["full_name"], r["revision"])
    assert fingerprint.target_set_token(targets, "/r", None, 2).first()["fingerprint"] == hashlib.sha256(want).hexdigest()
    working = spark.createDataFrame(WORKING, WORKING_SCHEMA)
    token = lambda w: fingerprint.freshness_token(w, "/r", fingerprint.head_fields("branch", "main", A), "refs/heads/a", B, "t").first()["fingerprint"]
    assert token(working) == token(working.orderBy(F.desc("path"))) != token(working.where("path <> 'staged.txt'"))
    entry = "path string, original_path string, category string, merge_base_entry_mode string, head_entry_mode string, merge_base_object_id string, head_object_id string"
    entries = spark.createDataFrame([("b", "a", "renamed", "100644", "100644", A, B), ("a", None, "added", "000000", "100644", Z, B)], entry)
    got = fingerprint.manifest_hash(entries, "m.v1", "/r", "t", A, B, A).first()["fingerprint"]
    body = packed("m.v1", "repository.canonical-path-key", "/r", "target", "t", A, "head-revision", B, "merge-base-revision", A, "entry-count", "2")
    body += packed("entry", "a", "original-path", "absent", "added", "000000", "100644", Z, B) + packed("entry", "b", "original-path", "present", "a", "renamed", "100644", "100644", A, B)
    assert got == hashlib.sha256(body).hexdigest()
    one = bulk_fingerprint(entries, "path", field(F.col("category"))).first()[0]
    assert one == bulk_fingerprint(entries.orderBy(F.desc("path")), "path", field(F.col("category"))).first()[0]


def test_bulk_hash_equals_hashlib(spark, sf):
    table = load(spark, sf, "documents").select("doc_id", "text", "lang")
    given = lambda mark, v: packed(mark, "absent") if v is None else packed(mark, "present", str(v))
    counts = Counter(hashlib.sha256(given("key", r["doc_id"]) + packed("present") + given("text", r["text"]) + given("lang", r["lang"])).hexdigest() for r in table.collect())
    placed = spark.createDataFrame([(d,) for d in counts], "d string").select("d", F.pmod(F.xxhash64("d"), F.lit(4096)).alias("b")).collect()
    buckets = {}
    for r in placed:
        buckets.setdefault(r["b"], []).append(f"{r['d']}:{counts[r['d']]}")
    each = "".join(hashlib.sha256(",".join(sorted(buckets[b])).encode()).hexdigest() for b in sorted(buckets))
    assert catalog.QUERIES["bulk_hash"](spark, sf).first()[0] == hashlib.sha256(each.encode()).hexdigest()


def test_longest_prefix_of_all_pages(spark, sf):
    urls = {r["page_id"]: r["url"] for r in load(spark, sf, "pages").select("page_id", "url").collect()}
    prefixes = {m.group() for u in urls.values() for p in (r"https?://[^/]+", r"https?://[^/]+/[^/]+(?=/)") if (m := re.match(p, u))}
    cuts = lambda u: [u[:i] for i in range(len(u) - 1) if u[i] == "/" and u[:i] in prefixes]
    got = {r["page_id"]: r["prefix"] for r in catalog.QUERIES["longest_prefix_all"](spark, sf).collect()}
    assert got == {k: max(cuts(u), key=len, default=None) for k, u in urls.items()}


def test_tables_compared_without_lists(spark):
    rows = [("hot", None)] * 300 + [("hot", f"x{i}") for i in range(300)] + [(None, "y"), (None, None), ("k", "z")]
    of = lambda rows: spark.createDataFrame(rows, "k string, v string")
    changed = lambda a, b: fingerprint.changed_between(of(a), of(b), ["k", "v"])
    assert "collect_list" not in changed(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    mark = lambda rows: bulk_fingerprint(of(rows), "k", field(F.col("v"))).first()[0]
    same = mark(rows)
    assert changed(rows, rows[::-1]).first()[0] is False and mark(rows[::-1]) == same
    for other in (rows[1:], [*rows, ("hot", None)], [*rows[:-1], ("k", "y")], [r for r in rows if r != (None, "y")], [(None, "w") if r == (None, "y") else r for r in rows]):
        assert changed(rows, other).first()[0] is True and mark(other) != same


@pytest.mark.parametrize(("name", "good"), [("refs/heads/a", True), ("refs/heads/a/b", True), ("refs/remotes/x", False), ("refs/remotes/x/y", True), ("heads/a", False), ("refs/heads/a b", False), ("refs/heads/a\x7f", False), ("refs/heads/@{x", False), ("refs/heads/", False)])
def test_target_refs(spark, name, good):
    assert spark.range(1).select(V.is_target_ref(F.lit(name))).first()[0] is good


def test_diagnostics(spark):
    texts = ["fatal: Not a git repository", "Permission denied", "needed a single revision", "boom"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(classify.classify_diagnostic(F.col("t"))).collect()]
    assert got == ["notGitRepository", "accessDenied", "headUnavailable", "inspectionFailed"]

"""Prefix scans, requests over time, observed states and all pages, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import paging, scan, state
from millrace.sources.tables import Workspace


@pytest.fixture
def many_ranges(spark):
    """Ranges as they are: 16 of them, not coalesced."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("false", "16"), strict=True):
        spark.conf.set(n, value)
    yield
    for n, value in zip(names, old, strict=True):
        spark.conf.set(n, value)


def test_running(spark, many_ranges):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, rnd.randrange(-5, 90)])) for i in range(3000)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    with Workspace(spark) as w:
        table = scan.positions(spark.createDataFrame(shuffled, "id long, v long"), ["id"], w)
        assert all(r["pos"] == r["id"] + 1 for r in table.collect())
        for how, step in (("sum", lambda a, b: a + b), ("max", max)):
            got = {r["id"]: r["x"] for r in scan.running(table, F.col("v"), how, "x").collect()}
            now = None
            for i, v in rows:
                now = v if now is None else now if v is None else step(now, v)
                assert got[i] == now
        got = {r["id"]: r["x"] for r in scan.running(table, F.when(F.col("v") > 80, F.struct("id", "v")), "max", "x").collect()}
        last = None
        for i, v in rows:
            last = (i, v) if v is not None and v > 80 else last
            assert (got[i] and tuple(got[i])) == last


def test_reached(spark):
    hops = [(i, i + 1) for i in range(0, 100)] + [(200, 205), (205, 50), (300, 301)]
    with Workspace(spark) as w:
        starts = spark.createDataFrame([(7,), (200,), (999,)], "pos long")
        found = scan.reached(starts, spark.createDataFrame(hops, "pos long, next long"), w).collect()
    assert sorted(r["pos"] for r in found) == [*range(7, 101), 200, 205, 999]


def plain_admitted(rows):
    out, held = {}, {}
    for k, t, run, end in sorted((r for r in rows if None not in r[:2]), key=lambda r: r[:3]):
        run_held, until = held.get(k, (None, t))
        ok = until is not None and t >= until
        if ok:
            held[k] = (run, None if end is None else max(end, t))
        out[run] = (ok, run if ok else run_held)
    return out


def test_admitted(spark, many_ranges):
    """A key with many runs, a hot key, ties, ends before the request and runs that never end."""
    rnd = random.Random(3)
    rows = []
    for run in range(4000):
        k = rnd.choice(["hot", "hot", f"k{rnd.randrange(40)}", "never"])
        t = rnd.randrange(3000)
        rows.append((k, t, run, None if k == "never" or rnd.random() < 0.0005 else t + rnd.choice([0, 0, 1, 7, 90, -5])))
    rows += [(None, 1, 5000, 2), ("k1", None, 5001, 2)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "k string, t long, run long, e long, pos int, row string, held int")
    got = state.admitted(table, "k", "t", "run", "e")
    assert got.columns == [*table.columns, "accepted", "active_run"]
    assert {r["run"]: (r["accepted"], r["active_run"]) for r in got.collect()} == plain_admitted(rows)
    assert state.admitted(table.limit(0), "k", "t", "run", "e").count() == 0
    with pytest.raises(ValueError):
        state.admitted(table.withColumn("accepted", F.lit(1)), "k", "t", "run", "e")


def test_observed_states(spark, many_ranges):
    """A key with half of all events lies in many ranges; every event has the state of a plain loop."""
    rnd = random.Random(4)
    rows = []
    for i in range(8000):
        who = rnd.choice(["hot", f"k{rnd.randrange(60)}", None if rnd.random() < 0.02 else "few"])
        rows.append((who, rnd.randrange(4000), i, rnd.choice([*state.TRANSITIONS][:4] * 200 + [*state.TRANSITIONS, None, "other"]), "z"))
    table = spark.createDataFrame(rows, "part string, place int, no int, event string, row string")
    observed = state.observed_states(table, "part", ["place", "no"], "event")
    assert observed.columns == ["part", "place", "no", "event", "state_before", "accepted", "state_after"]
    got = {r["no"]: (r["state_before"], r["accepted"], r["state_after"]) for r in observed.collect()}
    now, want, began, ended, n = {}, {}, {}, {}, {}
    for who, at, i, event, _ in sorted(rows, key=lambda r: r[1:3]):
        before = now.get(who, "pendingCapture")
        to, sources = state.TRANSITIONS.get(event, (None, ()))
        ok = before in sources
        now[who] = to if ok else before
        n[who] = n.get(who, 0) + ok
        want[i] = (before, ok, now[who])
        if ok and to == "discovering":
            began[who] = at
        if ok and to in state.TERMINAL:
            ended[who] = at
    assert got == want
    times = {r["part"]: r for r in state.run_times(observed, "part", ["place", "no"], "place").collect()}
    assert {k: (r["state"], r["analysis_started_at"], r["terminal_at"], r["accepted_events"]) for k, r in times.items()} == {k: (s, began.get(k), ended.get(k), n[k]) for k, s in now.items()}
    assert state.observed_states(table.limit(0), "part", ["place", "no"], "event").count() == 0


def plain_pages(rows, budget, suggested=None, excluded=0, skipped=0):
    """Supported names, the count, and the pages of one list of (name, size, cursor, envelope, probe), in order."""
    unsupported, count, before = set(), excluded, -1
    while before != count:
        before, behind = count, False
        for name, size, cursor, _, probe in reversed(rows):
            if name in unsupported:
                continue
            if probe + size + (cursor if behind else 4) + 4 + len(str(count)) > budget:
                unsupported.add(name)
                count += 1
            else:
                behind = True
    shown = next((r[1] for r in rows if r[0] == suggested and r[0] not in unsupported), 4)
    left = [r for r in rows[skipped:] if r[0] not in unsupported]
    pages = []
    while left:
        now, sugg = [], 4 if pages else shown
        measure = lambda part, s, more: part[0][3] + sum(r[1] for r in part) + len(part) - 1 + (part[-1][2] if more else 4) + s + len(str(count))
        for i, r in enumerate(left):
            more = i < len(left) - 1
            if measure([*now, r], sugg, more) <= budget:
                now.append(r)
            elif now:
                break
            else:
                sugg = 4
                if measure([r], sugg, more) > budget:
                    return unsupported, count, pages
                now.append(r)
        pages.append(([r[0] for r in now], sugg != 4))
        left = left[len(now) :]
    return unsupported, count, pages


@pytest.mark.parametrize("seed", range(3))
def test_pages(spark, many_ranges, seed):
    """Lists of any length, with rows that fit no page, suggestions that fit beside few rows, and counts that gain digits."""
    rnd = random.Random(seed)
    budget, rows, lists = 400, [], {}
    for k in range(12):
        envelope, probe = rnd.randrange(60, 120), rnd.randrange(40, 200)
        n = rnd.choice([0, 1, 2, 30, 700 if k == 3 else 5])
        start = rnd.choice([0, 8, 98])
        listed = [(f"n{i:04}", rnd.choice([20, 50, 51, 90, 150, 170 + i % 120]), rnd.choice([3, 8, 40]), envelope, probe) for i in range(n)]
        suggestion = rnd.choice([None, *(r[0] for r in listed)]) if listed else None
        skipped = rnd.choice([0, 0, rnd.randrange(n + 1)])
        lists[k] = (listed, suggestion, start, skipped)
        rows += [(k, *r, r[0] == suggestion, start, i < skipped) for i, r in enumerate(listed)]
    rnd.shuffle(rows)
    table = spark.createDataFrame([*rows, (None, "n", 1, 1, 1, 1, False, 0, False)], "k int, name string, size int, cursor int, envelope int, probe int, suggested boolean, start int, pos boolean")
    got = paging.pages(table, "k", ["name"], *(F.col(c) for c in ("size", "cursor", "envelope", "probe")), budget, F.col("suggested"), F.col("start"), F.col("pos")).collect()
    assert len(got) == len(rows)
    for k, (listed, suggestion, start, skipped) in lists.items():
        unsupported, count, pages = plain_pages(listed, budget, suggestion, start, skipped)
        mine = {r["name"]: r for r in got if r["k"] == k}
        assert {n for n, r in mine.items() if not r["supported"]} == unsupported and {r["unsupported_count"] for r in mine.values()} <= {count}
        want = {name: (i, s) for i, (names, s) in enumerate(pages, 1) for name in names}
        assert {n: (r["page"], r["with_suggestion"]) for n, r in mine.items() if r["page"] is not None} == want


def test_capacity(spark):
    """722 targets with long names and quotes in pages of 48 KiB: every response fits, each target is on one page, in order."""
    names = [(0, f"refs/heads/local-{i:03}-" + "x" * 180) for i in range(360)] + [(1, f"refs/remotes/origin/remote-{i:03}-" + "y" * 180) for i in range(360)] + [(0, 'refs/heads/with"quote'), (1, 'refs/remotes/origin/with"quote')]
    random.Random(2).shuffle(names)
    rows = [("capacity", kind, "local" if kind == 0 else "remote", full.split("/", 2)[2], full, "a" * 40) for kind, full in names]
    table = spark.createDataFrame(rows, "list string, kind_ord int, kind string, name string, full_name string, revision string")
    item = lambda r: {"kind": r["kind"], "name": r["name"], "full_name": r["full_name"], "revision": r["revision"]}
    whole = lambda targets, suggestion, cursor: json.dumps({"protocolVersion": 1, "type": "result", "requestId": "capacity", "result": {"targets": targets, "suggestedTarget": suggestion, "nextCursor": cursor, "targetSetToken": "t" * 64, "unsupportedTargetCount": 0}}, separators=(",", ":"), ensure_ascii=False).encode()
    envelope = len(whole([], None, None)) - 4 - 4 - 1
    first = F.col("full_name") == 'refs/heads/with"quote'
    size, cursor = paging.json_bytes("kind", "name", "full_name", "revision"), F.octet_length(F.to_json(F.array("full_name"))) - 2
    order = ["kind_ord", F.encode("full_name", "UTF-16BE")]
    got = sorted(paging.pages(table, "list", order, size, cursor, F.lit(envelope), F.lit(envelope), suggested=first).collect(), key=lambda r: (r["kind_ord"], r["full_name"].encode("utf-16-be")))
    assert all(r["supported"] and r["unsupported_count"] == 0 and r["with_suggestion"] == (r["page"] == 1) for r in got)
    numbers = [r["page"] for r in got]
    assert numbers == sorted(numbers) and numbers[0] == 1 and numbers[-1] > 3
    suggestion = item(next(r for r in got if r["full_name"] == 'refs/heads/with"quote'))
    for page in range(1, numbers[-1] + 1):
        part = [r for r in got if r["page"] == page]
        cursor_ = part[-1]["full_name"] if page < numbers[-1] else None
        assert len(whole([item(r) for r in part], suggestion if page == 1 else None, cursor_)) <= paging.PAGE_BYTES
        if page < numbers[-1]:
            more = got[got.index(part[-1]) + 1]
            after = more["full_name"] if more is not got[-1] else None
            assert len(whole([*map(item, part), item(more)], suggestion if page == 1 else None, after)) > paging.PAGE_BYTES

"""The durable run log: changes as rows, current state as a fold, integrity as queries."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.operators.classify import ACTIVE, STATES, TERMINAL
from millrace.sources.tables import Workspace, materialize

#: The state that each kind of event leads to, and the states it may start from.
TRANSITIONS = {
    "capture": ("capturing", ("pendingCapture",)),
    "discover": ("discovering", ("capturing",)),
    "collect": ("collecting", ("discovering",)),
    "persist": ("persisting", ("collecting",)),
    "complete": ("completed", ("persisting",)),
    "completeWithLimitations": ("completedWithLimitations", ("persisting",)),
    "fail": ("failed", ACTIVE),
    "cancel": ("cancelled", ACTIVE),
    "interrupt": ("interrupted", ACTIVE),
}


def one_active(requests: DataFrame, key: str, order: list[str], run: str) -> DataFrame:
    """Active requests with accepted (the first of its key) and the run that holds the key.

    The holder is an aggregate of each key, joined back, so that a hot key is not sorted in one task.
    """
    taken = [c for c in ("accepted", "active_run") if c in requests.columns]
    if taken:
        raise ValueError(f"requests already have {taken}")
    holder = requests.groupBy(key).agg(F.min_by(run, F.struct(*order)).alias("active_run"))
    return requests.join(holder, key).withColumn("accepted", F.col(run) == F.col("active_run"))


def admitted(requests: DataFrame, key: str, at: str, run: str, end: str) -> DataFrame:
    """Requests over time with accepted and active_run, the run that holds the key then.

    A request is accepted if no accepted run of its key is active: a key is free again from its run's end on, which is null
    as long as the run goes on. Requests of one time go by ``run``, which tells all rows apart; an end before the request
    counts as at once. Rows without a key or a time are not judged and left out. A request leads to the first one after its
    run's end, and those that the first one of each key leads to are accepted; no key's rows are gathered in one task.
    """
    taken = [c for c in ("accepted", "active_run") if c in requests.columns]
    if taken:
        raise ValueError(f"requests already have {taken}")
    with Workspace(requests.sparkSession) as w:
        slim = requests.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(run).alias("run"), F.col(end).alias("end"), F.struct("*").alias("row"))
        rows = w.table(scan.positions(slim.where("k is not null and t is not null"), ["k", "t", "run"], w), "requests")
        ends = rows.where("end is not null").select("k", F.greatest("end", "t").alias("t"), "pos")
        hops = scan.next_rows(rows.select("k", "t", "pos"), ends, ["k", "t"], True, w)
        hops = hops.select("pos", F.greatest("next", F.col("pos") + 1).alias("next"))  # a run that ends at once frees the key for the one behind it
        own, other = rows.select("pos", F.col("k").alias("a")), rows.select(F.col("pos").alias("next"), F.col("k").alias("b"))
        hops = hops.join(own, "pos").join(other, "next").where("a = b").select("pos", "next")
        chosen = scan.reached(rows.groupBy("k").agg(F.min("pos").alias("pos")), hops, w).withColumn("accepted", F.lit(True))
        told = w.table(rows.join(chosen, "pos", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))), "judged")
        # the last accepted run holds the key; a key's first request is always accepted
        held = scan.running(told, F.when(F.col("accepted"), F.struct("pos", "run")), "max", "held")
        return materialize(held.select("row.*", "accepted", F.col("held.run").alias("active_run")), "admitted")


class Folds:
    """What runs of events do to each state, numbered as they are met; there are few, as they are maps between ten states.

    An event that may not start from a state leaves it (D2, D4, D8, W2). Number 0 leaves all states.
    """

    def __init__(self):
        self.step = {name: [STATES.index(to if s in sources else s) for s in STATES] for name, (to, sources) in TRANSITIONS.items()}
        self.ends, self.numbers, self.after = [tuple(range(len(STATES)))], {tuple(range(len(STATES))): 0}, {}

    def then(self, number: int, event: str | None) -> int:
        """The number of a map with one more event behind it."""
        got = self.after.get((number, event))
        if got is None:
            step = self.step.get(event, self.ends[0])
            ends = tuple(step[s] for s in self.ends[number])
            got = self.numbers.setdefault(ends, len(self.ends))
            if got == len(self.ends):
                self.ends.append(ends)
            if event in self.step:
                self.after[number, event] = got
        return got


@functools.cache
def composed() -> tuple[list[tuple[int, ...]], dict[tuple[int, str], int]]:
    """All compositions of the events' maps, and the number of each with one more event behind it."""
    folds, at = Folds(), 0
    while at < len(folds.ends):
        for event in TRANSITIONS:
            folds.then(at, event)
        at += 1
    return folds.ends, folds.after


def fold_ranges(events: DataFrame, key: str, order: list[str], event: str) -> DataFrame:
    """key, range, no, ends and n: for each key and range of its ordered events, the state that each state ends in, and how many events.

    Events are dealt by key and order, so a key with many has several ranges; what is listed is never more than a range.
    The list is folded by the numbers of the events' compositions, of which there are 555.
    """
    by = [key, *dict.fromkeys([*order, event])]
    maps, after = composed()
    kinds = {e: i for i, e in enumerate(TRANSITIONS, 1)}
    width = len(kinds) + 1
    table = lambda numbers: F.split(F.lit(" ".join(map(str, numbers))), " ").cast("array<int>")  # noqa: E731  one constant in the plan
    steps = table(n if e is None else after[n, e] for n in range(len(maps)) for e in (None, *TRANSITIONS))
    ends = table(s for m in maps for s in m)
    codes = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    code = F.coalesce(F.try_element_at(codes, F.col(event)), F.lit(0))
    listed = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(by[1:])), code.alias("code"))
    dealt = events.select(*by).repartitionByRange(*by).select(F.col(key).alias("key"), F.spark_partition_id().alias("range"), listed.alias("e"))
    found = dealt.groupBy("key", "range").agg(F.array_sort(F.collect_list("e")).alias("e"))
    number = F.aggregate("e", F.lit(0), lambda n, e: F.get(steps, n * width + e["code"]))
    numbered = found.select("key", "range", number.alias("number"), F.size("e").cast("long").alias("n"))
    told = F.transform(F.sequence(F.lit(0), F.lit(len(STATES) - 1)), lambda s: F.get(ends, F.col("number") * len(STATES) + s))
    return numbered.select("key", "range", F.lit(0).cast("long").alias("no"), told.alias("ends"), "n")


def fold_runs(events: DataFrame, key: str, order: list[str], event: str) -> DataFrame:
    """The state of each run from its own events in order, and their number (W2); a run may have any number of events.

    Only the maps of a run's ranges are gathered, at most one for each partition.
    """
    ranges = F.array_sort(F.collect_list(F.struct("range", "no", "ends")))
    end = F.aggregate(ranges, F.lit(STATES.index("pendingCapture")), lambda s, r: F.get(r["ends"], s))
    found = fold_ranges(events, key, order, event).groupBy("key").agg(end.alias("end"), F.sum("n").alias("events"))
    names = F.array(*(F.lit(s) for s in STATES))
    return found.select(F.col("key").alias(key), F.get(names, F.col("end")).alias("state"), "events")


def observed_states(events: DataFrame, key: str, order: list[str], event: str, start: str = "pendingCapture") -> DataFrame:
    """The events with state_before, accepted and state_after, the state that the update returns: the new one, or the one observed.

    ``order`` tells a key's events apart. An event that may not start from the run's state, an unknown or a null one
    changes nothing. A prefix scan: the ranges of the ordered events are folded to maps between states, the maps before
    a range give the state that it starts with, and each range is replayed on its own as a stream.
    """
    with Workspace(events.sparkSession) as w:
        columns = list(dict.fromkeys([key, *order, event]))
        named = {c: f"c{i}" for i, c in enumerate(columns)}
        table = scan.ranged(events.select(*(F.col(c).alias(n) for c, n in named.items())), [named[c] for c in (key, *order)], w, "events")
        entry = entry_states(table, named[key], named[event], start)
        rest = pa.schema([("state_before", pa.string()), ("accepted", pa.bool_()), ("state_after", pa.string())])

        def run(batches):
            part, last, at = None, None, None
            for b in batches:
                before, accepted, after = [], [], []
                for p, k, e in zip(*(b.column(c).to_pylist() for c in ("part", "key", "event")), strict=True):
                    if p != part or k != last and (k == k or last == last):  # NaN is one key
                        at = entry.get(p, start) if p != part else start
                        part, last = p, k
                    to, sources = TRANSITIONS.get(e, (None, ()))
                    before.append(at)
                    accepted.append(at in sources)
                    at = to if at in sources else at
                    after.append(at)
                new = pa.RecordBatch.from_arrays([pa.array(before, pa.string()), pa.array(accepted, pa.bool_()), pa.array(after, pa.string())], schema=rest)
                yield pa.RecordBatch.from_arrays([b.column("row"), *new.columns], names=["row", *rest.names])

        row = F.struct(*named.values())
        dealt = table.repartition("part").sortWithinPartitions("part", "place").select("part", F.col(named[key]).alias("key"), F.col(named[event]).alias("event"), row.alias("row"))
        told = dealt.mapInArrow(run, f"row {dealt.schema['row'].dataType.simpleString()}, state_before string, accepted boolean, state_after string")
        return materialize(told.select(*(F.col(f"row.{n}").alias(c) for c, n in named.items()), "state_before", "accepted", "state_after"), "observed")


def entry_states(table: DataFrame, key: str, event: str, start: str) -> dict[int, str]:
    """The state in which a range's first key comes out of the ranges before, of those whose first key began there (at most one entry a range)."""
    edges = table.groupBy("part").agg(F.min_by(F.struct(F.col(key).alias("k")), "place").alias("first"), F.max_by(F.struct(F.col(key).alias("k")), "place").alias("last"))
    pairs = edges.select("part", "first.k", F.col("last.k").alias("l")).orderBy("part").collect()  # a row for each range
    same = lambda a, b: a == b or a is not None and b is not None and a != a and b != b
    crossing = {r["part"] for p, r in zip(pairs, pairs[1:], strict=False) if same(p["l"], r["k"])}
    feeding = {p["part"] for p, r in zip(pairs, pairs[1:], strict=False) if r["part"] in crossing}
    if not crossing:
        return {}
    ends = {r["part"]: r["ends"] for r in last_key_maps(table.where(F.col("part").isin(*feeding)), key, event).collect()}  # one map a range
    out, at = {}, start
    for p, r in zip(pairs, pairs[1:], strict=False):
        if r["part"] in crossing:
            at = STATES[ends[p["part"]][STATES.index(at if p["part"] in out and same(p["k"], p["l"]) else start)]]
            out[r["part"]] = at
    return out


def last_key_maps(table: DataFrame, key: str, event: str) -> DataFrame:
    """part and ends: what the events of each range's last key do to each state."""

    def run(batches):
        folds, part, last, at = Folds(), None, None, 0
        done: list[tuple[int, tuple[int, ...]]] = []
        for b in batches:
            for p, k, e in zip(*(b.column(c).to_pylist() for c in ("part", "key", "event")), strict=True):
                if p != part:
                    if part is not None:
                        done.append((part, folds.ends[at]))
                    part, last, at = p, k, 0
                elif k != last and (k == k or last == last):
                    last, at = k, 0
                at = folds.then(at, e)
        if part is not None:
            done.append((part, folds.ends[at]))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.int32()))], names=["part", "ends"])

    dealt = table.repartition("part").sortWithinPartitions("part", "place").select("part", F.col(key).alias("key"), F.col(event).alias("event"))
    return dealt.mapInArrow(run, "part long, ends array<int>")


def run_times(observed: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Each run's state and times from its observed events: of entering discovering, a terminal state and interruption; and how many were accepted."""
    entered = lambda *states: F.min(F.when(F.col("accepted") & F.col("state_after").isin(*states), F.col(at)))
    return observed.groupBy(key).agg(
        F.max_by("state_after", F.struct(*order)).alias("state"), entered("discovering").alias("analysis_started_at"), entered(*TERMINAL).alias("terminal_at"),
        entered("interrupted").alias("interrupted_at"), F.count_if("accepted").alias("accepted_events"),
    )


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return last.select(key, *(F.col(f"v.{c}").alias(c) for c in rest))


def next_pending(runs: DataFrame) -> DataFrame:
    """The pending run to claim: not cancelled, requested first, ties by id."""
    ready = runs.where("state = 'pendingCapture' and cancellation_requested_at_unix_ms is null")
    return ready.orderBy("requested_at_unix_ms", "run_id").limit(1)


def bulk_transition(rows: DataFrame, state: str, when: Column, to: str) -> DataFrame:
    """Rows with the state changed where a condition holds, and changed."""
    hit = F.coalesce(when, F.lit(False))
    return rows.withColumn("changed", hit).withColumn(state, F.when(F.col("changed"), to).otherwise(F.col(state)))


def recover(runs: DataFrame, now_ms: int) -> DataFrame:
    """Active runs become interrupted, as at a start."""
    out = bulk_transition(runs, "state", F.col("state").isin(*ACTIVE), "interrupted")
    return out.withColumn("interrupted_at_unix_ms", F.when(F.col("changed"), F.lit(now_ms)).otherwise(F.col("interrupted_at_unix_ms")))


def request_cancel(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """The first cancellation of each active run sticks (D6, W5); requests have run_id, at."""
    first = requests.groupBy("run_id").agg(F.min("at").alias("__at"))
    old = F.col("cancellation_requested_at_unix_ms")
    return runs.join(first, "run_id", "left").withColumn("cancellation_requested_at_unix_ms", F.when(F.col("state").isin(*ACTIVE), F.coalesce(old, "__at")).otherwise(old)).drop("__at")


def step_fold(events: DataFrame) -> DataFrame:
    """Steps from begin and finish events (run_id, step_id, at, event, outcome): pending, running, then the first outcome."""
    begun = F.min(F.when(F.col("event") == "begin", F.col("at")))
    ended = F.min(F.when(F.col("event") == "finish", F.struct("at", "outcome")))
    steps = events.groupBy("run_id", "step_id").agg(begun.alias("started_at"), ended.alias("e"))
    done = (F.col("e.at") >= F.col("started_at")) & F.col("e").isNotNull()
    return steps.select("run_id", "step_id", "started_at", F.when(done, F.col("e.at")).alias("finished_at"), F.when(done, F.col("e.outcome")).when(F.col("started_at").isNotNull(), "running").otherwise("pending").alias("state"))


def commit_captures(stored: DataFrame, captures: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Captures that are not stored yet; a retry adds nothing.

    Of several captures of one run the first by ``order`` counts (by all columns where none is given).
    """
    rest = [c for c in captures.columns if c != "run_id"]
    first = F.min_by(F.struct(*rest), F.struct(*(order or rest)))
    once = captures.groupBy("run_id").agg(first.alias("v")).select("run_id", *(F.col(f"v.{c}").alias(c) for c in rest))
    return once.join(stored.select("run_id"), "run_id", "left_anti").select(*captures.columns)


def delete_cascade(parents: DataFrame, gone: DataFrame, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the deleted ones, and children without theirs."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def set_null(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """References to deleted rows become null."""
    keys = gone.select(F.col(key).alias(column), F.lit(True).alias("__gone")).distinct()
    return rows.join(keys, column, "left").withColumn(column, F.when(F.col("__gone"), None).otherwise(F.col(column))).drop("__gone")


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """constraint and key of each row that fails a named check; a null check passes, as in SQL."""
    failed = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())), lambda n: n.isNotNull())
    return rows.select(F.col(key).alias("key"), F.explode(failed).alias("constraint"))


def run_checks() -> dict[str, Column]:
    """The checks of the run table."""
    null, given = (lambda c: F.col(c).isNull()), (lambda c: F.col(c).isNotNull())
    state = F.col("state")
    capture = ("captured_at_unix_ms", "snapshot_id", "manifest_hash", "target_revision_at_capture", "head_revision_at_capture", "merge_base_revision")
    counts = ("captured_changed_file_count", "excluded_uncommitted_total", "excluded_staged_count", "excluded_unstaged_count", "excluded_untracked_count", "excluded_conflicted_count")
    set_ = sum((given(c).cast("int") for c in (*capture, *counts)), F.lit(0))
    positive = F.lit(True)
    for c in counts:
        positive = positive & (null(c) | (F.col(c) >= 0))
    return {
        "state": state.isin(*STATES),
        "terminal_fields": state.isin(*TERMINAL) == given("terminal_at_unix_ms"),
        "interruption_fields": (state == "interrupted") == given("interrupted_at_unix_ms"),
        "capture_fields": set_.isin(0, len(capture) + len(counts)),
        "capture_counts": positive,
        "manifest_hash": null("manifest_hash") | F.col("manifest_hash").rlike(r"\A[0-9a-f]{64}\z"),
    }


def entry_checks() -> dict[str, Column]:
    """The checks of the manifest entry table."""
    from millrace.functions.validators import MODES, is_object_id

    modes = F.col("merge_base_entry_mode").isin(*MODES) & F.col("head_entry_mode").isin(*MODES)
    return {
        "category": F.col("category").isin("added", "modified", "deleted", "renamed", "typeChanged"),
        "modes": modes,
        "object_ids": is_object_id(F.col("merge_base_object_id")) & is_object_id(F.col("head_object_id")),
        "original_path": (F.col("category") == "renamed") == F.col("original_path").isNotNull(),
    }


#: Fixed values.
STEP_STATES = ("pending", "running", "succeeded", "succeededWithLimitations", "failed", "skipped", "cancelled", "timedOut")


def step_checks() -> dict[str, Column]:
    """The check of the step table."""
    return {"step_state": F.col("state").isin(*STEP_STATES)}


def metadata_checks(product: str) -> dict[str, Column]:
    """The checks of the metadata table, of a product of this name."""
    return {"metadata_singleton": F.col("singleton_id") == 1, "metadata_product": F.col("product_name") == product, "metadata_schema": F.col("schema_version") > 0}


def application_checks() -> dict[str, Column]:
    """The checks of the application state table."""
    theme = F.col("color_theme")
    return {"application_singleton": F.col("singleton_id") == 1, "application_color_theme": theme.isNull() | theme.isin("light", "dark")}


def latest_epoch(rows: DataFrame, key: str, epoch: str) -> DataFrame:
    """The rows of each key's last epoch (W6): an aggregate joined back."""
    last = rows.groupBy(key).agg(F.max(epoch).alias(epoch))
    return rows.join(last, [key, epoch], "left_semi")


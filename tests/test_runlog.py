"""The run log's stream: order of arrival, restarts, late events, ties."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from millrace.operators import state
from millrace.streaming import runlog

SCHEMA = "run_id string, at timestamp, event_id long, event string"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    """The state store that the stream needs, for one test."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def feed(spark, folder, batches, delay):
    """Run each batch as a stream's restart of its own; all rows told, in order of batches."""
    told = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        events = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        out = runlog.timed_run_states(events, delay)
        got = []
        query = out.writeStream.outputMode("update").foreachBatch(lambda df, _, got=got: got.extend(df.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        told.append(got)
    return told


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_any_order_within_the_watermark(rocks, tmp_path):
    """Events shuffled within the delay, over restarts, give the batch fold's states; ties go by id, repeats count."""
    rng, names = random.Random(3), [*state.TRANSITIONS, "unknown", None]
    steps = ["capture", "discover", "collect", "persist", "complete"]
    rows = [("good", at(10 * i), i, e) for i, e in enumerate(steps)] + [("tie", at(5), 2, "discover"), ("tie", at(5), 1, "capture"), ("tie", at(5), 1, "capture")]
    rows += [(f"r{rng.randrange(4)}", at(rng.randrange(60)), i, rng.choice(names)) for i in range(60)]
    rng.shuffle(rows)
    third = len(rows) // 3
    told = feed(rocks, str(tmp_path), [rows[:third], rows[third : 2 * third], rows[2 * third :]], "1 minute")
    last = {r["run_id"]: (r["state"], r["events"]) for batch in told for r in batch if r["kind"] == "state"}
    folded = state.fold_runs(rocks.createDataFrame(rows, SCHEMA), "run_id", ["at", "event_id"], "event").collect()
    assert last == {r["run_id"]: (r["state"], r["events"]) for r in folded}
    assert last["good"] == ("completed", 5) and last["tie"] == ("discovering", 3)
    assert not [r for batch in told for r in batch if r["kind"] == "late"]


def test_late_events_are_listed_and_change_nothing(rocks, tmp_path):
    """What the watermark has passed is settled; an event behind it, or without a time, is listed; one exactly at it is in time."""
    first = [("a", at(0), 1, "capture"), ("a", at(100), 3, "discover"), ("b", at(100), 1, "capture")]
    second = [("a", at(39), 9, "cancel"), ("a", None, 8, "fail"), ("b", at(40), 2, "interrupt")]
    told = feed(rocks, str(tmp_path), [first, second, [("c", at(300), 1, "capture")], []], "60 seconds")
    late = {(r["run_id"], r["event_id"], r["event"], r["at"]) for batch in told for r in batch if r["kind"] == "late"}
    assert late == {("a", 9, "cancel", int(at(39).timestamp()) * 10**6), ("a", 8, "fail", None)}
    last = {r["run_id"]: (r["state"], r["events"], r["settled"]) for batch in told for r in batch if r["kind"] == "state"}
    assert last == {"a": ("discovering", 2, 2), "b": ("interrupted", 2, 2), "c": ("capturing", 1, 0)}

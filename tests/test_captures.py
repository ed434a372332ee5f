"""Captures: both tables or neither, repeats, killed batches, the identity guard."""

import pytest

from millrace.operators import captures

RUN = "run_id string, canonical_path_key string, target string, target_revision string, head_revision string, state string, captured_at_unix_ms long, cancellation_requested_at_unix_ms long"
CAPTURE = "run_id string, snapshot_id string, canonical_path_key string, target string, target_revision string, head_revision string, captured_at_unix_ms long"
SAME = ("k", "t", "1", "2")


@pytest.fixture
def tables(spark):
    """Runs in all conditions, a capture of each, and entries."""
    runs = [("ok", *SAME, "capturing", None, None), ("none", *SAME, "capturing", None, None), ("done", *SAME, "completed", None, None), ("had", *SAME, "capturing", 5, None), ("stop", *SAME, "capturing", None, 7), ("other", *SAME, "capturing", None, None), ("null", *SAME[:3], None, "capturing", None, None)]
    made = [("ok", "s2", *SAME, 12), ("ok", "s1", *SAME, 11), ("none", "s3", *SAME, 13), ("done", "s4", *SAME, 14), ("had", "s5", *SAME, 15), ("stop", "s6", *SAME, 16), ("other", "s7", "k", "t", "1", "9", 17), ("other", "s8", *SAME, 18), ("null", "s9", *SAME[:3], None, 19), ("gone", "s0", *SAME, 20)]
    rows = [("s1", "a", 1), ("s1", "b", 2), ("s2", "c", 3), ("s7", "d", 4), ("s8", "e", 5), ("s8", "e", 5), ("sx", "f", 6)]
    return spark.createDataFrame(runs, RUN), spark.createDataFrame(made, CAPTURE), spark.createDataFrame(rows, "snapshot_id string, path string, n int")


WANT = {"s1": "committed", "s2": "movedOn", "s3": "committed", "s4": "movedOn", "s5": "movedOn", "s6": "movedOn", "s7": "identityMismatch", "s8": "committed", "s9": "identityMismatch", "s0": "unknownRun"}


def seen(store):
    """What a reader sees."""
    return sorted((r["run_id"], r["snapshot_id"], r["entry_count"]) for r in store.headers().collect()), sorted((r["run_id"], r["path"]) for r in store.entries().collect())


BOTH = ([("none", "s3", 0), ("ok", "s1", 2), ("other", "s8", 2)], [("ok", "a"), ("ok", "b"), ("other", "e"), ("other", "e")])


def test_commit_and_repeat(spark, tables, tmp_path):
    """Each capture's outcome; the same batch again, and the same captures in a later batch, add nothing."""
    runs, made, rows = tables
    store = captures.CaptureStore(spark, f"file://{tmp_path}", made, rows)
    assert seen(store) == ([], [])
    for _ in range(2):
        assert {r["snapshot_id"]: r["outcome"] for r in store.commit(0, runs, made, rows, ["captured_at_unix_ms"]).collect()} == WANT
        assert seen(store) == BOTH
    again = {r["snapshot_id"]: r["outcome"] for r in store.commit(1, runs, made, rows, ["captured_at_unix_ms"]).collect()}
    assert "committed" not in again.values() and again["s7"] == "identityMismatch"
    assert seen(store) == BOTH
    got = {r["run_id"]: (r["captured_at_unix_ms"], r["snapshot_id"], r["captured_changed_file_count"]) for r in store.captured(runs).collect()}
    assert got["ok"] == (11, "s1", 2) and got["none"] == (13, "s3", 0) and got["had"] == (5, None, None) and len(got) == 7


@pytest.mark.parametrize("step", ["entries", "headers", "done"])
def test_killed_batch(spark, tables, tmp_path, monkeypatch, step):
    """A batch that ends before or at any of its writes shows nothing; when it comes again it shows one header a run and its entries."""
    runs, made, rows = tables
    store = captures.CaptureStore(spark, f"file://{tmp_path}", made, rows)

    def killed(table, batch, path=store.path):
        if table == step:
            raise KeyboardInterrupt
        return path(table, batch)

    def unmarked(batch):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "mark", unmarked) if step == "done" else m.setattr(store, "path", killed)
        with pytest.raises(KeyboardInterrupt):
            store.commit(0, runs, made, rows, ["captured_at_unix_ms"])
    assert seen(store) == ([], [])
    store.commit(0, runs, made, rows, ["captured_at_unix_ms"])
    assert seen(store) == BOTH


def test_from_a_stream(spark, tables, tmp_path):
    """The store as a stream's sink: a restarted stream that lost its own record of a batch commits it once."""
    runs, made, rows = tables
    made.write.parquet(str(tmp_path / "in"))
    store = captures.CaptureStore(spark, f"file://{tmp_path}/store", made, rows)
    for checkpoint in ("cp1", "cp2"):
        stream = spark.readStream.schema(CAPTURE).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(lambda df, batch: store.commit(batch, runs, df, rows, ["captured_at_unix_ms"]) and None).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        assert seen(store) == BOTH


def test_empty(spark, tables, tmp_path):
    """A batch without captures is visible and empty."""
    runs, made, rows = tables
    store = captures.CaptureStore(spark, f"file://{tmp_path}", made, rows)
    assert store.commit(3, runs, made.limit(0), rows, ["captured_at_unix_ms"]).count() == 0
    assert store.done() == [3] and seen(store) == ([], [])

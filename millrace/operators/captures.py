"""Captures committed to a store of two tables, headers and manifest entries, both visible or neither.

The store is a folder in any file system that Spark writes. A batch's files lie in folders of its own, so that a batch
which was killed is written over when it comes again, and its marker is made last: readers take only batches with a marker,
and a batch that has one is not written again. One writer at a time, as a stream's ``foreachBatch`` is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import _file_system

#: What a capture and its accepted run must have in common.
IDENTITY = ("canonical_path_key", "target", "target_revision", "head_revision")
OUTCOMES = ("committed", "movedOn", "identityMismatch", "unknownRun")


class CaptureStore:
    """Headers, entries and outcomes of committed batches under ``root``; the schemas are those of the tables that ``commit`` is given.

    ``captures`` has run_id (of the runs' type), snapshot_id (a text of its own for each capture), IDENTITY and any other
    columns of a header; ``entries`` has snapshot_id and any other columns of an entry, but run_id.
    """

    def __init__(self, spark: SparkSession, root: str, captures: DataFrame, entries: DataFrame):
        self.spark, self.root = spark, root.rstrip("/")
        self.header_schema = captures.limit(0).withColumn("entry_count", F.lit(0).cast("long")).schema
        self.entry_schema = entries.limit(0).withColumn("run_id", F.lit(None).cast(captures.schema["run_id"].dataType)).schema

    def path(self, table: str, batch: int) -> str:
        """A batch's folder of a table."""
        return f"{self.root}/{table}/{batch:020d}"

    def done(self) -> list[int]:
        """The batches that have their marker."""
        system, where = _file_system(self.spark, f"{self.root}/done")
        return sorted(int(f.getPath().getName()) for f in system.listStatus(where)) if system.exists(where) else []

    def mark(self, batch: int) -> None:
        """Make a batch visible: its marker is one empty file, which is there or not."""
        system, where = _file_system(self.spark, f"{self.root}/done/{batch:020d}")
        system.create(where, True).close()

    def read(self, table: str, schema) -> DataFrame:
        """The rows of all visible batches; an open plan keeps the batches that were visible when it was made."""
        paths = [self.path(table, b) for b in self.done()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def headers(self) -> DataFrame:
        """The header of each committed capture, with entry_count."""
        return self.read("headers", self.header_schema)

    def entries(self) -> DataFrame:
        """The entries of committed captures, with run_id."""
        return self.read("entries", self.entry_schema)

    def outcomes(self, batch: int) -> DataFrame:
        """What came of each capture of a visible batch."""
        return self.spark.read.parquet(self.path("outcomes", batch))

    def commit(self, batch: int, runs: DataFrame, captures: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
        """Commit a batch's captures and return run_id, snapshot_id and outcome of each; a repeated batch changes nothing and gives the same.

        ``runs`` has each run once: run_id, IDENTITY, state, captured_at_unix_ms and cancellation_requested_at_unix_ms.
        A capture of no known run is ``unknownRun``; of another identity (null is another one) ``identityMismatch``; of
        a run that isn't capturing, has a capture or is to be cancelled, or behind the first of its run by ``order`` and
        snapshot_id, ``movedOn``. Only the first of those that could be committed is; entries of others are not kept.
        """
        if batch in self.done():
            return self.outcomes(batch)
        judged = self.judge(runs, captures, order)
        judged.select("run_id", "snapshot_id", "outcome").write.mode("overwrite").parquet(self.path("outcomes", batch))
        kept = self.outcomes(batch).where("outcome = 'committed'").select("run_id", "snapshot_id")
        rows = entries.join(kept, "snapshot_id").select(*self.entry_schema.names)
        rows.write.mode("overwrite").parquet(self.path("entries", batch))
        counts = self.spark.read.schema(self.entry_schema).parquet(self.path("entries", batch)).groupBy("snapshot_id").agg(F.count("*").alias("entry_count"))
        heads = captures.join(kept, ["run_id", "snapshot_id"], "left_semi").join(counts, "snapshot_id", "left")
        heads = heads.withColumn("entry_count", F.coalesce("entry_count", F.lit(0).cast("long"))).select(*self.header_schema.names)
        heads.write.mode("overwrite").parquet(self.path("headers", batch))
        self.mark(batch)
        return self.outcomes(batch)

    def judge(self, runs: DataFrame, captures: DataFrame, order: list[str]) -> DataFrame:
        """Captures with their outcome; a run's first is an aggregate, met again by the capture's own id, so that a run with many captures is not sorted in one task."""
        state = ("state", "captured_at_unix_ms", "cancellation_requested_at_unix_ms")
        known = runs.select("run_id", F.struct(*IDENTITY, *state).alias("run")).join(self.headers().select("run_id", F.lit(True).alias("held")).distinct(), "run_id", "left")
        met = captures.select("run_id", "snapshot_id", F.struct(*order, "snapshot_id").alias("rank"), F.struct(*IDENTITY).alias("own")).join(known, "run_id", "left")
        outcome = F.when(F.col("run").isNull(), "unknownRun").when(~same_identity(), "identityMismatch").when(moved_on(), "movedOn").otherwise("committed")
        told = met.select("run_id", "snapshot_id", "rank", outcome.alias("outcome"))
        first = told.where("outcome = 'committed'").groupBy("run_id").agg(F.min("rank").alias("rank")).select(F.col("rank.snapshot_id").alias("snapshot_id"), F.lit(True).alias("first"))
        lost = (F.col("outcome") == "committed") & F.col("first").isNull()
        return told.join(first, "snapshot_id", "left").withColumn("outcome", F.when(lost, "movedOn").otherwise(F.col("outcome")))

    def captured(self, runs: DataFrame) -> DataFrame:
        """Runs with captured_at_unix_ms, snapshot_id and captured_changed_file_count of their header, where they have one."""
        new = {"captured_at_unix_ms": "captured_at_unix_ms", "snapshot_id": "snapshot_id", "captured_changed_file_count": "entry_count"}
        head = self.headers().select("run_id", F.struct(*new.values()).alias("committed_header"))
        rest = [c for c in runs.columns if c not in new]
        given = {n: F.coalesce(F.col(f"committed_header.{c}"), F.col(n)) if n in runs.columns else F.col(f"committed_header.{c}") for n, c in new.items()}
        return runs.join(head, "run_id", "left").select(*rest, *(c.alias(n) for n, c in given.items()))


def same_identity() -> Column:
    """Whether a capture's own identity is its run's."""
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.coalesce(F.col(f"own.{c}") == F.col(f"run.{c}"), F.lit(False))
    return same


def moved_on() -> Column:
    """Whether a run takes no capture any more."""
    capturing = F.coalesce(F.col("run.state") == "capturing", F.lit(False))
    return ~capturing | F.col("run.captured_at_unix_ms").isNotNull() | F.col("run.cancellation_requested_at_unix_ms").isNotNull() | F.col("held").isNotNull()

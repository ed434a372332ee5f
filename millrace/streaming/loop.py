"""The request loop as an ordered stream over the run log: each batch is answered once, in the order of its requests.

A batch's requests see what those before them changed: a run that an earlier one started, a cancellation that an earlier
one asked for. Between two starts for one repository only the first can be accepted, as no run ends within a batch; so
the order needs no loop over requests, and every step is a join on a key. The responses, and the runs that a batch
changed, are written to folders of the batch and then marked; a batch that was killed is written over when it comes again,
a marked one is passed over.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import actions, classify, state
from millrace.operators.contract import REFUSED_WHILE_ACTIVE, parse_requests, responses
from millrace.sources.tables import Workspace, _file_system

RUNS = (
    "run_id string, state string, canonical_repository_path_key string, repository_id string, repository_display_name string, canonical_repository_path string, head_revision string, "
    "target string, target_revision string, freshness_token string, requested_at_unix_ms long, capture_started_at_unix_ms long, captured_at_unix_ms long, snapshot_id string, "
    "captured_changed_file_count long, excluded_uncommitted_total long, excluded_staged_count long, excluded_unstaged_count long, excluded_untracked_count long, excluded_conflicted_count long, "
    "cancellation_requested_at_unix_ms long, terminal_at_unix_ms long, limitation_count long, failure_code string, interrupted_at_unix_ms long, interruption_reason string"
)
#: What a start's check tells of the repository and the comparison.
FACTS = ("repository_id", "repository_display_name", "canonical_repository_path", "head_revision", "target_revision")


def claim(runs: DataFrame, now_ms: int) -> DataFrame:
    """The pending run that is claimed next, capturing now; none while another run is past pending."""
    busy = runs.where(F.col("state").isin(*(s for s in classify.ACTIVE if s != "pendingCapture"))).limit(1).select(F.lit(True).alias("busy"))
    return state.next_pending(runs).join(busy, F.lit(True), "left_anti").withColumn("state", F.lit("capturing")).withColumn("capture_started_at_unix_ms", F.lit(now_ms).cast("long"))


class RequestLoop:
    """Answers to request lines (file, offset, value, too_large) and the run log behind them, under ``root``.

    ``paths`` has path (each once) and canonical_path_key. ``check`` gives, for starts (name, canonical_path_key, target,
    freshness_token), what ``actions.check_freshness`` does, with FACTS. ``others`` answers the rest of the actions (parsed rows
    with name, turn, path, canonical_path_key) with name, error and result; without it they are unexpectedFailure. ``step``
    takes the runs after a batch's requests and the time, and gives those that it changes: by default it claims one pending run.
    ``runs`` is the log from before; its active runs become interrupted at batch 0. One loop at a time writes to a root.
    """

    def __init__(self, spark: SparkSession, root: str, runs: DataFrame, paths: DataFrame, check: Callable[[DataFrame], DataFrame], others: Callable[[DataFrame], DataFrame] | None = None, step: Callable[[DataFrame, int], DataFrame] = claim, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.root, self.initial, self.paths, self.check, self.others, self.step, self.clock = spark, root.rstrip("/"), runs, paths, check, others, step, clock
        self.schema = spark.createDataFrame([], RUNS).schema

    def path(self, table: str, batch: int) -> str:
        """A batch's folder of a table."""
        return f"{self.root}/{table}/{batch:020d}"

    def done(self) -> list[int]:
        """The batches that are marked."""
        system, where = _file_system(self.spark, f"{self.root}/done")
        return sorted(int(f.getPath().getName()) for f in system.listStatus(where)) if system.exists(where) else []

    def runs(self) -> DataFrame:
        """The run log after all marked batches: each run's last version."""
        names = self.schema.names
        first = self.initial.select(*names).withColumn("version", F.lit(-1).cast("long"))
        later = [self.spark.read.schema(self.schema).parquet(self.path("runs", b)).withColumn("version", F.lit(b).cast("long")) for b in self.done()]
        for df in later:
            first = first.unionByName(df)
        return state.latest_per_key(first, "run_id", ["version"]).select(*names)

    def answers(self, batch: int) -> DataFrame:
        """The response lines of a marked batch, in files that are ordered by their names."""
        return self.spark.read.text(self.path("responses", batch))

    def serve(self, requests: DataFrame, batch: int) -> None:
        """Answer a batch and change the log, or do nothing if that was done."""
        if batch in self.done():
            return
        now = self.clock()
        with Workspace(self.spark) as w:
            log = self.runs() if batch else state.recover(self.runs(), now).drop("changed")
            log = w.table(log.select(*self.schema.names), "log")
            parsed = parse_requests(requests.select("file", "offset", "value", "too_large"))
            member = lambda n: F.get_json_object("parameters", f"$.{n}")
            named = parsed.select("*", F.concat("file", F.lit(":"), F.col("offset").cast("string")).alias("name"), F.struct("file", "offset").alias("turn"), member("path").alias("path"), F.lower(member("runId")).alias("run_id"), member("target").alias("target"), member("freshnessToken").alias("freshness_token"))
            asked = w.table(named.join(self.paths.select("path", "canonical_path_key"), "path", "left"), "asked")
            good = asked.where("error is null")
            of = lambda action: good.where(F.col("action") == action)
            new, started = self.start(of("analysis.start"), log, now, w)
            cancels = of("analysis.cancel")
            all_runs = log.withColumn("visible_from", F.lit(None).cast(asked.schema["turn"].dataType)).unionByName(new)
            active = all_runs.where(classify.is_active(F.col("state")) & F.col("cancellation_requested_at_unix_ms").isNull()).select("run_id", "visible_from")
            first = cancels.select("run_id", "turn").join(active, "run_id").where(F.coalesce(F.col("visible_from") < F.col("turn"), F.lit(True))).groupBy("run_id").agg(F.min("turn").alias("cancelled_from"))
            all_runs = w.table(all_runs.join(first, "run_id", "left"), "runs")
            rest = good.where(~F.col("action").isin("analysis.start", "analysis.cancel", "analysis.pollRun", "analysis.getActive"))
            held = all_runs.where(classify.is_active(F.col("state"))).select(F.col("canonical_repository_path_key").alias("canonical_path_key"), F.struct("visible_from").alias("held"))
            busy = F.col("held").isNotNull() & F.coalesce(F.col("held.visible_from") < F.col("turn"), F.lit(True)) & F.col("action").isin(*REFUSED_WHILE_ACTIVE)
            rest = w.table(rest.join(held, "canonical_path_key", "left").withColumn("busy", busy).drop("held"), "rest")
            free = rest.where("not busy").drop("busy")
            other = self.others(free) if self.others else free.select("name", F.lit("unexpectedFailure").alias("error"), F.lit(None).cast("string").alias("result"))
            told = started.unionByName(actions.cancel(cancels, all_runs)).unionByName(actions.poll_run(of("analysis.pollRun"), all_runs)).unionByName(actions.get_active(of("analysis.getActive"), all_runs))
            told = told.unionByName(other.select("name", "error", "result")).unionByName(rest.where("busy").select("name", F.lit("repositoryBusy").alias("error"), F.lit(None).cast("string").alias("result")))
            lines = asked.join(told.withColumnRenamed("error", "found"), "name", "left").withColumn("error", F.coalesce("error", "found"))
            responses(lines.orderBy("file", "offset")).write.mode("overwrite").text(self.path("responses", batch))
            after = all_runs.withColumn("cancellation_requested_at_unix_ms", F.when(F.col("cancelled_from").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("cancellation_requested_at_unix_ms")))
            after = w.table(after.select(*self.schema.names), "after")
            stepped = self.step(after, now).select(*self.schema.names)
            whole = state.latest_per_key(after.withColumn("version", F.lit(0)).unionByName(stepped.withColumn("version", F.lit(1))), "run_id", ["version"]).select(*self.schema.names)
            before = self.initial if not self.done() else log
            whole.exceptAll(before.select(*self.schema.names)).write.mode("overwrite").parquet(self.path("runs", batch))
        system, where = _file_system(self.spark, f"{self.root}/done/{batch:020d}")
        system.create(where, True).close()

    def start(self, starts: DataFrame, log: DataFrame, now: int, w: Workspace) -> tuple[DataFrame, DataFrame]:
        """The runs that a batch's starts make, with visible_from, and the answers. A run's id follows from its request's place."""
        h = F.sha2("name", 256)
        made = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
        asked = w.table(starts.select("name", "turn", "canonical_path_key", "target", "freshness_token", made.alias("run_id"), F.lit(now).cast("long").alias("requested_at")), "starts")
        known = asked.where("canonical_path_key is not null")
        checked = w.table(self.check(known.select("name", "canonical_path_key", "target", "freshness_token")).select("name", "error", "freshness", *FACTS), "checked")
        told = w.table(actions.start(known.select("name", "turn", "canonical_path_key", "run_id", "requested_at"), checked, log, ["turn"]), "started")
        rows = known.join(told.where("state = 'accepted'").select("name"), "name").join(checked.select("name", *FACTS), "name")
        given = {"state": F.lit("pendingCapture"), "canonical_repository_path_key": F.col("canonical_path_key"), "requested_at_unix_ms": F.col("requested_at")}
        here = {f.name: given.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema}
        gone = asked.where("canonical_path_key is null").select("name", F.lit("repositoryUnavailable").alias("error"), F.lit(None).cast("string").alias("result"))
        return w.table(rows.select(*here.values(), F.col("turn").alias("visible_from")), "new"), told.select("name", "error", "result").unionByName(gone)

    def run(self, requests: DataFrame, checkpoint: str) -> StreamingQuery:
        """Answer a stream of request lines, as ``sources.lines`` gives them."""
        return requests.writeStream.foreachBatch(lambda df, batch: self.serve(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

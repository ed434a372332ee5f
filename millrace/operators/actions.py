"""The comparison and analysis actions over tables of captured facts, any number of comparisons at once.

A comparison is a row with a name of its own (without NUL); its captured outputs have the same name. Each action gives one
row a comparison: ``error``, a key of ``contract.ERRORS`` or null, and ``result``, a JSON text or null, as ``contract.responses`` takes
them. Every step is grouped or joined by comparison, so none sees more than one comparison's facts at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.canonical import utf16
from millrace.functions.validators import checked_count, is_target_ref, is_token
from millrace.operators import classify, fingerprint, lineage, paging
from millrace.operators.state import one_active
from millrace.sources import records as R

FACTS = ("path", "original_path", "is_staged", "is_unstaged", "is_untracked", "is_conflicted", "is_ignored")
COUNTS = ("changed", "uncommitted", "staged", "unstaged", "untracked", "conflicted")


#: The longest query, and the request id with which a target alone is measured.
MAX_QUERY, PROBE_ID = 256, "comparison-target-page"


def verdict(outputs: DataFrame, read: DataFrame, label: str) -> DataFrame:
    """name and, in ``label``, good, tooLarge or inspectionFailed, of each captured output."""
    bad = R.failures(read)
    said = F.when(F.col("reason") == "tooLarge", "tooLarge").when(F.col("bad_count").isNotNull(), "inspectionFailed").otherwise("good")
    return outputs.select("name").distinct().join(bad, "name", "left").select("name", said.alias(label))


def file_counts(committed: DataFrame, working: DataFrame) -> DataFrame:
    """The six counts of each comparison with any file (A1): lineages stay within their comparison, as paths carry its name."""
    own = lambda df: df.select(*(F.concat("name", F.lit("\0"), c).alias(c) if c in FACTS[:2] else F.col(c) for c in df.columns if c != "name"))
    files = lineage.lineages(lineage.union_file_records(own(committed), own(working))).withColumn("name", F.substring_index("path", "\0", 1))
    when = {"changed": F.lit(True), "uncommitted": ~F.col("is_committed")} | {c: F.col(f"is_{c}") for c in COUNTS[2:]}
    counts = lineage.distinct_counts(files, "root", when, ["name"])
    return counts.select("name", *(checked_count(F.col(c)).alias(c) for c in COUNTS))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """name of the comparisons whose two readings of the working tree differ (W9), by signed counts of equal rows."""
    sides = before.select("name", *FACTS, F.lit(1).alias("sign")).unionByName(after.select("name", *FACTS, F.lit(-1).alias("sign")))
    return sides.groupBy("name", *FACTS).agg(F.sum("sign").alias("sign")).where("sign <> 0").select("name").distinct()


def prepare(requests: DataFrame, targets: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """comparisons.prepare: name, error, result, and the facts the result is made of.

    ``requests`` has name, target, repository (canonical_path, name, head), target_set_token and, as read at the end,
    ending_head, ending_target_revision, ending_target_set_token; ``targets`` has name, kind, short_name, full_name and
    revision of each comparison's targets; ``outputs`` has the captures bases, counts, diff, before and after. A comparison
    without one of its captures has failed. A target that isn't there exactly once is invalid. The first error in the order
    of the steps counts. Renames are followed while the plan is made: that starts jobs.
    """
    read = {
        "bases": R.merge_base_records(outputs["bases"]), "counts": R.commit_count_records(outputs["counts"]), "diff": R.raw_diff_records(outputs["diff"]),
        "before": R.status_records(outputs["before"]), "after": R.status_records(outputs["after"]),
    }
    before, after = R.scan_status(outputs["before"]), R.scan_status(outputs["after"])
    chosen = targets.select("name", F.col("full_name").alias("target"), F.struct("kind", F.col("short_name").alias("name"), F.col("full_name").alias("fullName"), "revision").alias("chosen"))
    chosen = chosen.groupBy("name", "target").agg(F.count("*").alias("n"), F.first("chosen").alias("chosen")).where("n = 1").drop("n")
    rows = requests.join(chosen, ["name", "target"], "left")
    for label, found in read.items():
        rows = rows.join(verdict(outputs[label], found, f"{label}_read"), "name", "left")
    bases = R.scan_merge_bases(outputs["bases"]).groupBy("name").agg(F.count("*").alias("n_bases"), F.min("revision").alias("merge_base"))
    commits = R.scan_commit_counts(outputs["counts"])
    rows = rows.join(bases, "name", "left").join(commits, "name", "left").join(file_counts(R.scan_raw_diff(outputs["diff"]), before), "name", "left")
    rows = rows.join(changed_names(before, after).withColumn("moved", F.lit(True)), "name", "left").fillna(0, [*COUNTS, "n_bases"])
    rows = rows.join(fingerprint.freshness_tokens(rows, after), "name", "left")
    said = lambda label: F.when(F.coalesce(f"{label}_read", F.lit("inspectionFailed")) != "good", F.coalesce(f"{label}_read", F.lit("inspectionFailed")))
    same = F.col("repository.head").eqNullSafe(F.col("ending_head")) & F.col("chosen.revision").eqNullSafe(F.col("ending_target_revision")) & F.col("target_set_token").eqNullSafe(F.col("ending_target_set_token"))
    base = classify.merge_base_state(F.col("n_bases"))
    error = F.coalesce(
        F.when(F.col("chosen").isNull(), "targetInvalid"), said("before"), said("bases"), F.when(base == "unrelated", "unrelatedHistory"), F.when(base == "ambiguous", "ambiguousBase"),
        said("counts"), said("diff"), said("after"), F.when(~same | F.col("moved"), "changedDuringPreparation"),
    )
    ready = lineage.readiness(F.col("conflicted"), F.col("right_count"), F.col("changed"))
    found = rows.select("*", error.alias("error"), ready.alias("readiness"))
    repository = F.struct(F.col("repository.name").alias("name"), F.col("repository.canonical_path").alias("canonicalPath"), F.col("repository.head").alias("head"))
    result = F.struct(
        repository.alias("repository"), F.col("chosen").alias("target"), F.col("merge_base").alias("mergeBaseRevision"), F.col("right_count").alias("currentWorkCommitCount"), F.col("left_count").alias("targetOnlyCommitCount"),
        F.col("changed").alias("changedFileTotal"), F.col("uncommitted").alias("uncommittedFileTotal"), *(F.col(c).alias(f"{c}FileCount") for c in COUNTS[2:5]),
        F.struct(F.col("readiness").alias("state"), F.when(F.col("readiness") == "conflicts", F.col("conflicted")).alias("conflictedFileCount")).alias("readiness"), F.col("freshness_token").alias("freshnessToken"),
    )
    return found.select("name", "error", good(result).alias("result"), "readiness", "freshness_token", *COUNTS)


def list_targets(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """comparisons.listTargets: name, error and result, a page of targets that fits the response's budget.

    ``requests`` has name, request_id, canonical_path, query, after, target_set_token and unsupported, the number of refs
    that discovery left out; ``targets`` has name, kind (local or remoteTracking), kind_ord, short_name, full_name,
    revision and suggested (a flag) of each request's discovered targets. A list goes by kind_ord, then by full_name in
    UTF-16 order. The first error counts: the query, the cursor and token (both or none, and well formed), a token
    that isn't the set's any more, a cursor that names no target of the query, a first target that no page can hold.
    The suggestion is only shown without query and cursor. Pages are made while the plan is made: that starts jobs.
    """
    first = F.col("after").isNull()
    lists = requests.select("name", "request_id", "canonical_path", "query", "after", "target_set_token", "unsupported")
    tokens = fingerprint.target_set_tokens(lists, targets)
    item = F.struct("kind", F.col("short_name").alias("name"), F.col("full_name").alias("fullName"), "revision")
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    page_of = lambda listed, suggestion, cursor, count: F.struct(listed.alias("targets"), suggestion.alias("suggestedTarget"), cursor.alias("nextCursor"), F.col("set_token").alias("targetSetToken"), count.alias("unsupportedTargetCount"))
    empty = page_of(F.array(), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0))
    bytes_of = lambda request_id: F.octet_length(text(F.struct(F.lit(1).alias("protocolVersion"), F.lit("result").alias("type"), request_id.alias("requestId"), empty.alias("result")))) - 2 * paging.NULL_BYTES - 1
    known = lists.join(tokens, "name").withColumn("envelope", bytes_of(F.col("request_id"))).withColumn("probe", bytes_of(F.lit(PROBE_ID)))
    found = targets.join(known, "name").where(F.col("query").isNull() | F.lower("short_name").contains(F.lower("query")))
    found = found.withColumn("order", F.struct("kind_ord", utf16(F.col("full_name")).alias("ref")))
    cursors = found.where(F.col("full_name") == F.col("after")).groupBy("name").agg(F.min("order").alias("cursor_order"))
    found = found.join(cursors, "name", "left").select("name", "order", item.alias("item"), "suggested", "query", "after", "unsupported", "envelope", "probe", "cursor_order")
    size, cursor = F.octet_length(text(F.col("item"))), F.octet_length(text(F.array("item.fullName"))) - 2
    shown = F.col("suggested") & F.col("query").isNull() & first
    past = F.coalesce(F.col("order") <= F.col("cursor_order"), F.lit(False))
    paged = paging.pages(found, "name", ["order"], size, cursor, F.col("envelope"), F.col("probe"), paging.PAGE_BYTES, shown, F.col("unsupported"), past)
    on = F.col("page") == 1
    listed = F.array_sort(F.collect_list(F.when(on, F.struct("order", "item"))))  # at most what a page holds
    rest = F.count_if(F.col("supported") & ~past & F.coalesce(F.col("page") > 1, F.lit(True)))
    suggestion = F.max(F.when(shown & F.col("supported"), F.col("item")))
    pages = paged.groupBy("name").agg(listed.alias("listed"), rest.alias("rest"), F.max("unsupported_count").alias("count"), F.max(F.when(on, F.col("with_suggestion"))).alias("with"), suggestion.alias("suggestion"))
    rows = known.join(cursors, "name", "left").join(pages, "name", "left").withColumn("rest", F.coalesce("rest", F.lit(0)))
    token = F.col("target_set_token")
    well = (F.col("after").isNull() == token.isNull()) & F.coalesce(is_target_ref(F.col("after")), F.lit(True)) & F.coalesce(is_token(token), F.lit(True))
    error = F.coalesce(
        F.when(F.col("query").contains("\0") | (F.length("query") > MAX_QUERY), "invalidTargetQuery"), F.when(~well, "invalidTargetPage"), F.when(token != F.col("set_token"), "targetsChanged"),
        F.when(~first & F.col("cursor_order").isNull(), "invalidTargetPage"), F.when((F.coalesce(F.size("listed"), F.lit(0)) == 0) & (F.col("rest") > 0), "tooLarge"),
    )
    items = F.transform(F.coalesce("listed", F.array().cast(pages.schema["listed"].dataType)), lambda r: r["item"])
    cursor = F.when(F.col("rest") > 0, F.try_element_at(items, F.lit(-1))["fullName"])
    result = page_of(items, F.when(F.col("with"), F.col("suggestion")), cursor, F.coalesce("count", "unsupported"))
    return rows.select("name", error.alias("error"), F.when(error.isNull(), text(result)).alias("result"))


def good(result: Column) -> Column:
    """A result as JSON where there is no error."""
    return F.when(F.col("error").isNull(), F.to_json(result))


def check_freshness(requests: DataFrame, prepared: DataFrame) -> DataFrame:
    """comparisons.checkFreshness: requests (name, freshness_token) against what ``prepare`` gives now.

    A token that isn't 64 lower-case hex digits is an error. A comparison that can't be prepared any more is stale, but
    for one whose facts couldn't be read: that error is passed on.
    """
    now = prepared.select("name", F.col("error").alias("now_error"), F.when(F.col("error").isNull(), F.col("freshness_token")).alias("now_token"))
    unread = F.when(F.col("now_error").isin("tooLarge", "inspectionFailed"), F.col("now_error"))
    shape = F.when(~F.coalesce(F.col("freshness_token").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), "invalidFreshnessToken")
    rows = requests.join(now, "name", "left").select("name", F.coalesce(shape, unread).alias("error"), classify.freshness(F.col("now_token"), F.col("freshness_token")).alias("freshness"))
    return rows.select("name", "error", good(F.struct(F.col("freshness").alias("state"))).alias("result"), "freshness")


def start(requests: DataFrame, checked: DataFrame, runs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """analysis.start: accepted, rejectedStale, or rejectedActive with the run that holds the repository.

    ``requests`` has name, canonical_path_key, run_id (a new one) and requested_at; ``checked`` is what ``check_freshness``
    gives. Of several fresh requests for one repository the first by ``order`` (requested_at where none is given), ties by
    run_id, is accepted; it then holds it.
    """
    rows = requests.join(checked.select("name", "error", "freshness"), "name", "left")
    rows = classify.active_run_of(rows.withColumnRenamed("run_id", "new_run"), runs.select("canonical_repository_path_key", "state", "run_id"))
    free = rows.where((F.col("freshness") == "current") & F.col("error").isNull() & F.col("run_id").isNull())
    first = one_active(free, "canonical_path_key", [*(order or ["requested_at"]), "new_run"], "new_run").select("name", "active_run")
    rows = rows.join(first, "name", "left").withColumn("holder", F.coalesce("run_id", "active_run"))
    outcome = F.when(F.coalesce(F.col("freshness") != "current", F.lit(True)), "rejectedStale").when(F.col("holder") == F.col("new_run"), "accepted").otherwise("rejectedActive")
    rows = rows.withColumn("state", F.when(F.col("error").isNull(), outcome))
    accepted = F.col("state") == "accepted"
    result = F.struct("state", F.when(accepted, F.col("new_run")).alias("runId"), F.when(accepted, F.col("requested_at")).alias("requestedAt"), F.when(F.col("state") == "rejectedActive", F.col("holder")).alias("activeRunId"))
    return rows.select("name", "error", good(result).alias("result"), "state")


def run_summary(run: str, cancelled: Column) -> Column:
    """A run's summary as JSON, from a struct column with the columns of the run table: its identities, times, facts and end."""
    of = lambda c: F.col(f"{run}.{c}")
    state = classify.state_literal(of("state"))
    detail = classify.nonzero_clauses({k: of(f"excluded_{k}_count") for k in ("staged", "unstaged", "untracked", "conflicted")})
    fact = lambda kind, n, d: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("count"), d.alias("detail"))
    captured = of("captured_at_unix_ms").isNotNull() & of("captured_changed_file_count").isNotNull()
    facts = F.array(
        F.when(captured, fact("changedFilesCaptured", of("captured_changed_file_count"), F.lit(None).cast("string"))),
        F.when(captured & (of("excluded_uncommitted_total") > 0), fact("excludedUncommittedFiles", of("excluded_uncommitted_total"), detail)),
    )
    end = F.struct(
        state.alias("kind"), of("terminal_at_unix_ms").alias("terminalAt"), F.when(state == "completedWithLimitations", of("limitation_count")).alias("limitationCount"),
        F.when(state == "failed", of("failure_code")).alias("failureCode"),
    )
    told = F.struct(
        of("run_id").alias("runId"), state.alias("state"),
        F.struct(of("repository_id").alias("repositoryId"), of("repository_display_name").alias("displayName"), of("canonical_repository_path").alias("canonicalPath"), of("head_revision").alias("head")).alias("repository"),
        F.struct(of("target").alias("target"), of("target_revision").alias("targetRevision"), of("freshness_token").alias("freshnessToken")).alias("comparison"),
        of("requested_at_unix_ms").alias("requestedAt"), of("capture_started_at_unix_ms").alias("captureStartedAt"), of("captured_at_unix_ms").alias("capturedAt"), of("snapshot_id").alias("snapshotId"),
        cancelled.alias("cancellationRequested"), F.array_compact(facts).alias("facts"),
        F.when(state.isin("completed", "completedWithLimitations", "failed", "cancelled"), F.parse_json(F.to_json(end))).alias("terminal"),
        of("interrupted_at_unix_ms").alias("interruptedAt"), of("interruption_reason").alias("interruptionReason"),
    )
    return F.to_json(told, {"ignoreNullFields": "false"})


def poll_run(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """analysis.pollRun: the summary of the run that each request (name, run_id) names, or unknownRun.

    ``runs`` has each run once, with the columns of the run table, and may have visible_from and cancelled_from, compared
    with the requests' turn: a run that a later request made isn't there yet, and a later cancellation isn't known.
    """
    seen, cancelled = visibility(requests, runs)
    met = requests.withColumn("run_id", F.lower("run_id")).join(runs.select("run_id", F.struct(*runs.columns).alias("run")), "run_id", "left").withColumn("seen", F.col("run").isNotNull() & seen)
    return met.select("name", F.when(~F.col("seen"), "unknownRun").alias("error"), F.when(F.col("seen"), run_summary("run", cancelled)).alias("result"))


def get_active(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """analysis.getActive: the active run of each request's repository (name, canonical_path_key), or kind none; as ``poll_run`` else.

    A path without a key is repositoryUnavailable. A repository has one active run at most.
    """
    seen, cancelled = visibility(requests, runs)
    active = runs.where(classify.is_active(F.col("state"))).select(F.col("canonical_repository_path_key").alias("canonical_path_key"), F.struct(*runs.columns).alias("run"))
    met = requests.join(active, "canonical_path_key", "left").withColumn("seen", F.col("run").isNotNull() & seen)
    found = F.to_json(F.struct(F.lit("active").alias("kind"), F.parse_json(run_summary("run", cancelled)).alias("run")))
    result = F.when(F.col("seen"), found).otherwise(F.to_json(F.struct(F.lit("none").alias("kind"))))
    known = F.col("canonical_path_key").isNotNull()
    return met.select("name", F.when(~known, "repositoryUnavailable").alias("error"), F.when(known, result).alias("result"))


def cancel(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """analysis.cancel: an empty result for each request (name, run_id) whose run is there, active or not, else unknownRun; ``request_cancel`` makes the change."""
    seen, _ = visibility(requests, runs)
    met = requests.withColumn("run_id", F.lower("run_id")).join(runs.select("run_id", F.struct(*runs.columns).alias("run")), "run_id", "left")
    return met.select("name", F.when(~(F.col("run").isNotNull() & seen), "unknownRun").alias("error"), F.lit(None).cast("string").alias("result"))


def visibility(requests: DataFrame, runs: DataFrame) -> tuple[Column, Column]:
    """Whether a request's turn is behind a run's making, and whether it is behind its first cancellation."""
    given = F.col("run.cancellation_requested_at_unix_ms").isNotNull()
    if "turn" not in requests.columns or "visible_from" not in runs.columns:
        return F.lit(True), given
    behind = lambda c: F.col(f"run.{c}") < F.col("turn")
    return F.coalesce(behind("visible_from"), F.lit(True)), given | F.coalesce(behind("cancelled_from"), F.lit(False))

"""Tokens over target sets, working trees and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.canonical import boolean, digest, field, fingerprint, nullable, ordered_records, record, utf16
from millrace.operators.classify import multiset_equal


def target_set_token(targets: DataFrame, path: str, query: str | None, unsupported: int) -> DataFrame:
    """One row: the token of a target set."""
    header = record(
        field("comparison.target-set.v1"), field("repository.canonical-path"), field(path), nullable("query", F.lit(query).cast("string")),
        field("unsupported-target-count"), field(str(unsupported)), field("target-count"),
    )
    kind = F.when(F.col("kind_ord") == 0, "local").otherwise("remote-tracking")
    body = record(field("target"), field(kind), field(F.col("name")), field(F.col("full_name")), field(F.col("revision")))
    order = [utf16(F.col("full_name")), F.col("kind_ord"), utf16(F.col("name")), utf16(F.col("revision"))]
    return fingerprint(targets, header, order, body)


def target_set_tokens(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """name and set_token of each list of targets (A7a), also of an empty one.

    ``lists`` has name, canonical_path, query and unsupported (a count); ``targets`` has name, kind_ord, short_name,
    full_name and revision. A list is of bounded size, as what it is read from is.
    """
    kind = F.when(F.col("kind_ord") == 0, "local").otherwise("remote-tracking")
    body = record(field("target"), field(kind), field(F.col("short_name")), field(F.col("full_name")), field(F.col("revision")))
    order = [utf16(F.col("full_name")), F.col("kind_ord"), utf16(F.col("short_name")), utf16(F.col("revision"))]
    each = targets.groupBy("name").agg(ordered_records(order, body).alias("records"), F.count("*").alias("n"))
    header = record(
        field("comparison.target-set.v1"), field("repository.canonical-path"), field(F.col("canonical_path")), nullable("query", F.col("query")),
        field("unsupported-target-count"), field(F.col("unsupported").cast("string")), field("target-count"), field(F.coalesce("n", F.lit(0)).cast("string")),
    )
    joined = lists.select("name", "canonical_path", "query", "unsupported").join(each, "name", "left")
    return joined.select("name", digest(F.concat(header, F.coalesce("records", F.lit("")))).alias("set_token"))


def head_fields(kind: str, name: str | None, revision: str) -> Column:
    """A head's fields: branch with its name, or detached."""
    return record(field("head.branch"), field(name), field(revision)) if kind == "branch" else record(field("head.detached"), field(revision))


FLAGS = ("staged", "unstaged", "untracked", "conflicted", "ignored")


def working_record() -> Column:
    """A working-tree entry's fields."""
    return record(field("working-tree-record"), field(F.col("path")), nullable("original-path", F.col("original_path")), *(boolean(f, F.col(f"is_{f}")) for f in FLAGS))


def working_order() -> list[Column]:
    """What working-tree entries are ordered by."""
    return [utf16(F.col("path")), utf16(F.col("original_path")), *(F.col(f"is_{f}") for f in FLAGS)]


def freshness_tokens(comparisons: DataFrame, working: DataFrame) -> DataFrame:
    """name and freshness_token of each comparison (A7b), also of those with a clean working tree; null for one whose target isn't known.

    ``comparisons`` has name, repository (canonical_path, head), target, chosen (revision) and target_set_token.
    """
    head = F.col("repository.head")
    own = F.when(head["kind"] == "branch", record(field("head.branch"), field(head["name"]), field(head["revision"]))).otherwise(record(field("head.detached"), field(head["revision"])))
    header = record(
        field("comparison.freshness.v1"), field("repository.canonical-path"), field(F.col("repository.canonical_path")), own, field("target"), field(F.col("target")), field(F.col("chosen.revision")),
        field("target-set-token"), field(F.col("target_set_token")), field("working-tree-record-count"),
    )
    body = ordered_records(working_order(), working_record())
    entries = working.groupBy("name").agg(body.alias("records"), F.count("*").alias("n"))
    joined = comparisons.select("name", F.when(F.col("chosen.revision").isNotNull(), header).alias("header")).join(entries, "name", "left")
    count = F.coalesce("n", F.lit(0)).cast("string")
    return joined.select("name", digest(F.concat("header", field(count), F.coalesce("records", F.lit("")))).alias("freshness_token"))


def freshness_token(working: DataFrame, path: str, head: Column, target: str, revision: str, set_token: str) -> DataFrame:
    """One row: the token of a comparison; it covers the working tree's flags, not its contents."""
    header = record(
        field("comparison.freshness.v1"), field("repository.canonical-path"), field(path), head, field("target"), field(target), field(revision),
        field("target-set-token"), field(set_token), field("working-tree-record-count"),
    )
    return fingerprint(working, header, working_order(), working_record())


def manifest_hash(entries: DataFrame, marker: str, path_key: str, target: str, target_revision: str, head_revision: str, merge_base: str) -> DataFrame:
    """One row: the hash of a snapshot's entries."""
    header = record(
        field(marker), field("repository.canonical-path-key"), field(path_key), field("target"), field(target), field(target_revision),
        field("head-revision"), field(head_revision), field("merge-base-revision"), field(merge_base), field("entry-count"),
    )
    rest = ("category", "merge_base_entry_mode", "head_entry_mode", "merge_base_object_id", "head_object_id")
    body = record(field("entry"), field(F.col("path")), nullable("original-path", F.col("original_path")), *(field(F.col(c)) for c in rest))
    return fingerprint(entries, header, [utf16(F.col("path")), utf16(F.col("original_path"))], body)


def changed_between(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether two readings of the same facts differ."""
    return multiset_equal(before.select(*keys), after.select(*keys)).select((~F.col("equal")).alias("changed"))


def identity_violations(manifests: DataFrame, runs: DataFrame, columns: list[str]) -> DataFrame:
    """Manifests whose identity columns differ from their run's, and which."""
    m, r = manifests.alias("m"), runs.alias("r")
    wrong = F.filter(F.array(*(F.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    return m.join(r, "run_id").select("run_id", wrong.alias("columns")).where(F.size("columns") > 0)

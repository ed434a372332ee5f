"""Classification, projections and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.validators import MAX_REF_SCALARS

#: Fixed values.
ACTIVE = ("pendingCapture", "capturing", "discovering", "collecting", "persisting")
TERMINAL = ("completed", "completedWithLimitations", "cancelled", "failed")
STATES = (*ACTIVE, *TERMINAL, "interrupted")
CATEGORIES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "T": "typeChanged"}
STAGES = ("pendingCapture", "capturing", "discovering", "collecting", "persisting")
#: What a diagnostic says, in the order it is looked for, and the class it gives.
DIAGNOSTICS = (
    ("notGitRepository", ("not a git repository",)),
    ("accessDenied", ("detected dubious ownership in repository", "unsafe repository", "permission denied")),
    ("headUnavailable", ("does not have any commits yet", "needed a single revision", "unknown revision or path not in the working tree", "bad revision 'head^{commit}'", "ambiguous argument 'head^{commit}'")),
)
REMOTE_DIAGNOSTICS = (
    ("remoteAuthenticationRequired", ("could not read username", "could not read password", "authentication failed", "invalid username or password", "permission denied (publickey", "terminal prompts disabled")),
)


def first_match(cases: list[tuple[Column, str]], default: str | None) -> Column:
    """The label of the first condition that holds."""
    out = F
    for condition, label in cases:
        out = out.when(condition, label)
    return out.otherwise(default)


def classify_targets(records: DataFrame, current: Column) -> DataFrame:
    """Records with class (unsupported, default, current, local, remote), remote (of a default), kind order and short name."""
    name, symbolic, commit = F.col("full_name"), F.col("symbolic_target"), F.col("object_type") == "commit"
    remote = F.regexp_extract("full_name", r"\Arefs/remotes/([^/]+)/HEAD\z", 1)
    cls = first_match(
        [
            (F.length(name) > MAX_REF_SCALARS, "unsupported"),
            (commit & symbolic.isNotNull() & (remote != ""), "default"),
            (~commit | symbolic.isNotNull(), "unsupported"),
            (name == current, "current"),
            (name.startswith("refs/heads/"), "local"),
            (name.rlike(r"\Arefs/remotes/[^/]*/"), "remote"),
        ],
        "unsupported",
    )
    short = F.regexp_replace("full_name", r"\Arefs/(heads|remotes)/", "")
    kept = records.select("full_name", "revision", "object_type", "symbolic_target", "upstream_remote", cls.alias("class"))
    return kept.select("*", F.when(F.col("class") == "default", remote).alias("remote"), F.when(F.col("class") == "local", 0).when(F.col("class") == "remote", 1).alias("kind_ord"), short.alias("name"))


def targets(classified: DataFrame) -> DataFrame:
    """The local and remote targets; order by kind_ord and utf16(full_name)."""
    kind = F.when(F.col("kind_ord") == 0, "local").otherwise("remoteTracking")
    return classified.where("kind_ord is not null").select(kind.alias("kind"), "kind_ord", "name", "full_name", "revision")


def suggest_target(classified: DataFrame) -> DataFrame:
    """The target that the current branch's remote has as its default, else that of origin; at most one row."""
    defaults = classified.where("class = 'default'").where(F.col("symbolic_target").startswith(F.concat(F.lit("refs/remotes/"), F.col("remote"), F.lit("/"))))
    wanted = classified.where("class = 'current' and upstream_remote is not null").select(F.col("upstream_remote").alias("remote"), F.lit(0).alias("rank"))
    wanted = wanted.unionByName(classified.sparkSession.createDataFrame([("origin", 1)], "remote string, rank int"))
    found = wanted.join(defaults.select("remote", F.col("symbolic_target").alias("full_name")), "remote").join(targets(classified), "full_name")
    return found.orderBy("rank").limit(1).drop("rank", "remote")


def search(name: Column, query: str | None) -> Column:
    """Names that hold the query in any case; no or an empty query finds all."""
    return F.lower(name).contains((query or "").lower())


def change_category(status: Column) -> Column:
    """The category of a change letter; an unknown one is an error (P5)."""
    out = F
    for letter, label in CATEGORIES.items():
        out = out.when(status == letter, label)
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported change "), F.coalesce(status, F.lit("null")))))


def state_literal(state: Column) -> Column:
    """A run state as it is stored; an unknown one is an error."""
    return F.when(state.isin(*STATES), state).otherwise(F.raise_error(F.concat(F.lit("unsupported state "), F.coalesce(state, F.lit("null")))))


def is_active(state: Column) -> Column:
    """Whether a run is active."""
    return state.isin(*ACTIVE)


def nonzero_clauses(counts: dict[str, Column]) -> Column:
    """``n label`` of each count that isn't zero, comma-joined."""
    return F.concat_ws(", ", *(F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {label}"))) for label, c in counts.items()))


def run_facts(runs: DataFrame) -> DataFrame:
    """Up to two facts of each captured run: its changed files, and its excluded uncommitted work where there is any."""
    detail = nonzero_clauses({k: F.col(f"excluded_{k}_count") for k in ("staged", "unstaged", "untracked", "conflicted")})
    fact = lambda kind, n, d: F.struct(F.lit(kind).alias("kind"), n.alias("count"), d.alias("detail"))
    both = F.array(fact("changedFilesCaptured", F.col("captured_changed_file_count"), F.lit(None).cast("string")), fact("excludedUncommittedFiles", F.col("excluded_uncommitted_total"), detail))
    kept = F.filter(both, lambda f: (f["kind"] == "changedFilesCaptured") | (f["count"] > 0))
    captured = F.col("captured_at_unix_ms").isNotNull() & F.col("captured_changed_file_count").isNotNull()
    return runs.select("run_id", F.when(captured, kept).otherwise(F.array().cast("array<struct<kind:string,count:int,detail:string>>")).alias("facts"))


def freshness(token: Column, given: Column) -> Column:
    """current where the tokens are equal, stale otherwise, also without a token."""
    return F.when(token == given, "current").otherwise("stale")


def baseline(remote_count: Column, remote_revision: Column, local_revision: Column) -> Column:
    """noRemote, current or moved."""
    return F.when(remote_count == 0, "noRemote").when(remote_revision == local_revision, "current").otherwise("moved")


def classify_diagnostic(text: Column, remote: bool = False) -> Column:
    """The class of a tool's diagnostic."""
    low = F.lower(text)
    out = F
    for label, phrases in REMOTE_DIAGNOSTICS if remote else DIAGNOSTICS:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        out = out.when(hit, label)
    return out.otherwise("remoteUnreachable" if remote else "inspectionFailed")


def merge_base_state(bases: Column) -> Column:
    """unrelated without a merge base, ambiguous with several, single with one."""
    return F.when(bases == 0, "unrelated").when(bases == 1, "single").otherwise("ambiguous")


def epoch_ms(c: Column) -> Column:
    """A point in time as milliseconds since 1970."""
    return F.unix_millis(c)


def stage_progress(stage: Column, current: Column) -> Column:
    """complete, active or pending of a stage against the current one."""
    order = F.array(*map(F.lit, STAGES))
    a, b = F.array_position(order, stage), F.array_position(order, current)
    return F.when(a < b, "complete").when(a == b, "active").otherwise("pending")


def last_repository(state: DataFrame, repositories: DataFrame) -> DataFrame:
    """The application state with its last repository, if any."""
    return state.join(repositories, state["last_repository_id"] == repositories["repository_id"], "left")


def members(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the other table."""
    return rows.join(allowed.select(key), key, "left_semi")


def excluded(rows: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the other table."""
    return rows.join(banned.select(key), key, "left_anti")


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, separator: str = "/", salts: int = 16) -> DataFrame:
    """Each row with the longest prefix that a separator and something more follow; null without one.

    Every beginning of the text that ends before a separator is a key, so this is an equi-join, not a scan of all
    prefixes. Beginnings shorter than the shortest prefix or longer than the longest aren't keys: what all texts begin with
    meets nowhere. The rows of a key are dealt over ``salts`` tasks. Equal rows each keep their row; a row with a null text
    has no prefix, and null prefixes are none. Rows with a column named prefix, or as the
    operator's own (__row, __salt, __hit, __least, __most), raise.
    """
    taken = {"prefix", "__row", "__salt", "__hit", "__least", "__most"} & {c.lower() for c in rows.columns}
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)}")
    parts = F.split(F.col(text), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")), -1)
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    bounds = prefixes.agg(F.min(F.length("prefix")).alias("__least"), F.max(F.length("prefix")).alias("__most"))  # one row
    fits = lambda b: F.length(b).between(F.col("__least"), F.col("__most")) & (F.length(text) > F.length(b) + len(separator))
    numbered = rows.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(bounds))
    cut = numbered.withColumn("prefix", F.explode_outer(F.when(F.size(parts) > 1, F.filter(beginnings, fits)))).select(*rows.columns, "__row", "prefix", F.pmod("__row", F.lit(salts)).alias("__salt"))
    dealt = prefixes.select("prefix").distinct().select("prefix", F.lit(True).alias("__hit"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("__salt"))
    hit = cut.join(dealt, ["prefix", "__salt"], "left")
    best = F.max_by(F.when(F.col("__hit"), F.col("prefix")), F.when(F.col("__hit"), F.length("prefix")))
    return hit.groupBy("__row", *rows.columns).agg(best.alias("prefix")).drop("__row")


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows as often."""
    names = a.columns
    sides = a.select(*names, F.lit(1).alias("__n")).unionByName(b.select(*names, F.lit(-1).alias("__n")))
    return sides.groupBy(*names).agg(F.sum("__n").alias("__n")).agg((F.count_if(F.col("__n") != 0) == 0).alias("equal"))


def active_run_of(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Repository entries with the active run of their path key, if any."""
    active = runs.where(is_active(F.col("state"))).select(F.col("canonical_repository_path_key").alias("canonical_path_key"), "run_id")
    return entries.join(active, "canonical_path_key", "left")

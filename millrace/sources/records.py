"""Strict readers of version-control output (S1-S8) and of request lines.

A reader takes one row for each captured output, columns name and content, and gives one row for each record with the
output's name. Reading is all or nothing: where any record of an output is bad, that output gives no record, and
``failures`` lists it. An output over MAX_OUTPUT_BYTES isn't read: it has one bad record, with the reason tooLarge.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import validators as V

NUL = "\\x00"
#: Bytes of one output, characters of a request line, bytes of a response line.
MAX_OUTPUT_BYTES, MAX_REQUEST, MAX_RESPONSE = 8 * 1024 * 1024, 65_536, 65_536
STATUS_NAMES = {"A": "added", "D": "deleted", "M": "modified", "T": "typeChanged", "R": "renamed"}


def capture(spark: SparkSession, path: str) -> DataFrame:
    """Captured outputs, one file each, with the bytes as they are."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("name"), F.col("content").cast("string").alias("content"))


def all_or_nothing(records: DataFrame, columns: list[str]) -> DataFrame:
    """The records of outputs without a bad one; ``records`` has name, ok and the columns."""
    good = records.groupBy("name").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("good")).where("good").select("name")
    return records.join(good, "name", "left_semi").select("name", *columns)


def failures(records: DataFrame) -> DataFrame:
    """Outputs with bad records, how many, and the reason where it is one of the whole output (tooLarge)."""
    return records.where(~F.coalesce("ok", F.lit(False))).groupBy("name").agg(F.count("*").alias("bad_count"), F.max("reason").alias("reason"))


def bounded(outputs: DataFrame) -> DataFrame:
    """name, content and reason; content is null and the reason tooLarge where an output is over the limit, notUtf8 where its bytes aren't UTF-8."""
    reason = F.when(F.octet_length("content") > MAX_OUTPUT_BYTES, "tooLarge").when(~F.is_valid_utf8("content"), "notUtf8")
    return outputs.select("name", F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reason"))


def lines(outputs: DataFrame, due: bool = False) -> DataFrame:
    """name, reason, no, line of LF-ended lines; an output whose last line isn't ended, or that can't be read, has a null line.

    An empty output has no line, but a null one where a line is ``due``.
    """
    parts, none = F.split("content", "\n", -1), F.array(F.lit(None).cast("string"))
    empty = none if due else F.array().cast("array<string>")
    ended = F.when(F.col("content").endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).when(F.length("content") == 0, empty).otherwise(none)
    return bounded(outputs).select("name", "reason", F.posexplode(ended).alias("no", "line"))


def ref_records(outputs: DataFrame) -> DataFrame:
    """S1 with its ok column: references, five NUL-ended fields a line; a repeated name is bad."""
    f = F.split("line", NUL, -1)
    at = lambda i: F.try_element_at(f, F.lit(i))
    empty = lambda c: F.when(F.length(c) > 0, c)
    shape = (F.size(f) == 6) & (at(6) == "") & ~F.col("line").contains("\r")
    rows = lines(outputs).select("name", "reason", at(1).alias("full_name"), at(2).alias("revision"), at(3).alias("object_type"), empty(at(4)).alias("symbolic_target"), empty(at(5)).alias("upstream_remote"), shape.alias("shape"))
    valid = V.is_full_ref(F.col("full_name")) & V.is_object_id(F.col("revision")) & F.col("object_type").isin(*V.OBJECT_TYPES)
    links = (F.col("symbolic_target").isNull() | V.is_full_ref(F.col("symbolic_target"))) & (F.col("upstream_remote").isNull() | V.no_control(F.col("upstream_remote")))
    once = F.count("*").over(Window.partitionBy("name", "full_name")) == 1
    return rows.withColumn("ok", F.col("shape") & valid & links & once)


def scan_refs(outputs: DataFrame) -> DataFrame:
    """References."""
    return all_or_nothing(ref_records(outputs), ["full_name", "revision", "object_type", "symbolic_target", "upstream_remote"])


def fields(outputs: DataFrame, takes) -> DataFrame:
    """name, no, head, path1, path2, ended, reason of NUL-ended fields; ``takes`` says how many further fields a head takes.

    The only Python here: how many fields belong together depends on each head. A record cut short isn't ended, nor is
    the one record of an output without content or over the limit.
    """
    schema = pa.schema([("name", pa.string()), ("no", pa.int64()), ("head", pa.string()), ("path1", pa.string()), ("path2", pa.string()), ("ended", pa.bool_()), ("reason", pa.string())])

    def run(batches):
        for b in batches:
            for name, content, reason in zip(*(b.column(c).to_pylist() for c in ("name", "content", "reason")), strict=True):
                parts = (content or "").split("\0")
                rows, at = [], 0
                whole = parts.pop() == "" and content is not None
                while at < len(parts):
                    n = takes(parts[at])
                    more = parts[at + 1 : at + 1 + n]
                    rows.append((name, len(rows), parts[at], *(more + [None, None])[:2], len(more) == n and "" not in more, None))
                    at += 1 + n
                if not whole:
                    rows.append((name, len(rows), None, None, None, False, reason))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 7, schema, strict=True)], schema=schema)

    return bounded(outputs).mapInArrow(run, "name string, no long, head string, path1 string, path2 string, ended boolean, reason string")


def raw_diff_records(outputs: DataFrame) -> DataFrame:
    """S2 with its ok column: committed changes; a rename has the old path before the new one."""
    rows = fields(outputs, lambda head: 2 if " R" in head[-5:] else 1)
    f = F.split("head", " ", -1)
    at = lambda i: F.try_element_at(f, F.lit(i))
    named = rows.select("name", "no", "ended", "reason", "path1", "path2", (F.size(f) == 5).alias("shape"), F.substring(at(1), 2, 6).alias("source_mode"), (F.length(at(1)) == 7).alias("prefixed"), at(1).startswith(":").alias("marked"), at(2).alias("target_mode"), at(3).alias("source_oid"), at(4).alias("target_oid"), at(5).alias("letters"))
    rename = F.col("letters").startswith("R")
    letter = F.substring("letters", 1, 1)
    modes = V.is_mode(F.col("source_mode")) & V.is_mode(F.col("target_mode")) & V.same_width(F.col("source_oid"), F.col("target_oid"))
    score = F.when(rename, V.rename_score_ok(F.col("letters"), True)).otherwise(F.length("letters") == 1)
    change = V.transition_ok(letter, F.col("source_mode"), F.col("target_mode"), F.col("source_oid"), F.col("target_oid"))
    status = F.create_map(*(F.lit(x) for kv in STATUS_NAMES.items() for x in kv))
    return named.select(
        "name", "no", F.when(rename, F.col("path2")).otherwise(F.col("path1")).alias("path"), F.when(rename, F.col("path1")).alias("original_path"),
        "source_mode", "target_mode", "source_oid", "target_oid", F.try_element_at(status, letter).alias("status"),
        (F.col("ended") & F.col("shape") & F.col("marked") & F.col("prefixed") & modes & score & change).alias("ok"), "reason",
    )


def scan_raw_diff(outputs: DataFrame) -> DataFrame:
    """Committed changes."""
    return all_or_nothing(raw_diff_records(outputs), ["path", "original_path", "source_mode", "target_mode", "source_oid", "target_oid", "status"])


def status_records(outputs: DataFrame) -> DataFrame:
    """S3 with its ok column: working-tree entries of kinds 1, 2, u, ? and !."""
    rows = fields(outputs, lambda head: 1 if head.startswith("2 ") else 0)
    kind = F.substring("head", 1, 1)
    # the words before the path, which may hold spaces itself
    words = F.when(kind == "1", 8).when(kind == "2", 9).when(kind == "u", 10).otherwise(1)
    f = F.split("head", " ", -1)
    at = lambda i: F.try_element_at(f, F.lit(i))
    path = F.array_join(F.slice(f, words + 1, F.greatest(F.lit(0), F.size(f) - words)), " ")
    x, y, sub = F.substring(at(2), 1, 1), F.substring(at(2), 2, 1), at(3)
    link = sub.startswith("S")
    shape = (F.length(at(1)) == 1) & (F.length(path) > 0) & (F.size(f) > words)
    sub_ok = sub.rlike(r"\A(N\.\.\.|S[.C][.M][.U])\z")
    ordinary = (
        at(2).rlike(r"\A(\.[MTD]|[AMT][.MTD]|D\.)\z") & sub_ok & V.is_mode(at(4)) & V.is_mode(at(5)) & V.is_mode(at(6)) & V.same_width(at(7), at(8))
        & (link == V.is_gitlink(at(5))) & V.index_state_ok(x, at(4), at(5), at(7), at(8)) & V.worktree_mode_ok(y, at(5), at(6))
    )
    renamed = (
        at(2).rlike(r"\AR[.MDT]\z") & sub_ok & V.transition_ok(F.lit("R"), at(4), at(5), at(7), at(8)) & V.is_mode(at(6)) & V.same_width(at(7), at(8))
        & V.rename_score_ok(at(9), False) & (link == V.is_gitlink(at(5))) & V.worktree_mode_ok(y, at(5), at(6))
    )
    exists = lambda m: ~V.is_absent_mode(m)
    stages = [(at(4), at(8)), (at(5), at(9)), (at(6), at(10))]
    fits = F.lit(True)
    for m, o in stages:
        fits = fits & V.is_mode(m) & (exists(m) != V.is_zero_oid(o))
    any_link = V.is_gitlink(at(4)) | V.is_gitlink(at(5)) | V.is_gitlink(at(6)) | V.is_gitlink(at(7))
    unmerged = sub_ok & fits & V.is_mode(at(7)) & V.same_width(at(8), at(9), at(10)) & (link == any_link) & V.unmerged_ok(at(2), *(exists(m) for m, _ in stages))
    plain = F.col("head").rlike(r"(?s)\A[?!] .")
    ok = F.when(kind == "1", shape & ordinary).when(kind == "2", shape & renamed).when(kind == "u", shape & unmerged).when(kind.isin("?", "!"), plain).otherwise(False)
    is_ = lambda *kinds: F.coalesce(kind.isin(*kinds), F.lit(False))
    return rows.select(
        "name", "no", F.when(kind.isin("?", "!"), F.expr("substring(head, 3)")).otherwise(path).alias("path"), F.when(kind == "2", F.col("path1")).alias("original_path"),
        (is_("u") | is_("2") | (is_("1") & (x != "."))).alias("is_staged"), (is_("u") | (is_("1", "2") & (y != "."))).alias("is_unstaged"),
        is_("?").alias("is_untracked"), is_("u").alias("is_conflicted"), is_("!").alias("is_ignored"), (F.col("ended") & ok).alias("ok"), "reason",
    )


def scan_status(outputs: DataFrame) -> DataFrame:
    """S3: working-tree entries."""
    return all_or_nothing(status_records(outputs), ["path", "original_path", "is_staged", "is_unstaged", "is_untracked", "is_conflicted", "is_ignored"])


def merge_base_records(outputs: DataFrame) -> DataFrame:
    """S4 with its ok column: one object id a line, possibly none."""
    return lines(outputs).select("name", "reason", F.col("line").alias("revision"), V.is_object_id(F.col("line")).alias("ok"))


def scan_merge_bases(outputs: DataFrame) -> DataFrame:
    """Merge bases."""
    return all_or_nothing(merge_base_records(outputs), ["revision"])


def only_line(outputs: DataFrame) -> DataFrame:
    """name, reason, line, and whether it is the output's one line; an output without a line has a null one."""
    one = F.count("*").over(Window.partitionBy("name")) == 1
    return lines(outputs, due=True).select("name", "reason", "line", (one & F.col("line").isNotNull()).alias("one"))


def commit_count_records(outputs: DataFrame) -> DataFrame:
    """S5 with its ok column: one line of two canonical counts, a tab between."""
    f = F.split("line", "\t", -1)
    count = lambda i: F.when(F.try_element_at(f, F.lit(i)).rlike(r"\A(0|[1-9][0-9]*)\z"), F.try_element_at(f, F.lit(i)).try_cast("int"))
    rows = only_line(outputs).select("name", "reason", count(1).alias("left_count"), count(2).alias("right_count"), (F.size(f) == 2).alias("two"), "one")
    return rows.withColumn("ok", F.col("two") & F.col("one") & F.col("left_count").isNotNull() & F.col("right_count").isNotNull())


def scan_commit_counts(outputs: DataFrame) -> DataFrame:
    """Commits on either side."""
    return all_or_nothing(commit_count_records(outputs), ["left_count", "right_count"])


def scalar_fact_records(outputs: DataFrame) -> DataFrame:
    """S6 with its ok column: the one line of each output, as text, and read as a boolean, path, revision and version; null where it is none."""
    v = F.col("line")
    return only_line(outputs).select(
        "name", "reason", v.alias("value"), F.when(v == "true", True).when(v == "false", False).alias("flag"), F.when(v.startswith("/"), v).alias("absolute_path"), F.when(V.is_object_id(v), v).alias("revision"),
        F.when(v.rlike(r"\Agit version \S"), F.regexp_extract(v, r"\Agit version (\S.*)\z", 1)).alias("version"), (F.col("one") & ~v.contains("\r")).alias("ok"),
    )


def scan_scalar_facts(outputs: DataFrame) -> DataFrame:
    """Facts of one line."""
    return all_or_nothing(scalar_fact_records(outputs), ["value", "flag", "absolute_path", "revision", "version"])


def remote_records(outputs: DataFrame) -> DataFrame:
    """S7 with its ok column: one remote name a line."""
    return lines(outputs).select("name", "reason", F.col("line").alias("remote"), (V.non_blank(F.col("line")) & V.no_control(F.col("line"))).alias("ok"))


def scan_remotes(outputs: DataFrame) -> DataFrame:
    """Remotes."""
    return all_or_nothing(remote_records(outputs), ["remote"])


def ls_remote_records(outputs: DataFrame, expected: Column) -> DataFrame:
    """S7 with its ok column: exactly one line, an object id, a tab and the expected reference."""
    f = F.split("line", "\t", -1)
    fits = (F.size(f) == 2) & V.is_object_id(f[0]) & (F.try_element_at(f, F.lit(2)) == expected)
    return only_line(outputs).select("name", "reason", f[0].alias("revision"), (F.col("one") & fits).alias("ok"))


def scan_ls_remote(outputs: DataFrame, expected: Column) -> DataFrame:
    """The revision of a remote's reference."""
    return all_or_nothing(ls_remote_records(outputs, expected), ["revision"])


def describe_repository(facts: DataFrame) -> DataFrame:
    """One descriptor row a repository from its facts (repository, fact, value, exit_code); null where it can't be opened.

    Facts: version, inside, bare, top, head, branch.
    """
    of = lambda k, c="value": F.max(F.when(F.col("fact") == k, F.col(c)))
    wide = facts.groupBy("repository").agg(*(of(k).alias(k) for k in ("version", "inside", "bare", "top", "head", "branch")), of("branch", "exit_code").alias("branch_exit"))
    usable = F.col("version").isNotNull() & (F.col("inside") == "true") & (F.col("bare") == "false") & F.col("top").startswith("/") & V.is_object_id(F.col("head"))
    name = F.element_at(F.split("top", "/"), -1)
    return wide.select("repository", F.when(usable, F.struct(F.col("top").alias("canonical_path"), name.alias("name"), V.head_variant(F.col("branch_exit"), F.col("branch"), F.col("head")).alias("head"))).alias("descriptor"))


def request_lines(frame: DataFrame) -> DataFrame:
    """Request lines (value), blank ones too, with too_large; a too long line is an error of its own, not of the stream.

    Length counts UTF-16 units, as the limit does.
    """
    return frame.withColumn("too_large", F.octet_length(F.encode("value", "UTF-16BE")) > 2 * MAX_REQUEST)


def response_lines(frame: DataFrame) -> DataFrame:
    """Response lines; one over the byte limit is fatal."""
    return frame.withColumn("value", F.when(F.octet_length("value") > MAX_RESPONSE, F.raise_error(F.lit("responseTooLarge"))).otherwise(F.col("value")))


def write_ndjson(responses: DataFrame, path: str) -> None:
    """K1: one response a line."""
    responses.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)

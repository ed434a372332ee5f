"""Strict JSON requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.validators import non_blank

#: Fixed values.
VERSION = 1
ENVELOPE = ("protocolVersion", "requestId", "action", "parameters")
#: The text members of each action's parameters; those with a question mark may be null or left out.
ACTIONS = {
    "engine.checkStatus": "", "repositories.open": "path", "repositories.restoreLast": "", "repositories.listRecent": "",
    "repositories.removeRecent": "repositoryId", "comparisons.listTargets": "path query? after? targetSetToken?",
    "comparisons.prepare": "path target", "comparisons.checkFreshness": "path target freshnessToken",
    "comparisons.checkRemoteBaseline": "path target", "comparisons.refreshRemoteBaseline": "path target",
    "preferences.getColorTheme": "", "preferences.setColorTheme": "colorTheme",
    "analysis.start": "path target freshnessToken changeContext?", "analysis.getActive": "path",
    "analysis.pollRun": "runId", "analysis.cancel": "runId",
}
#: The response's type, code and message for each reason that a request is refused for.
ERRORS = {
    "requestTooLarge": ("malformedInput", "protocol.requestTooLarge", "The request is too large."),
    "invalidJson": ("malformedInput", "protocol.invalidJson", "The request is not valid JSON."),
    "malformedRequest": ("validation", "protocol.invalidRequest", "The request does not have the members that it must have."),
    "blankField": ("validation", "protocol.invalidRequest", "The request's id and action must not be blank."),
    "unsupportedVersion": ("unprocessableInput", "protocol.unsupportedVersion", "The protocol version is not supported."),
    "unknownAction": ("notFound", "protocol.unknownAction", "The action is not known."),
    "invalidParameters": ("validation", "protocol.invalidRequest", "The parameters do not fit the action."),
    "tooLarge": ("unprocessableInput", "comparison.tooLarge", "The comparison exceeds the supported local inspection limit."),
    "inspectionFailed": ("externalDependencyFailure", "comparison.inspectionFailed", "Git comparison inspection failed."),
    "targetInvalid": ("unprocessableInput", "comparison.targetInvalid", "The selected comparison target is not supported."),
    "unrelatedHistory": ("unprocessableInput", "comparison.unrelatedHistory", "The selected target does not share history with the current revision."),
    "ambiguousBase": ("unprocessableInput", "comparison.ambiguousBase", "The current revision and selected target have multiple best merge bases."),
    "changedDuringPreparation": ("conflict", "comparison.changedDuringPreparation", "Repository facts changed while the comparison was being prepared."),
    "invalidTargetQuery": ("validation", "comparison.invalidTargetQuery", "The target query is invalid."),
    "invalidTargetPage": ("validation", "comparison.invalidTargetPage", "The target page request is invalid."),
    "targetsChanged": ("conflict", "comparison.targetsChanged", "Comparison targets changed. Reload the target list."),
    "invalidFreshnessToken": ("validation", "comparison.invalidFreshnessToken", "The comparison freshness token is invalid."),
    "unknownRun": ("notFound", "analysis.unknownRun", "No analysis run matches the supplied identifier."),
    "repositoryUnavailable": ("notFound", "analysis.repositoryUnavailable", "The repository path could not be resolved to an available repository."),
    "unexpectedFailure": ("unexpected", "unexpectedFailure", "The action failed."),
    "repositoryBusy": ("conflict", "repository.busy", "An active analysis run reserves this repository."),
}
#: Actions that a repository with an active run refuses.
REFUSED_WHILE_ACTIVE = ("repositories.open", "repositories.removeRecent", *(a for a in ACTIONS if a.startswith("comparisons.")))


def strict_object(text: Column, allowed: tuple[str, ...], required: tuple[str, ...]) -> Column:
    """Whether a JSON object has no unknown and no repeated member, and all required ones."""
    keys = F.json_object_keys(text)
    known = F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0
    once = F.size(keys) == F.size(F.array_distinct(keys))
    there = F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0 if required else F.lit(True)
    return F.coalesce(known & once & there, F.lit(False))


def text_member(request: Column, path: str) -> Column:
    """A member that is a JSON text; null where it is missing or of another kind."""
    return F.when(F.schema_of_variant(F.try_variant_get(request, path, "variant")) == "STRING", F.try_variant_get(request, path, "string"))


def member_kind(request: Column, path: str) -> Column:
    """STRING, BIGINT, ... of a member; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(request, path, "variant"))


def parameters_ok(request: Column, action: Column) -> Column:
    """Whether the parameters are an object of just the action's members, once each, texts, and with all that it needs."""
    keys = F.coalesce(F.json_object_keys(F.col("parameters")), F.array().cast("array<string>"))
    once = F.size(keys) == F.size(F.array_distinct(keys))
    shape = F.coalesce(member_kind(request, "$.parameters").isin("VOID") | member_kind(request, "$.parameters").startswith("OBJECT"), F.lit(True))
    by_action = F
    for name, listed in ACTIONS.items():
        members = [m.rstrip("?") for m in listed.split()]
        fits = F.size(F.array_except(keys, F.array(*map(F.lit, members)).cast("array<string>"))) == 0
        for m in listed.split():
            kind = member_kind(request, f"$.parameters.{m.rstrip('?')}")
            fits = fits & (F.coalesce(kind.isin("STRING", "VOID"), F.lit(True)) if m.endswith("?") else F.coalesce(kind == "STRING", F.lit(False)))
        by_action = by_action.when(action == name, fits)
    return F.coalesce(shape & once & by_action, F.lit(False))


def one_json(text: Column) -> tuple[Column, Column]:
    """Whether a text is exactly one JSON value with nothing behind it, without and with repeated members in objects.

    The parsers leave unread what is behind a value. So the text must be all of an array, and also all of an object: what
    ends the one early doesn't end the other.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    array, object_ = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"value":'), text, F.lit("}"))
    single = (F.size(F.try_variant_get(F.try_parse_json(array), "$", "array<variant>")) == 1) & F.try_parse_json(object_).isNotNull()
    repeated = (F.size(F.from_json(array, "array<string>", strict)) == 1) & (F.size(F.from_json(object_, "map<string,string>", strict)) == 1)
    return F.coalesce(single, F.lit(False)), F.coalesce(repeated, F.lit(False))


def parse_requests(frame: DataFrame) -> DataFrame:
    """Request lines (value, and too_large where the reader has measured it) with request_id, action, parameters and an error.

    The error is null where the request is good, else a key of ERRORS. Kinds are strict: the version is the number 1,
    ids, actions and parameters are texts, and what an action needs is there.
    """
    large = F.coalesce("too_large", F.lit(False)) if "too_large" in frame.columns else F.lit(False)
    request, whole = F.try_parse_json("value"), F.when(~large, F.col("value"))
    single, repeated = one_json(whole)
    raw = frame.select(
        "*", (~single & ~repeated).alias("bad_json"), single.alias("single"), large.alias("large"), F.try_variant_get(request, "$.protocolVersion", "int").alias("version"), member_kind(request, "$.protocolVersion").alias("version_kind"),
        *(F.when(~large, text_member(request, f"$.{k}")).alias(n) for k, n in (("requestId", "request_id"), ("action", "action"))), F.get_json_object(whole, "$.parameters").alias("parameters"),
    )
    texts = F.col("request_id").isNotNull() & F.col("action").isNotNull() & (F.col("version_kind") == "BIGINT") & F.col("version").isNotNull()
    version = F.coalesce((F.col("version") == VERSION) & (F.col("version_kind") == "BIGINT"), F.lit(False))
    error = (
        F.when(F.col("large"), "requestTooLarge")
        .when(F.col("bad_json"), "invalidJson")
        .when(~F.col("single") | ~strict_object(F.col("value"), ENVELOPE, ENVELOPE[:3]), "malformedRequest")
        .when(~version & (F.col("version_kind").isin("BIGINT", "STRING")), "unsupportedVersion")
        .when(~F.coalesce(texts, F.lit(False)), "malformedRequest")
        .when(~non_blank(F.col("request_id")) | ~non_blank(F.col("action")), "blankField")
        .when(~F.col("action").isin(*ACTIONS), "unknownAction")
        .when(~parameters_ok(request, F.col("action")), "invalidParameters")
    )
    return raw.select(*frame.columns, "request_id", "action", "parameters", error.alias("error"))


def refuse_busy(parsed: DataFrame, active: DataFrame) -> DataFrame:
    """Parsed requests with canonical_path_key, in which those that an active run's repository must refuse have the error repositoryBusy.

    ``active`` has the canonical_path_key of every active run, each once.
    """
    held = active.select("canonical_path_key", F.lit(True).alias("held")).distinct()
    busy = F.col("held") & F.col("action").isin(*REFUSED_WHILE_ACTIVE) & F.col("error").isNull()
    joined = parsed.join(held, "canonical_path_key", "left")
    return joined.select(*(F.when(busy, "repositoryBusy").otherwise(F.col("error")).alias("error") if c == "error" else F.col(c) for c in parsed.columns))


def responses(parsed: DataFrame) -> DataFrame:
    """The response line to each parsed request: its result (a JSON text in column result, if there is one), or the typed error."""
    head = [F.lit(VERSION).alias("protocolVersion")]
    of = lambda n: F.coalesce(*(F.when(F.col("error") == k, F.lit(v[n])) for k, v in ERRORS.items()))
    errors = F.array(F.struct(of(0).alias("type"), of(1).alias("code"), of(2).alias("message")))
    fail = F.to_json(F.struct(*head, F.lit("error").alias("type"), F.col("request_id").alias("requestId"), errors.alias("errors")), {"ignoreNullFields": "false"})
    result = F.parse_json("result") if "result" in parsed.columns else F.lit(None).cast("string")
    good = F.to_json(F.struct(*head, F.lit("result").alias("type"), F.col("request_id").alias("requestId"), result.alias("result")), {"ignoreNullFields": "false"})
    return parsed.select(F.when(F.col("error").isNull(), good).otherwise(fail).alias("value"))


def response_ok(text: Column, request_id: Column) -> Column:
    """Whether a response has the version, the request's id (an error may have none) and, if an error, valid errors (F16)."""
    get = lambda k: F.get_json_object(text, f"$.{k}")
    errors = F.from_json(get("errors"), "array<struct<type:string,code:string,message:string>>")
    valid = (F.size(errors) > 0) & F.forall(errors, lambda e: non_blank(e["type"]) & non_blank(e["code"]) & non_blank(e["message"]))
    same = get("requestId") == request_id
    result = (get("type") == "result") & same & F.array_contains(F.json_object_keys(text), "result")
    error = (get("type") == "error") & F.coalesce(same, get("requestId").isNull()) & valid
    return F.coalesce((get("protocolVersion") == str(VERSION)) & (result | error), F.lit(False))


def normalize_error(kind: Column, code: Column, message: Column) -> Column:
    """A typed error of its parts, or the default where one is blank."""
    whole = non_blank(kind) & non_blank(code) & non_blank(message)
    default = F.struct(F.lit("unexpected").alias("type"), F.lit("unexpectedFailure").alias("code"), F.lit("The action failed.").alias("message"))
    return F.when(whole, F.struct(kind.alias("type"), code.alias("code"), message.alias("message"))).otherwise(default)

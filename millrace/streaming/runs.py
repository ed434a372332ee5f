"""Structured Streaming forms of the request loop and the run log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.contract import parse_requests, responses
from millrace.operators.state import TRANSITIONS
from millrace.sources.records import request_lines

STATE = "state string, seen long"
OUTPUT = "run_id string, state string, events long"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Request lines of the files that arrive in a folder."""
    return request_lines(spark.readStream.schema("value string").text(folder))


def answer(requests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The request loop: every request, good or bad, gets one response line; files of a batch are written once."""
    return responses(parse_requests(requests)).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold one run's new events, by time and id, into its state; late ones are folded when they come."""
    current, seen = state.get if state.exists else ("pendingCapture", 0)
    events = pd.concat(batches).sort_values(["at", "event_id"], kind="stable")
    for name in events["event"]:
        to, sources = TRANSITIONS.get(name, (None, ()))
        current, seen = (to if current in sources else current), seen + 1
    state.update((current, seen))
    yield pd.DataFrame({"run_id": [key[0]], "state": [current], "events": [seen]})


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run that a batch of events (run_id, at, event_id, event) touches, late ones folded as they come (W2); ``runlog`` has the form with a watermark."""
    return events.groupBy("run_id").applyInPandasWithState(advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)

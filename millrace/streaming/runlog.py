"""The run log as a stream with a watermark: any order of arrival within it gives one state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.state import TRANSITIONS
from millrace.sources.tables import ship_package

#: The order of events of one time and id, as ``fold_ranges`` has it; unknown ones and nulls come first.
PLACES = {name: i for i, name in enumerate(TRANSITIONS, 1)}


def then(state: str, event: str | None, times: int = 1) -> str:
    """The state behind an event that comes so many times."""
    to, sources = TRANSITIONS.get(event, (None, ()))
    for _ in range(min(times, 2)):  # no event may start twice from the state that it leads to
        state = to if state in sources else state
    return state


class RunLog(StatefulProcessor):
    """One run's settled state, and its events that are still within the watermark, which may yet be preceded by others."""

    def __init__(self, id_type: str):
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        """The run's state variables."""
        self.handle = handle
        self.settled = handle.getValueState("settled", "state string, n long")
        self.pending = handle.getMapState("pending", f"at long, event_id {self.id_type}, event string", "n long")

    def waiting(self) -> list[tuple]:
        """Pending events in order, as (at, event_id, event, times)."""
        found = [(*k, n[0]) for k, n in self.pending.iterator()]
        return sorted(found, key=lambda e: (e[0], e[1] is not None, e[1] if e[1] is not None else 0, PLACES.get(e[2], 0)))

    def base(self) -> tuple[str, int]:
        """The state and number of the events that are settled."""
        return tuple(self.settled.get()) if self.settled.exists() else ("pendingCapture", 0)

    def watch(self, waiting: list[tuple]) -> None:
        """Keep one timer, for the millisecond behind the earliest pending event."""
        due = waiting[0][0] // 1000 + 1 if waiting else None
        timers = set(self.handle.listTimers())
        for t in timers - {due}:
            self.handle.deleteTimer(t)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def told(self, key: tuple, waiting: list[tuple]) -> Row:
        """The state after all events known so far."""
        state, settled = self.base()
        for _, _, event, n in waiting:
            state = then(state, event, n)
        return Row(run_id=key[0], kind="state", state=state, events=settled + sum(e[3] for e in waiting), settled=settled, event_id=None, at=None, event=None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        """List events behind the watermark, keep the others, and tell the run's state."""
        watermark, kept = timerValues.getCurrentWatermarkInMs(), False
        for r in rows:
            if r["at"] is None or r["at"] // 1000 < watermark:
                yield Row(run_id=key[0], kind="late", state=None, events=None, settled=None, event_id=r["event_id"], at=r["at"], event=r["event"])
                continue
            at = (r["at"], r["event_id"], r["event"])
            times = self.pending.getValue(at)[0] if self.pending.containsKey(at) else 0
            self.pending.updateValue(at, (times + 1,))
            kept = True
        if kept:
            waiting = self.waiting()
            self.watch(waiting)
            yield self.told(key, waiting)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Settle what the watermark has passed: nothing earlier can come any more."""
        watermark, (state, settled), left = timerValues.getCurrentWatermarkInMs(), self.base(), []
        for at, event_id, event, n in self.waiting():
            if at // 1000 < watermark:
                state, settled = then(state, event, n), settled + n
                self.pending.removeKey((at, event_id, event))
            else:
                left.append((at, event_id, event, n))
        self.settled.update((state, settled))
        self.watch(left)
        yield self.told(key, left)

    def close(self) -> None:
        """Nothing is held outside the state store."""


def timed_run_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What a stream of events (run_id, at timestamp, event_id, event) says of each run that a batch touches.

    Rows of kind state have the run's state, how many events it has and how many of them are settled; a run's last row is
    what ``fold_runs`` gives for the same events. Rows of kind late list, with time (in microseconds), id and name, each
    event that came after the watermark had passed it, or without a time; it changes nothing. An event is in time if it is
    no more than ``delay`` behind the latest event of the batches before its own; the order of arrival then doesn't matter.

    A run's state is one fold and the events of its last ``delay``, kept in the state store under (at, event_id, event).
    Ids are compared as they are; an unknown or a null event counts and changes nothing. The session's state store must
    be RocksDB's. The time goes to the operator as a number, without its watermark mark: rows behind the watermark would
    otherwise be filtered out silently before they are seen.
    """
    ship_package(events.sparkSession)
    id_type = events.schema["event_id"].dataType.simpleString()
    run_type = events.schema["run_id"].dataType.simpleString()
    timed = events.withWatermark("at", delay).select("run_id", F.unix_micros("at").alias("at"), "event_id", "event")
    output = f"run_id {run_type}, kind string, state string, events long, settled long, event_id {id_type}, at long, event string"
    return timed.groupBy("run_id").transformWithState(RunLog(id_type), output, "Update", "EventTime")

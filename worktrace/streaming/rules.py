"""The rule engine over a stream of events: segments as soon as no later event can change them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from worktrace.operators.segment import LEAST_MS, Rules, signals

EVENT = "timestamp_ms long, seq long, work boolean, home boolean, switched string, shown string, title_portal string, anchor string"
SPAN = "struct<start: long, last: long, first: long, until: long>"
STATE = f"no long, anchor string, open {SPAN}, worked boolean, portal string, waiting {SPAN}"
OUT = "session_id string, start_ms long, end_ms long, first_no long, last_no long, event_count long"


class Machine:
    """The open segment, what waits and the last anchor of a session; ``found`` has what was closed for good."""

    def __init__(self, rules: Rules, state: tuple | None):
        self.rules = rules
        self.no, self.anchor, self.open, self.worked, self.portal, self.waiting = state or (0, None, None, False, None, None)
        self.open, self.waiting = self.open and list(self.open), self.waiting and list(self.waiting)
        self.found: list[list] = []

    def state(self) -> tuple:
        return (self.no, self.anchor, self.open and tuple(self.open), self.worked, self.portal, self.waiting and tuple(self.waiting))

    def close(self) -> None:
        start, last, _, until = self.open
        if last - start >= self.rules.least_ms:
            if self.waiting and self.waiting[1] - self.waiting[0] >= LEAST_MS:
                self.found.append(self.waiting)
            self.found.append(self.open)
            self.waiting = None
        elif self.waiting:
            self.waiting[1], self.waiting[3] = last, until
        else:
            self.waiting = self.open
        self.open = None

    def idle(self, until_ms: int) -> None:
        """Nothing comes before or at ``until_ms`` any more."""
        if self.open and until_ms + 1 - self.open[1] >= self.rules.idle_ms:
            self.close()

    def event(self, ms: int, seq: int, work: bool, home: bool, switched: str | None, shown: str | None, title: str | None, anchor: str | None) -> None:
        r = self.rules
        if self.open:
            lasted = self.open[1] - self.open[0]
            moved = switched is not None and self.portal is not None and switched != self.portal
            changed = anchor is not None and self.anchor is not None and anchor != self.anchor
            if ms - self.open[1] >= r.idle_ms or moved or (self.worked and ((home and lasted >= r.hub_ms) or (changed and lasted >= r.anchor_ms))):
                self.close()
        self.anchor = self.anchor if anchor is None else anchor
        if not self.open:
            self.open, self.worked, self.portal = [ms, ms, self.no, self.no], False, title
        self.open[1], self.open[3] = ms, self.no
        self.worked = self.worked or work
        self.portal = self.portal if shown is None else shown
        self.no += 1

    def end(self) -> None:
        if self.open:
            self.close()
        if self.waiting and self.waiting[1] - self.waiting[0] >= self.rules.least_ms:
            self.found.append(self.waiting)
        self.waiting = None


class RuleProcessor(StatefulProcessor):
    """Per session: a value of the machine's state, and a list of the events that the watermark has not passed yet."""

    def __init__(self, rules: Rules, silence_ms: int):
        self.rules, self.silence_ms = rules, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", STATE)
        self.buffer = handle.getListState("buffer", EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(v) else v for v in row) for frame in rows for row in frame.drop(columns=["session_id", "at"]).itertuples(index=False)]
        if new:
            self.buffer.appendList([(int(e[0]), int(e[1]), bool(e[2]), bool(e[3]), *e[4:]) for e in new])
        yield self.released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.released(key, timerValues.getCurrentWatermarkInMs())

    def released(self, key: tuple, passed_ms: int) -> pd.DataFrame:
        """Segments closed by the events that the watermark has passed, in order, and by the silence after them."""
        held = [tuple(e) for e in self.buffer.get()] if self.buffer.exists() else []
        machine = Machine(self.rules, tuple(self.machine.get()) if self.machine.exists() else None)
        due = sorted((e for e in held if e[0] <= passed_ms), key=lambda e: e[:2])
        for e in due:
            machine.event(*e)
        later = [e for e in held if e[0] > passed_ms]
        last = machine.open[1] if machine.open else machine.waiting[1] if machine.waiting else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        machine.idle(passed_ms)
        if not later and (last is None or passed_ms >= last + self.silence_ms):
            machine.end()
            self.machine.clear()
            self.buffer.clear()
        else:
            self.machine.update(machine.state())
            if due:
                self.buffer.clear()
                if later:
                    self.buffer.appendList(later)
            # The next moment at which something can happen without a new event: one is due, the open segment is idle, all is over.
            moments = [min((e[0] for e in later), default=None), machine.open and machine.open[1] + self.rules.idle_ms, last and last + self.silence_ms]
            for moment in {m for m in moments if m is not None}:
                self.handle.registerTimer(max(moment, passed_ms + 1))
        rows = [(key[0], a, b, first, until, until - first + 1) for a, b, first, until in machine.found]
        return pd.DataFrame(rows, columns=["session_id", "start_ms", "end_ms", "first_no", "last_no", "event_count"])

    def close(self) -> None:
        pass


def stream_rule_segments(events: DataFrame, rules: Rules = Rules(), late: str = "1 hour", silence_ms: int = 86_400_000) -> DataFrame:
    """Segments of a stream of events, in columns and rows as ``rule_segments`` gives them of a table.

    Events wait until the watermark, ``late`` behind the newest of all sessions, has passed them, and are then applied in order; what comes
    later still is dropped (``streaming.sinks`` can write it apart). A session ends, and its state goes, when the
    watermark is ``silence_ms`` past its last event; events after that begin a new one, whose numbers start at 0. State is kept in the
    RocksDB state store, which the session has to name (spark.sql.streaming.stateStore.providerClass). Sessions, times and
    sequence numbers are not null.
    """
    lean = signals(events).withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", late)
    lean = lean.select("session_id", *[c.split(" ")[0] for c in EVENT.split(", ")], "at")
    return lean.groupBy("session_id").transformWithStateInPandas(RuleProcessor(rules, silence_ms), OUT, "append", "EventTime")

"""Sessions whose utterances are read in the order they were spoken, however late they come.

State is kept by session: utterances that wait for the watermark, utterances read so far
(a list that only grows, so nothing is written twice), and the latched gate term.  Event-time
timers release what is due and drop a session that has been idle.  Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import ship_by_value
from ..functions import lexicons as L

OUTPUT = "session string, turn long, transcript string, gate_term string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedSession(StatefulProcessor):
    """Reads a session's utterances by event time, then turn; one output row for each."""

    def __init__(self, pattern: str, idle_ms: int | None):
        self.pattern, self.idle_ms = pattern, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        import re

        self.handle, self.rx = handle, re.compile(self.pattern, re.I)
        self.waiting = handle.getListState("waiting", "at long, turn long, text string")
        self.said = handle.getListState("said", "text string")
        self.last = handle.getValueState("last", "at long, gate_term string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            if row["at"] <= passed:
                continue
            self.waiting.appendValue((row["at"], row["turn"], row["text"] or ""))
            self.handle.registerTimer(row["at"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(w for w in waiting if w[0] <= now)
        last_at, gate = self.last.get() if self.last.exists() else (None, None)
        if not due:
            if self.idle_ms is not None and last_at is not None and last_at + self.idle_ms <= now:
                self.said.clear()
                self.last.clear()
            return
        transcript = " ".join(s[0] for s in self.said.get()) if self.said.exists() else ""
        for at, turn, text in due:
            if self.idle_ms is not None and last_at is not None and at - last_at >= self.idle_ms:
                self.said.clear()
                transcript, gate = "", None
            last_at = at
            transcript = f"{transcript} {text}".strip() if transcript else text
            if gate is None:
                found = self.rx.search(transcript)
                gate = found.group(0) if found else None
            if text:
                self.said.appendValue((text,))
            yield Row(session=key[0], turn=turn, transcript=transcript, gate_term=gate)
        left = [w for w in waiting if w[0] > now]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self.last.update((last_at, gate))
        if self.idle_ms is not None:
            self.handle.registerTimer(last_at + self.idle_ms)


def ordered_sessions(utterances: DataFrame, delay: str = "10 seconds", idle_ms: int | None = None) -> DataFrame:
    """(session, turn, transcript, gate_term) of a stream of session, turn, text and at (timestamp), appended.

    An utterance is read once the watermark, the latest ``at`` less ``delay``, has reached it, so
    arrival in any order within ``delay`` gives what one ordered pass would.  One that comes
    when the watermark has reached it already is dropped.  After ``idle_ms`` of event time without an
    utterance a session's state goes, and it begins anew.  Null texts say nothing; a repeated utterance is read twice.
    """
    if utterances.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    timed = utterances.withWatermark("at", delay)
    asked = timed.select("session", "turn", "text", F.unix_millis("at").alias("at"), F.col("at").alias("event_time"))
    return asked.groupBy("session").transformWithState(OrderedSession("|".join(L.OUT_OF_DOMAIN), idle_ms), OUTPUT, "append", "eventtime")


ship_by_value(__name__)

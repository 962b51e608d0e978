"""The fetch log as a stream: the limiter's state per origin, and statistics by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import START, STATE, limiter_step

PROBE_MS = 30 * 60_000
OUT = f"origin long, at_ms long, reason string, {STATE}, blocked_until long"
EVENT = "at_ms long, id long, kind string"
#: What a stream of this needs: state with list values and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Events wait until the watermark is past them, so they count in order of time and id however they arrive.

    Timers stand for the earliest waiting event, the end of a cool-down and the end of the window after a challenge in which no probe is
    sent. A row tells the state after the events that a timer settled ("events"), or that a cool-down or a probe window is over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", EVENT)
        self.state = handle.getValueState("state", f"{STATE}, blocked_until long")

    def _now(self) -> tuple:
        found = self.state.get() if self.state.exists() else None
        return (*START, None) if found is None else tuple(None if pd.isna(x) else int(x) for x in found)

    def _wait(self, events: list[tuple]) -> None:
        """Keep events until the earliest of them is due; what is due then settles all that the watermark has passed."""
        if events:
            self.early.appendList(events)
            self.handle.registerTimer(min(events)[0])

    def _row(self, key: tuple, at_ms: int, reason: str, state: tuple) -> tuple:
        return (key[0], at_ms, reason, *state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame[frame["at_ms"] > passed]
            self._wait([(int(t), int(i), k) for t, i, k in zip(frame["at_ms"], frame["id"], frame["kind"], strict=True)])
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, due = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        waiting = [(int(t), int(i), k) for t, i, k in self.early.get()]
        ripe = sorted(e for e in waiting if e[0] <= passed)
        state, told = self._now(), []
        if ripe:
            *now, blocked = state
            now = tuple(now)
            for at_ms, _, kind in ripe:
                now = limiter_step(now, kind, at_ms)
                if kind == "challenge":
                    blocked = at_ms + PROBE_MS
            state = (*now, blocked)
            self.early.clear()
            self._wait([e for e in waiting if e[0] > passed])
            self.state.update(state)
            told.append(self._row(key, ripe[-1][0], "events", state))
            for until in (now[2], blocked):
                if until is not None and until > passed:
                    self.handle.registerTimer(until)
                elif until is not None:
                    due = until
        for until, reason in ((state[2], "cool-down over"), (state[5], "probe again")):
            if until is not None and until <= passed and until == due:
                told.append(self._row(key, until, reason, state))
        if told:
            out = pd.DataFrame(told, columns=[f.split()[0] for f in OUT.split(", ")])
            yield out.astype({"cooldown_until": "Int64", "blocked_until": "Int64"})

    def close(self) -> None:
        pass


def limiter_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (origin, id, kind, at_ms) to the state of each origin whenever the watermark passes events of it.

    Any order of the events over micro-batches gives the states of the fold, as long as none is later than ``late``; later ones are dropped. Needs the
    state store STATE_STORE. An origin holds its events of the last ``late`` and one state.
    """
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("origin").transformWithStateInPandas(Limiter(), outputStructType=OUT, outputMode="update", timeMode="eventTime")


def windowed_stats(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and challenges by window of event time; events later than ``late`` are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", length), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if("challenge").alias("challenges"))

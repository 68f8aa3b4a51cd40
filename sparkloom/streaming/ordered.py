"""Session state over a stream whose events come in any order: each waits until the watermark passes it.

Answers the rows of the batch twins (``operators.telemetry``: guided_reads, selectors,
nudges) for every stream that is out of order by no more than the watermark's delay.
Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.streaming.sessions import OUT, STATE, marked, walk

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "t timestamp, seq long, category string, short string, is_code boolean, warned boolean, query string, symbol string, chunk_id string"
NAMES = [c.split()[0] for c in WAITING.split(", ")]


class Session(StatefulProcessor):
    """A session's events that wait, and what it knows; both go when it has been idle for so long."""

    def __init__(self, most_nudges: int, idle_ms: int) -> None:
        self.most_nudges, self.idle_ms = most_nudges, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.known = handle.getValueState("known", f"{STATE}, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            part = part[NAMES].astype(object).where(part[NAMES].notna(), None)
            self.waiting.appendList([(row[0].to_pydatetime(), int(row[1]), *row[2:]) for row in part.itertuples(index=False, name=None)])
            for at in part["t"].unique():
                self.handle.registerTimer(_millis(at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due = [dict(zip(NAMES, r, strict=True)) for r in rows if _millis(r[0]) <= passed]
        state = list(self.known.get()) if self.known.exists() else [None, None, None, 0, None, None, None, None]
        if due:
            out, now = walk(key[0], due, state[:-1], self.most_nudges)
            last = due[-1]["t"]
            self.known.update((*now, last))
            self.handle.registerTimer(_millis(last) + self.idle_ms)
            later = rows[len(due) :]
            self.waiting.put(later) if later else self.waiting.clear()
            yield out
        elif not rows and state[-1] is not None and _millis(state[-1]) + self.idle_ms <= passed:
            self.known.clear()

    def close(self) -> None:
        pass


def _millis(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


def follow_in_order(payloads: DataFrame, most_nudges: int = 3, late: str = "2 hours", idle: str = "365 days") -> DataFrame:
    """What ``sessions.follow`` answers, for events that come up to ``late`` behind others: each is answered when the watermark has passed it.

    A session's state is dropped ``idle`` after its last event.
    """
    rows = marked(payloads).withWatermark("t", late)
    return rows.groupBy("sid").transformWithStateInPandas(Session(most_nudges, int(pd.Timedelta(idle).total_seconds() * 1000)), OUT, "Append", "EventTime")

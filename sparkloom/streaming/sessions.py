"""Session state over a stream of events: what guided a read, what the session last asked for, and the nudge limit.

The batch twins are ``operators.telemetry.guided_reads``, ``selectors`` and ``nudges``;
both answer the same rows when events of a session arrive in the order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.functions import exprs as X
from sparkloom.operators.telemetry import warned

OUT = "sid long, seq long, guided_by string, nudge int, last_query string, last_symbol string, last_chunk string"
STATE = "tool string, engine_at timestamp, native_at timestamp, nudges int, query string, symbol string, chunk string"


def marked(payloads: DataFrame) -> DataFrame:
    """The calls with their category and short name, and whether each is code and to be warned of."""
    rows = payloads.withColumn("t", F.col("t").cast("timestamp"))
    rows = rows.withColumns({"category": X.categorize(F.col("tool")), "short": X.tool_short(F.col("tool")), "is_code": F.coalesce(X.is_code_path(F.col("path")), F.lit(False))})
    reason = X.reason_code(F.col("tool"), F.col("path"), F.col("query"))
    rows = rows.withColumn("reason_code", F.when(F.col("category") == "native", reason))
    return rows.withColumn("warned", F.coalesce(warned() & F.col("reason_code").isNull(), F.lit(False)))


def walk(sid: int, rows: list[dict], state: list | tuple, most_nudges: int) -> tuple[pd.DataFrame, tuple]:
    """A session's answers to its next calls, in order, and its state after them."""
    tool, engine_at, native_at, nudges, *known = state
    out = []
    for r in rows:
        free = engine_at is not None and (native_at is None or native_at < engine_at)
        led = tool if free and r["short"] == "Read" and r["is_code"] else None
        nudge = None
        if r["warned"] and nudges < most_nudges:
            nudges += 1
            nudge = nudges
        out.append((sid, r["seq"], led, nudge, *known))
        if r["category"] == "engine":
            tool, engine_at = r["short"], r["t"]
            said = lambda x: x.strip()[:200] or None if isinstance(x, str) else None
            if r["short"] == "search":
                known[0] = said(r["query"]) or known[0]
            else:
                known[1] = said(r["symbol"]) or known[1]
                known[2] = (said(r["chunk_id"]) if r["short"] == "source" else None) or known[2]
        elif r["category"] == "native":
            native_at = r["t"]
    names = ["sid", "seq", "guided_by", "nudge", "last_query", "last_symbol", "last_chunk"]
    return pd.DataFrame(out, columns=names).astype({"nudge": "Int32"}), (tool, engine_at, native_at, nudges, *known)


def follow(payloads: DataFrame, most_nudges: int = 3, idle: str = "2 hours") -> DataFrame:
    """Per call: the engine tool that guided a code read, the number of its nudge, and what the session knew before it.

    ``payloads`` streams sid, seq, t, tool, path, query, symbol and chunk_id. State is a
    few values a session and is dropped when the watermark passes its last event by
    ``idle``. Whether a call is warned of and what it is are expressions on the stream.
    Events of a session are taken in the order in which they come (``ordered`` waits for late ones).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else (None, None, None, 0, None, None, None)
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        out, known = walk(key[0], rows.to_dict("records"), known, most_nudges)
        state.update(known)
        if len(rows):
            last = rows["t"].iloc[-1]
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1000 * int(pd.Timedelta(idle).total_seconds()))
        yield out

    return marked(payloads).withWatermark("t", idle).groupBy("sid").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)

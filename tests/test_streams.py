"""Streams against their batch twins: events out of order, and the log of observed calls."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import telemetry as T
from sparkloom.sources import views as V
from sparkloom.streaming import observed_log as L
from sparkloom.streaming.ordered import PROVIDER, follow_in_order

DATA = "/root/testdata/sf0.001"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_late_events_are_put_in_order(spark, tmp_path):
    payloads = V.payloads(spark, DATA).select("sid", "seq", "t", "tool", "path", "query", "symbol", "chunk_id")
    # Files hold the events by time, but each comes up to two days too early or too late.
    rng = random.Random(6)
    events = sorted(payloads.collect(), key=lambda r: r.t.timestamp() + rng.uniform(-2, 2) * 86400)
    end = spark.createDataFrame([(-1, -1, "2090-01-01", "x", None, None, None, None)], payloads.withColumn("t", F.col("t").cast("string")).schema).withColumn("t", F.col("t").cast("timestamp"))
    for k in range(0, len(events), 250):
        spark.createDataFrame(events[k : k + 250], payloads.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, PROVIDER)
    try:
        stream = spark.readStream.schema(payloads.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        q = follow_in_order(stream, late="5 days").writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(400)
        assert not q.isActive
    finally:
        spark.conf.unset(provider)
    out = spark.table("ordered").where("sid >= 0")
    records = T.observed_records(payloads)
    assert rows(out.where("guided_by is not null").select("sid", "seq", "guided_by")) == rows(records.where("guided_by is not null").select("sid", "seq", "guided_by"))
    assert rows(out.where("nudge is not null").select("sid", "seq", F.col("nudge").cast("long"))) == rows(T.nudges(records).select("sid", "seq", "nudge"))
    assert rows(out.select("sid", "seq", "last_query", "last_symbol", "last_chunk")) == rows(T.selectors(payloads))


LINES = [
    '{"t":"2024-01-05T00:00:00.000Z","tool":"Read","repo":"/r","sid":"s","path":"a.kt","isCodeFile":true,"offset":3}',
    "", "   ", "not json", '{"t":"2024-01-01T00:00:00.000Z","tool":', '{"t":"2024-01-02T00:00:00.000Z","tool":"Grep","repo":"/q","sid":"s","selector":"x"}',
    '{"tool":"Read","repo":"/r","sid":"s"}', '{"t":"2024-01-04T00:00:00.000Z","tool":"Bash","repo":"/r","sid":"t","more":[1]}',
]


def test_log_as_stream_and_at_once(spark, tmp_path):
    first, second = str(tmp_path / "log"), str(tmp_path / "copy")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(LINES[:5]) + "\n")
    (tmp_path / "log" / "b.jsonl").write_text("\n".join(LINES[5:]))
    log = L.read_log(spark, first)
    assert log.cache().where(F.col(L.BAD).isNotNull()).count() == 2
    assert rows(L.records(log, "/r").select("tool", "sid")) == {("Read", "s"), ("Bash", "t")} and L.records(log, "/r").count() == 3
    assert L.records(log, "/r", "2024-01-04T12").select("path", "isCodeFile", "offset").collect() == [("a.kt", True, 3)]
    L.append(L.records(L.stream_log(spark, first)), second, str(tmp_path / "state")).awaitTermination(120)
    assert rows(L.records(L.read_log(spark, second))) == rows(L.records(log))
    L.append(L.records(L.stream_log(spark, first)), second, str(tmp_path / "state")).awaitTermination(120)  # nothing is appended twice
    assert L.read_log(spark, second).count() == 4


def test_clean_up(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    counts = {r.fate: r.lines for r in L.cleaned(lines, str(tmp_path / "kept"), "2024-01-06 00:00:00", 3).collect()}
    assert counts == {"kept": 2, "old": 2, "malformed": 2}
    assert {r.value for r in spark.read.text(str(tmp_path / "kept")).collect()} == {LINES[0], LINES[7]}

"""The log of observed calls: JSON lines read as a stream or at once, appended by a stream, and cleaned by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sparkloom.functions import exprs as X

#: The fields of a record.
FIELDS = "t string, tool string, repo string, sid string, path string, isCodeFile boolean, selector string, offset long, `limit` long, guidedBy string, policyMode string, reasonCode string"
BAD = "_malformed"


def _reader(reader, folder: str) -> DataFrame:
    return reader.schema(f"{FIELDS}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of a log; a malformed one has its text in ``_malformed`` and no fields. Blank lines are none."""
    return _reader(spark.read, folder)


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines as files come to the folder."""
    return _reader(spark.readStream, folder)


def records(log: DataFrame, repo: str | None = None, since: str | None = None) -> DataFrame:
    """The records of a repository, and of a time (ISO text) or later; malformed lines are passed over."""
    rows = log.where(F.col(BAD).isNull())
    rows = rows.where(F.col("repo") == repo) if repo else rows
    return (rows.where(F.col("t") >= since) if since else rows).drop(BAD)


def log_rows(observed: DataFrame) -> DataFrame:
    """Observed records (sid, t, tool, path, is_code, selector, start, most, guided_by, policy, reason_code, repo) as a log has them."""
    when = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return observed.select(
        when.alias("t"), "tool", "repo", F.col("sid").cast("string").alias("sid"), "path", F.col("is_code").alias("isCodeFile"), "selector", F.col("start").alias("offset"),
        F.col("most").alias("limit"), F.col("guided_by").alias("guidedBy"), F.col("policy").alias("policyMode"), F.col("reason_code").alias("reasonCode"),
    )


def append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to a log as JSON lines, each once, also after a restart; takes what is there and ends."""
    return rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def age(lines: DataFrame, now: str, days: int = 90) -> DataFrame:
    """The lines (value) of a log that are not blank, with ``fate``: kept, old, or malformed. Lines without a time are old."""
    told = F.from_json("value", f"{FIELDS}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    cutoff = F.date_format(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fate: Column = F.when(told[BAD].isNotNull(), "malformed").when(told["t"] >= cutoff, "kept").otherwise("old")
    return lines.where(X.strip(F.col("value")) != "").select("value", fate.alias("fate"))


def cleaned(lines: DataFrame, folder: str, now: str, days: int = 90) -> DataFrame:
    """Writes the lines that are young enough to ``folder``; returns how many of each fate there were."""
    rows = age(lines, now, days)
    rows.where("fate = 'kept'").select("value").write.text(folder)
    return rows.groupBy("fate").agg(F.count("*").alias("lines"))

"""Usage analytics: savings, breakdowns, retention, export, coverage and session attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X

META = "query string, resultCount long, truncated boolean, sources struct<lexical:long,vector:long,both:long>, timing string, retrieval string, packager string, topScores string"


def saved_percent(sent: Column, raw: Column) -> Column:
    """Percent saved to one place; null where there was nothing to save from."""
    return F.when(raw > 0, X.round_half_up(100.0 * (raw - sent) / raw))


def usage_by_tool(calls: DataFrame) -> DataFrame:
    out = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("tokens_sent").alias("sent"), F.sum("tokens_raw").alias("raw"))
    return out.withColumn("saved_pct", saved_percent(F.col("sent"), F.col("raw")))


def usage_cube(calls: DataFrame) -> DataFrame:
    """Tool, channel, model and total breakdowns from one pass; the total's percentage is 0 where there was nothing to save from."""
    calls = calls.withColumns({"channel": F.coalesce("channel", F.lit("mcp")), "model": F.coalesce("model", F.lit("unknown"))})
    out = calls.groupingSets([["tool"], ["channel"], ["model"], []], "tool", "channel", "model").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("calls"), F.sum("tokens_sent").alias("sent"), F.sum("tokens_raw").alias("raw"), F.min("called_at").cast("string").alias("first_call")
    )
    named = [F.coalesce(c, F.lit("*")).alias(c) for c in ("tool", "channel", "model")]
    return out.select("level", *named, "calls", "sent", "raw", F.coalesce(saved_percent(F.col("sent"), F.col("raw")), F.lit(0.0)).alias("saved_pct"), "first_call")


def usage_by(calls: DataFrame, column: str, default: str) -> DataFrame:
    """Calls and tokens by channel or model; null and the default's name are one."""
    return calls.groupBy(F.coalesce(column, F.lit(default)).alias(column)).agg(F.count("*").alias("calls"), F.sum("tokens_sent").alias("sent"))


def search_insights(calls: DataFrame) -> DataFrame:
    """Averages over searches and the mix of their sources; malformed or missing metadata count as calls without results."""
    m = F.from_json("metadata", META)
    rows = calls.where("tool = 'search'").select("tokens_sent", m["resultCount"].alias("n"), *(m["sources"][s].alias(s) for s in ("lexical", "vector", "both")))
    sums = [F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("lexical", "vector", "both")]
    out = rows.agg(F.count("*").alias("searches"), X.round_half_up(F.coalesce(F.sum("n"), F.lit(0)) / F.count("*")).alias("avg_results"), F.floor(F.avg("tokens_sent") + 0.5).cast("long").alias("avg_tokens"), *sums)
    everything = F.col("lexical") + F.col("vector") + F.col("both")
    share = lambda s: F.coalesce(F.floor(F.try_divide(100.0 * F.col(s), everything) + 0.5), F.lit(0)).cast("long").alias(f"{s}_pct")
    return out.where("searches > 0").select("*", *map(share, ("lexical", "vector", "both")))


def period_start(period: str, now: str) -> Column | None:
    """Where a period begins: today at midnight, seven or thirty days before ``now``; all begins nowhere."""
    at = F.lit(now).cast("timestamp")
    return {"today": F.date_trunc("day", at), "week": at - F.expr("INTERVAL 7 DAYS"), "month": at - F.expr("INTERVAL 30 DAYS")}.get(period)


def within(calls: DataFrame, period: str, now: str) -> DataFrame:
    """The calls of a period."""
    start = period_start(period, now)
    return calls if start is None else calls.where(F.col("called_at") >= start)


def usage_by_period(calls: DataFrame, now: str) -> DataFrame:
    """Each period's label, calls and savings, from one pass over the calls."""
    labels = {"today": F.lit("today"), "week": F.lit("last 7 days"), "month": F.lit("last 30 days"), "all": F.concat(F.lit("all time (since "), F.date_format(F.min("called_at"), "yyyy-MM-dd"), F.lit(")"))}
    periods = [F.when(F.lit(True) if (s := period_start(p, now)) is None else F.col("called_at") >= s, p) for p in labels]
    rows = calls.select("called_at", "tokens_sent", "tokens_raw", F.explode(F.array_compact(F.array(*periods))).alias("period"))
    label = F.lit(None).cast("string")
    for p, text in labels.items():
        label = F.when(F.col("period") == p, text).otherwise(label)
    out = rows.groupBy("period").agg(label.alias("label"), F.count("*").alias("calls"), F.sum("tokens_sent").alias("sent"), F.sum("tokens_raw").alias("raw"))
    return out.withColumn("saved_pct", F.coalesce(saved_percent(F.col("sent"), F.col("raw")), F.lit(0.0)))


def retained(calls: DataFrame, now: str, days: int = 90) -> DataFrame:
    """The calls that are not older than so many days."""
    return calls.where(F.col("called_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def export_rows(calls: DataFrame, anonymize: bool, tool: str | None = None, limit: int = 0, period: str = "all", now: str | None = None) -> DataFrame:
    """The calls of a tool and period (that ends ``now``) with their metadata's fields as columns; with a limit the newest ones, in order.

    Anonymised ones have a hash for the repository, a date for the time and no query.
    """
    rows = calls.where(F.col("tool") == tool) if tool else calls
    since = period_start(period, now) if period != "all" else None
    rows = rows.where(F.col("called_at") >= since) if since is not None else rows
    rows = rows.orderBy(F.desc("called_at"), "id").limit(limit) if limit else rows
    m = F.from_json("metadata", META)
    repo = F.substring(F.sha2("repo_path", 256), 1, 8) if anonymize else F.element_at(F.split("repo_path", "/"), -1)
    when = F.date_format("called_at", "yyyy-MM-dd" if anonymize else "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "id", "tool", repo.alias("repo"), when.alias("called_at"), "duration_ms", "tokens_sent", "tokens_raw", F.coalesce("channel", F.lit("mcp")).alias("channel"), "model",
        *([] if anonymize else [m["query"].alias("query")]), m["resultCount"].alias("result_count"), m["truncated"].alias("truncated"), F.to_json(m["sources"]).alias("sources"),
        m["timing"].alias("timing"), m["retrieval"].alias("retrieval"), m["packager"].alias("packager"), m["topScores"].alias("top_scores"),
    )


def csv_lines(rows: DataFrame) -> DataFrame:
    """The nine fixed columns as CSV lines with a header, which no rows don't have; a value is quoted only if it holds a comma or a quote."""
    names = ["id", "tool", "repo", "called_at", "duration_ms", "tokens_sent", "tokens_raw", "channel", "model"]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    quoted = [F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    head = rows.limit(1).select(F.lit(",".join(names)).alias("line"))
    return head.unionByName(rows.select(F.concat_ws(",", *quoted).alias("line")))


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as a compact object."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def observed_records(payloads: DataFrame) -> DataFrame:
    """What is kept of a hook's payload: the tool with its path and selector, whether it is code, what guided it, and why a native call is none."""
    tool = F.substring("tool", 1, 200)
    selector = F.when(X.tool_short(tool).isin("Grep", "Glob"), F.substring(F.nullif(F.trim("query"), F.lit("")), 1, 160))
    path = F.when(F.trim("path") != "", F.substring("path", 1, 500))
    rows = payloads.withColumns({"tool": tool, "path": path, "selector": selector, "is_code": X.is_code_path(path), "category": X.categorize(tool)})
    rows = rows.withColumn("reason_code", F.when(F.col("category") == "native", X.reason_code(F.col("tool"), F.col("path"), F.col("query"))))
    return guided(rows).withColumn("policy", F.when(F.col("category") == "native", "warn"))


def _before() -> Window:
    return Window.partitionBy("sid").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)


def guided(events: DataFrame) -> DataFrame:
    """Adds guided_by: the engine tool last used before a read of code, unless a native call came since or at the same time."""
    c = X.categorize(F.col("tool"))
    engine = F.last(F.when(c == "engine", F.struct("t", X.tool_short(F.col("tool")).alias("short"))), ignorenulls=True).over(_before())
    native = F.last(F.when(c == "native", F.col("t")), ignorenulls=True).over(_before())
    rows = events.withColumns({"_engine": engine, "_native": native})
    free = F.col("_native").isNull() | (F.col("_native") < F.col("_engine.t"))
    reads = (X.tool_short(F.col("tool")) == "Read") & F.coalesce("is_code", F.lit(False))
    return rows.withColumn("guided_by", F.when(reads & free, F.col("_engine.short"))).drop("_engine", "_native")


def guided_reads(events: DataFrame) -> DataFrame:
    return guided(events).where("guided_by is not null").select("sid", "seq", "guided_by")


def selectors(payloads: DataFrame) -> DataFrame:
    """Each call with what the session knows before it: the last search's query, symbol and chunk of engine calls."""
    engine = X.categorize(F.col("tool")) == "engine"
    short = X.tool_short(F.col("tool"))
    said = lambda c: F.nullif(F.substring(F.trim(c), 1, 200), F.lit(""))
    last = lambda c: F.last(c, ignorenulls=True).over(_before())
    return payloads.select(
        "sid", "seq",
        last(F.when(engine & (short == "search"), said("query"))).alias("last_query"),
        last(F.when(engine & (short != "search"), said("symbol"))).alias("last_symbol"),
        last(F.when(engine & (short == "source"), said("chunk_id"))).alias("last_chunk"),
    )


def warned() -> Column:
    """Whether a native call on its own calls for a warning: a Grep unless its pattern is for a known path, a Glob with wildcards, a Read of code."""
    tool, path, query = F.col("tool"), F.col("path"), F.nullif(F.trim("query"), F.lit(""))
    glob = F.coalesce(query, path)
    known = F.coalesce(X.looks_like_regex(query) & path.isNotNull(), F.lit(False))
    return F.when(tool == "Grep", ~known).when(tool == "Glob", glob.isNull() | glob.rlike(r"[*?\[\]{}]")).when(tool == "Read", F.coalesce("is_code", F.lit(False))).otherwise(False)


def decisions(records: DataFrame, policy: str = "warn") -> DataFrame:
    """The guardrail's answer to each native call that is no exception: sid, seq, t, action (warn or block), hint and symbol.

    ``records`` are ``observed_records``. With policy off there are none. Strict blocks what
    it would warn of, save reads that the engine guided.
    """
    if policy == "off":
        return records.limit(0).select("sid", "seq", "t", F.lit("").alias("action"), F.lit("").alias("hint"), F.lit("").alias("symbol"))
    tool, path, query = F.col("tool"), F.col("path"), F.nullif(F.trim("query"), F.lit(""))
    exact = ~query.rlike(r"\s") & ~X.looks_like_regex(query) & X.symbol_of(query).isNotNull()
    glob = F.coalesce(query, path)
    globbed = X.symbol_of(F.regexp_replace(glob, r"[*?\[\]{}]", ""))
    grep_hint = F.when(query.isNull(), "discovery").when(exact, "symbol").when(query.rlike(r"\s"), "concept").otherwise("discovery")
    glob_hint = F.when(glob.isNull() | globbed.isNull(), "structure").otherwise("symbol")
    read_hint = F.coalesce(F.concat(F.lit("after_"), F.col("guided_by")), F.when(X.symbol_of_path(path).isNotNull(), "symbol"), F.lit("discovery"))
    hint = F.when(tool == "Grep", grep_hint).when(tool == "Glob", glob_hint).otherwise(read_hint)
    symbol = F.when(tool == "Grep", F.when(exact, X.symbol_of(query))).when(tool == "Glob", globbed).when(tool == "Read", X.symbol_of_path(path))
    action = F.lit("warn") if policy == "warn" else F.when((tool == "Read") & F.col("guided_by").isNotNull(), "warn").otherwise("block")
    return records.where(F.col("reason_code").isNull() & warned()).select("sid", "seq", "t", action.alias("action"), hint.alias("hint"), symbol.alias("symbol"))


def nudges(records: DataFrame, most: int = 3) -> DataFrame:
    """The first warnings of a session, up to ``most``."""
    rows = decisions(records)
    return rows.withColumn("nudge", F.row_number().over(Window.partitionBy("sid").orderBy("t", "seq")).cast("long")).where(F.col("nudge") <= most).select("sid", "seq", "nudge", "hint")


def coverage(records: DataFrame) -> DataFrame:
    """The nine histograms in one pass over (dimension, value) pairs: dimension, value, n, and of it guided (by extension)."""
    name, c = X.tool_short(F.col("tool")), F.col("category")
    native, read = c == "native", (c == "native") & (name == "Read") & F.col("is_code")
    led = F.col("guided_by").isNotNull()
    sides = {
        "engine_tool": F.when(c == "engine", name), "native_tool": F.when(native, name), "other_tool": F.when(c.isin("admin", "other"), name),
        "guided_by": F.when(read, F.col("guided_by")), "extension": F.when(read, X.path_extension(F.col("path"))), "blind_path": F.when(read & ~led, F.col("path")),
        "grep_selector": F.when(native & (name == "Grep"), F.col("selector")), "glob_selector": F.when(native & (name == "Glob"), F.col("selector")), "reason": F.when(native, F.col("reason_code")),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("value"), led.alias("led")) for k, v in sides.items()))
    rows = records.select(F.inline(pairs)).where("value is not null")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.count_if(F.col("led")).alias("guided"))


def coverage_summary(records: DataFrame) -> DataFrame:
    """Totals of exploration, and of reads of code, with their percentages; no row without records."""
    c, name = F.col("category"), X.tool_short(F.col("tool"))
    read = (c == "native") & (name == "Read") & F.coalesce("is_code", F.lit(False))
    out = records.agg(
        F.count("*").alias("records"), F.count_if(c == "engine").alias("engine"), F.count_if(c == "native").alias("native"), F.count_if(c.isin("admin", "other")).alias("other"),
        F.count_if(read).alias("code_reads"), F.count_if(read & F.col("guided_by").isNotNull()).alias("guided"),
    )
    pct = lambda a, b: F.coalesce(X.round_half_up(F.try_divide(100.0 * a, b)), F.lit(0.0))
    out = out.withColumns({"coverage_pct": pct(F.col("engine"), F.col("engine") + F.col("native")), "blind_pct": pct(F.col("code_reads") - F.col("guided"), F.col("code_reads"))})
    return out.where("records > 0").drop("records")


def guided_share(records: DataFrame) -> DataFrame:
    """Per engine tool: its calls, the reads of code that it guided, and those as a percentage of its calls (null without calls)."""
    counts = coverage(records).where("dimension in ('engine_tool', 'guided_by')")
    out = counts.groupBy(F.col("value").alias("tool")).agg(F.sum(F.when(F.col("dimension") == "engine_tool", F.col("n")).otherwise(0)).alias("calls"), F.sum(F.when(F.col("dimension") == "guided_by", F.col("n")).otherwise(0)).alias("reads"))
    return out.where("reads > 0").withColumn("bounce_pct", X.round_half_up(F.try_divide(100.0 * F.col("reads"), F.col("calls"))))

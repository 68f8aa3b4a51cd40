"""The library's tables, derived from the driver's: tool calls, observed events, chunks, files, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.operators.ingest import sketch
from sparkloom.session import table
from sparkloom.sources.store import spread


def _by(column: Column, cases: dict, otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for k, v in cases.items():
        out = F.when(column == k, v).otherwise(out)
    return out


TOOLS = {"view": "search", "click": "lookup", "purchase": "map", "signup": "context", "error": "status"}


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: the tool's call with what it sent and saved; searches carry metadata, some of it malformed or none."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, sent = F.col("k"), F.floor("value").cast("long")
    s = lambda c: c.cast("string")
    meta = F.concat(
        F.lit('{"query":"q, '), s(k), F.lit('","resultCount":'), s(k % 9), F.lit(',"truncated":'), F.when(k % 2 == 0, "true").otherwise("false"),
        F.lit(',"sources":{"lexical":'), s(k % 3), F.lit(',"vector":'), s(k % 4), F.lit(',"both":'), s(k % 5), F.lit("}}"),
    )
    return e.select(
        F.col("event_id").alias("id"), _by(F.col("event_type"), TOOLS).alias("tool"), F.concat(F.lit("/repo/"), s(F.col("user_id") % 10)).alias("repo_path"),
        F.col("ts").alias("called_at"), (k * 7).alias("duration_ms"), sent.alias("tokens_sent"), (sent * (k % 10)).alias("tokens_raw"),
        F.when(F.col("user_id") % 3 == 0, "mcp").when(F.col("user_id") % 3 == 1, "pi").alias("channel"),
        F.when(F.col("user_id") % 4 == 0, "large").when(F.col("user_id") % 4 == 1, "small").when(F.col("user_id") % 4 == 2, "unknown").alias("model"),
        F.when(k % 13 == 0, None).when(k % 11 == 0, '{"query":').when(F.col("event_type") == "view", meta).otherwise("{}").alias("metadata"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session's hook sees: sid, seq, t (whole hours, so that calls meet at one time), tool, path, query, symbol, chunk_id, start, most."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, kind = F.col("k"), F.col("event_type")
    tool = (
        F.when(kind == "view", F.when(k % 6 == 0, "mcp__engine__engine_status").when(k % 6 == 1, "mcp__engine__map").otherwise("mcp__engine__engine_search"))
        .when(kind == "click", F.when(k % 10 == 0, "pi:read").otherwise("Read"))
        .when(kind == "purchase", F.when(k % 4 == 0, "Glob").otherwise("Grep"))
        .when(kind == "signup", F.when(k % 2 == 0, "pi:engine_lookup").otherwise("mcp__my_engine__source"))
        .when(kind == "error", F.when(k % 3 == 0, "pi:edit").otherwise("Bash"))
    )
    ext = _by(k % 7, {0: ".kt", 1: ".md", 2: "", 3: ".D.TS", 4: ".py", 5: "."}, ".sql")
    stem = _by(k % 5, {0: "UserStore", 1: "index", 2: "user-store"}, "f")
    path = F.concat(F.lit("src/"), stem, F.when(k % 5 > 2, k.cast("string")).otherwise(""), ext)
    searched = _by(k % 6, {0: "UserStore", 1: "how it works", 2: "a.*b", 3: "user_store", 4: "**/*.kt"}, "token")
    return e.select(
        F.col("user_id").alias("sid"), F.col("event_id").alias("seq"), F.date_trunc("hour", "ts").alias("t"), tool.alias("tool"),
        F.when((kind == "click") & (k % 9 > 0), path).when((kind == "purchase") & (k % 3 == 0), path).alias("path"),
        F.when(kind.isin("view", "purchase") & (k % 8 > 0), searched).alias("query"),
        F.when((kind == "signup") & (k % 3 > 0), F.concat(F.lit("S"), (k % 4).cast("string"))).alias("symbol"),
        F.when((kind == "signup") & (k % 2 == 1), F.concat(F.lit("c"), k.cast("string"))).alias("chunk_id"),
        F.when(k % 17 == 0, k).alias("start"), F.when(k % 19 == 0, F.lit(20).cast("long")).alias("most"),
    )


EXTENSIONS = {"de": ".kt", "en": ".ts", "es": ".py", "fr": ".xml"}
KINDS = ("class", "function", "interface", "enum", "viewmodel", "dao", "generic_block")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: repo_path, path, content."""
    path = F.concat("source", F.lit("/src/main/"), F.col("doc_id").cast("string"), _by(F.col("lang"), EXTENSIONS))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", F.concat(F.lit("/repo/"), (F.col("doc_id") % 10).cast("string")).alias("repo_path"), path.alias("path"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str, lines: int = 5) -> DataFrame:
    """Files cut into pieces of so many lines, each row for itself: no shuffle. Blank pieces are none."""
    cut = F.split("content", "\n", -1)
    parts = F.transform(F.sequence(F.lit(0), F.size(cut) - 1, F.lit(lines)), lambda at: F.struct(at.alias("at"), F.slice(cut, at + 1, lines).alias("ls")))
    of_path = {"module": X.module_of(F.col("path")), "source_set": X.source_set_of(F.col("path")), "language": X.classify(F.col("path"))}  # once a file
    pieces = files(spark, sf_dir).withColumns(of_path).select("doc_id", "repo_path", "path", *of_path, F.explode(parts).alias("p"))
    pieces = pieces.select(
        "doc_id", "repo_path", "path", *of_path, F.array_join("p.ls", "\n").alias("text_raw"), (F.col("p.at") + 1).cast("long").alias("start_line"), (F.col("p.at") + F.size("p.ls")).cast("long").alias("end_line")
    ).where(F.length(X.without_spaces(F.col("text_raw"))) > 0)
    named = pieces.withColumns({
        "content_hash": X.content_hash(F.col("text_raw")), "symbol_name": F.nullif(F.regexp_extract("text_raw", "([A-Za-z]+)", 1), F.lit("")),
        "kind": F.element_at(F.array(*map(F.lit, KINDS)), (F.length("text_raw") % len(KINDS) + 1).cast("int")),
    })
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text_raw", F.lit("[A-Z][a-z]{5,}"), F.lit(0))))
    first = X.without_spaces(F.split_part("text_raw", F.lit("\n"), F.lit(1)))
    return named.select(
        X.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content_hash")).alias("id"), "doc_id", "repo_path", "path", "module", "source_set",
        "language", "kind", "symbol_name", F.concat_ws(".", F.substring("module", 2, 99), "symbol_name").alias("symbol_fqname"), F.when(first != "", F.substring(first, 1, 60)).alias("signature"), "start_line", "end_line", "text_raw",
        F.array_compact(F.array("language", F.when(F.length("text_raw") > 400, "Long"), F.when(F.col("text_raw").contains("|"), "table"))).alias("tags"),
        F.array_distinct(F.regexp_extract_all("text_raw", F.lit("@[A-Za-z0-9.]+"), F.lit(0))).alias("annotations"), names.alias("uses"), "content_hash",
    ).withColumn("text_sketch", sketch(F.col("kind"), F.col("text_raw"), F.col("signature"), F.col("annotations")))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches: every turn of the conversations whose id is divisible by 50, as qid, query, and the vector of that id, where there is one."""
    turns = table(spark, sf_dir, "conversations").where("conv_id % 50 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"), F.col("conv_id").alias("vec_id"))
    return turns.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "left").select("qid", "query", "embedding")


def chunk_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """A vector to every chunk of a document that has one of its id: id, embedding."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunks.select("id", "doc_id").join(v, "doc_id").select("id", "embedding")

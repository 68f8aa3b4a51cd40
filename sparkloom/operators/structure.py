"""Structural queries over chunks: definitions, usages, sources, dependencies, maps, profiles, and upkeep of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.operators.ingest import sketched
from sparkloom.operators.search import small
from sparkloom.sources.store import stored

#: Kinds whose symbols a module's summary names, and how many.
NAMED_KINDS, TOP_SYMBOLS = ("class", "object", "viewmodel", "api_interface", "dao", "entity"), 20
#: A profile's chunks, its most frequent annotations, tags and uses, its examples and their tokens.
SAMPLE, TOP, TOP_USES, EXAMPLES, EXAMPLE_TOKENS = 20, 5, 10, 3, 500


def defines(symbol: Column | str) -> Column:
    """Whether a chunk defines a symbol: its name, or the end of its qualified name in any case."""
    s = F.lit(symbol) if isinstance(symbol, str) else symbol
    return (F.col("symbol_name") == s) | F.lower("symbol_fqname").endswith(F.lower(s))


def definitions(chunks: DataFrame, symbol: str) -> DataFrame:
    return chunks.where(defines(symbol)).select("id", "path", "kind", "symbol_name", "signature", "module", F.concat_ws("-", "start_line", "end_line").alias("lines"))


def usages(chunks: DataFrame, symbol: str, most: int | None = None) -> DataFrame:
    """Chunks that use the symbol by name, and those whose text holds its terms in a row, ``most`` of these at most (by path and line); the tag says which came first."""
    other = F.col("symbol_name") != symbol
    named = F.exists("uses", lambda u: F.lower(u) == symbol.lower()) & other
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    held = spaced(X.terms_of(F.col("text_raw"))).contains(spaced(X.terms_of(F.lit(symbol)))) & other
    rows = chunks.where(named | held).select("id", "path", "start_line", F.when(named, "uses").otherwise("text").alias("via"))
    if most is not None:
        rows = rows.where("via = 'uses'").unionByName(rows.where("via = 'text'").orderBy("path", "start_line", "id").limit(most))
    return rows.drop("start_line")


def sources(chunks: DataFrame, files: DataFrame, symbol: str | None, before: int, after: int, chunk_id: str | None = None) -> DataFrame:
    """A chunk by its id, or those that define a symbol, with the lines of their file before and after them; blank surroundings are null."""
    if not symbol and not chunk_id:
        raise ValueError("a symbol or a chunk's id is needed")
    before, after = max(0, before), max(0, after)
    found = chunks.where(F.col("id") == chunk_id if chunk_id else defines(symbol))
    found = stored(found.select("id", "repo_path", "path", "kind", "symbol_name", "start_line", "end_line", "text_raw"))
    wanted = small(stored(found.select("repo_path", "path").distinct()))  # the other files' texts stay where they lie
    held = files.select("repo_path", "path", "content").join(wanted, ["repo_path", "path"], "left_semi").dropDuplicates(["repo_path", "path"])
    found = found.join(held, ["repo_path", "path"]).withColumn("ls", F.split("content", "\\r?\\n", -1))
    first = F.greatest(F.lit(1), F.col("start_line") - before).cast("int")
    around = lambda at, n: F.array_join(F.slice("ls", at.cast("int"), F.greatest(n, F.lit(0)).cast("int")), "\n")
    shown = lambda x: F.when(X.strip(x) != "", x)
    return found.select(
        "id", "path", "kind", "symbol_name", F.concat_ws("-", "start_line", "end_line").alias("lines"), F.col("text_raw").alias("source"),
        shown(around(first, F.col("start_line") - first)).alias("before"), shown(around(F.col("end_line") + 1, F.lit(after))).alias("after"),
    )


def forward(chunks: DataFrame, symbol: str) -> DataFrame:
    """What the symbol's definitions use, among the symbols of the table: symbol_name, path, kind, module."""
    used = chunks.where(defines(symbol)).select(F.explode("uses").alias("symbol_name")).distinct()
    return chunks.select("symbol_name", "path", "kind", "module").join(used, "symbol_name", "left_semi").distinct()


def reverse(chunks: DataFrame, symbol: str) -> DataFrame:
    """The chunks that use the symbol, in any case: symbol_name, path, kind, module."""
    used = F.exists("uses", lambda u: F.lower(u) == symbol.lower()) & (F.col("symbol_name") != symbol)
    return chunks.where(used).select("symbol_name", "path", "kind", "module").distinct()


def dependency_counts(chunks: DataFrame) -> DataFrame:
    """Forward and reverse degree of every symbol over one-hop edges to defined symbols."""
    defined = chunks.select(F.lower("symbol_name").alias("used")).distinct()
    links = chunks.select(F.lower("symbol_name").alias("symbol"), F.explode("uses").alias("used")).select("symbol", F.lower("used").alias("used"))
    links = links.where("symbol <> used").distinct().join(defined, "used", "left_semi")
    both = links.select(F.col("symbol").alias("s"), F.lit(1).alias("f"), F.lit(0).alias("r")).unionAll(links.select("used", F.lit(0), F.lit(1)))
    return both.groupBy(F.col("s").alias("symbol")).agg(F.sum("f").alias("forward"), F.sum("r").alias("reverse"))


def module_summary(chunks: DataFrame) -> DataFrame:
    """Per module: files, chunks, tokens, languages with their chunks, and the first symbols of its main kinds by kind and name."""
    rows = chunks.where("module is not null")
    per = rows.groupBy("module").agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), F.sum(X.token_estimate(F.col("text_raw"))).alias("tokens"))
    spoken = rows.groupBy("module", "language").agg(F.count("*").alias("n"))
    spoken = spoken.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "language", "n"))), ",").alias("languages"))
    place = F.row_number().over(Window.partitionBy("module").orderBy("kind", "symbol_name", "id"))
    named = rows.where(F.col("kind").isin(*NAMED_KINDS) & F.col("symbol_name").isNotNull()).select("module", "symbol_name", place.alias("p")).where(F.col("p") <= TOP_SYMBOLS)
    named = named.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("p", "symbol_name"))).alias("x"))
    names = F.array_join(F.transform("x", lambda x: x["symbol_name"]), ",").alias("symbols")
    return per.join(spoken, "module").join(named.select("module", names), "module", "left")


def file_summary(chunks: DataFrame) -> DataFrame:
    """Per file: its language, chunks, and their symbols by line; null where no chunk has one."""
    named = F.array_sort(F.collect_list(F.when(F.col("symbol_name").isNotNull(), F.struct("start_line", "symbol_name"))))
    names = F.when(F.count("symbol_name") > 0, F.array_join(F.transform(named, lambda x: x["symbol_name"]), ","))
    return chunks.groupBy("path").agg(F.min("language").alias("language"), F.count("*").alias("chunks"), names.alias("symbols"))


def tree(chunks: DataFrame) -> DataFrame:
    """Every directory and file prefix with its depth, distinct files below and chunks."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    per_file = chunks.groupBy("path").agg(F.count("*").alias("n"))
    rows = per_file.select("n", F.size(parts).alias("size"), F.posexplode(prefixes).alias("depth", "prefix"))
    return rows.groupBy("prefix", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("files"), F.sum("n").alias("chunks"), F.max((F.col("size") == F.col("depth") + 1)).alias("is_file"))


def tree_lines(chunks: DataFrame, most_depth: int = 3) -> DataFrame:
    """The map's lines down to a depth: a directory at the depth says how many files are below it, a file its chunks."""
    name = F.element_at(F.split("prefix", "/"), -1)
    rows = tree(chunks).where(F.col("depth") < most_depth)
    cut = (F.col("depth") == most_depth - 1) & ~F.col("is_file")
    text = F.when(cut, F.concat(name, F.lit("/ ("), F.col("files"), F.lit(" files)"))).when(F.col("is_file"), F.concat(name, F.lit(" ("), F.col("chunks"), F.lit(" chunks)"))).otherwise(name)
    return rows.select("prefix", "depth", "is_file", text.alias("line"))


def tree_text(chunks: DataFrame, most_depth: int | None = None) -> DataFrame:
    """The map as text, a line a row in order: repo_path, place, depth (from 1), prefix, line.

    Directories come before files, either by code point; ``place`` (directory or file, and
    name, of each level) sorts the whole map at once, children behind their parents. A
    directory below ``most_depth`` levels is one line with the files that it holds.
    """
    parts = F.split("path", "/")
    per_file = chunks.groupBy("repo_path", "path").agg(F.count("*").alias("n"))
    level = lambda i: F.named_struct(F.lit("file"), (i == F.size(parts)).cast("int"), F.lit("name"), F.element_at(parts, i))
    deepest = F.size(parts) if most_depth is None else F.least(F.size(parts), F.lit(most_depth + 1))
    rows = per_file.select("repo_path", "n", F.transform(F.sequence(F.lit(1), F.size(parts)), level).alias("place"), F.explode(F.sequence(F.lit(1), deepest)).alias("depth"))
    rows = stored(rows.groupBy("repo_path", F.slice("place", F.lit(1), F.col("depth")).alias("place")).agg(F.count("*").alias("files"), F.sum("n").alias("chunks")))  # read thrice
    parent = F.slice("place", F.lit(1), F.size("place") - 1)
    last = rows.groupBy("repo_path", parent.alias("parent")).agg(F.max(F.element_at("place", -1)).alias("last"))
    # Whether the node and each of its ancestors are the last of their directory: a row a level.
    levels = rows.select("repo_path", "place", "files", "chunks", F.explode(F.sequence(F.lit(1), F.size("place"))).alias("i"))
    levels = levels.withColumn("parent", F.slice("place", F.lit(1), F.col("i") - 1)).join(last, ["repo_path", "parent"])
    ends = levels.groupBy("repo_path", "place").agg(F.first("files").alias("files"), F.first("chunks").alias("chunks"), F.array_sort(F.collect_list(F.struct("i", (F.get("place", F.col("i") - 1) == F.col("last")).alias("end")))).alias("ends"))
    indent = F.array_join(F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: F.when(e["end"], "    ").otherwise("│   ")), "")
    own = F.element_at("place", -1)
    deep = F.lit(False) if most_depth is None else F.size("place") > most_depth
    text = F.when(own["file"] == 1, F.concat(own["name"], F.lit(" ("), F.col("chunks"), F.lit(" chunks)"))).when(deep, F.concat(own["name"], F.lit("/ ("), F.col("files"), F.lit(" files)"))).otherwise(own["name"])
    line = F.concat(indent, F.when(F.element_at("ends", -1)["end"], "└── ").otherwise("├── "), text)
    out = ends.select("repo_path", "place", F.size("place").cast("long").alias("depth"), F.array_join(F.transform("place", lambda x: x["name"]), "/").alias("prefix"), line.alias("line"))
    return out.orderBy("repo_path", "place")


def index_totals(chunks: DataFrame) -> DataFrame:
    """Per repository: chunks, files, tokens that a map of all sketches takes, and whether there is anything."""
    return chunks.groupBy("repo_path").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"), F.ceil(F.sum(F.length("text_sketch")) / 4).cast("long").alias("map_tokens"), F.lit("healthy").alias("health"))


def health(chunks: DataFrame, repo: str) -> DataFrame:
    """healthy if the repository has any chunk, else empty; stops at the first."""
    some = chunks.where(F.col("repo_path") == repo).limit(1).agg(F.count("*").alias("n"))
    return some.select(F.lit(repo).alias("repo_path"), F.when(F.col("n") > 0, "healthy").otherwise("empty").alias("health"))


def sample(chunks: DataFrame) -> DataFrame:
    """The newest chunks of every kind, with their place; ties go by path and line."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("doc_id"), "path", "start_line"))
    return chunks.withColumn("place", place.cast("long")).where(F.col("place") <= SAMPLE)


def profile(chunks: DataFrame) -> DataFrame:
    """Per kind, over its sample: the most frequent annotations, tags and uses, in the order in which they are met where equal: kind, what, rank, name, n."""

    def named(c: str) -> Column:
        return F.transform(c, lambda x, k: F.struct(F.lit(c).alias("what"), x.alias("name"), k.alias("k")))

    sides = [named(c) for c in ("annotations", "tags", "uses")]
    rows = sample(chunks).select("kind", "place", F.inline(F.concat(*sides)))
    counts = rows.groupBy("kind", "what", "name").agg(F.count("*").alias("n"), F.min(F.struct("place", "k")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("kind", "what").orderBy(F.desc("n"), "first")).cast("long")
    most = F.when(F.col("what") == "uses", TOP_USES).otherwise(TOP)
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("kind", "what", "rank", "name", "n")


def examples(chunks: DataFrame) -> DataFrame:
    """Per kind the sketches that fit the examples' budget: those that would not fit are passed over, not the end."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def take(s: Column, x: Column) -> Column:
        fits = (F.size(s["ids"]) < EXAMPLES) & (s["used"] + x["tokens"] <= EXAMPLE_TOKENS)
        return F.struct(F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["ids"], F.array(x["id"]))).otherwise(s["ids"]).alias("ids"))

    rows = sketched(sample(chunks)).withColumn("tokens", X.token_estimate(F.col("text_sketch")))
    listed = rows.groupBy("kind").agg(F.count("*").alias("sampled"), F.sum(X.token_estimate(F.col("text_raw"))).alias("tokens_raw"), F.array_sort(F.collect_list(F.struct("place", "id", "tokens"))).alias("x"))
    done = listed.withColumn("s", F.aggregate("x", state, take))
    return done.select("kind", "sampled", "tokens_raw", F.array_join("s.ids", ",").alias("ids"), F.col("s.used").alias("used"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, changed and deleted keys between two (path, content_hash) snapshots."""
    both = old.select("path", F.col("content_hash").alias("a")).join(new.select("path", F.col("content_hash").alias("b")), "path", "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("changed")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", kind.alias("change"))


def applied(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after the changes: rows of changed and deleted paths go, rows of added and changed ones come from ``new``."""
    kept = old.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(new.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi").select(kept.columns))


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``new`` over the rows of ``old`` with other keys."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def without(table: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is not in ``gone``; by path, repository or id."""
    return table.join(gone.select(*key).distinct(), list(key), "left_anti")


def latest(rows: DataFrame, order: str, *key: str) -> DataFrame:
    """The last row of every key; aggregated before the shuffle, so a key of any size is one row a task."""
    names = rows.columns
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(order, F.xxhash64(*names))).alias("_r")).select("_r.*")

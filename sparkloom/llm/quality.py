"""Quality rules: per-text counts, and lines that recur across a host's documents.

Built of DataFrame functions alone. A line is normalised (lower case, digits to 0,
white space to one space) and hashed; per host the distinct documents that hold it
are counted. Lines above the host's limit are removed, and a document that loses
most of its words that way is rejected as depleted. Texts are split into lines once,
into a table without the lines' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NOT_WS, WS, at_most, durable, names_beside, without_lines, words

#: Salts over which one line's occurrences are dealt where the frequent lines are too many to broadcast.
SALTS = 64
SMALL = 200_000


def repeat_words(grams: Column) -> Column:
    """Words inside windows found twice or more, from the sorted (hash, place) of all 3-word windows."""
    same = lambda x, k: F.coalesce(F.get(grams, k)["h"] == x["h"], F.lit(False))
    twice = F.filter(grams, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def host() -> Column:
    """The source as a key; null is a host of its own."""
    return F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), and the per-text counts of every row."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("x"))
    out = out.withColumn("th", F.xxhash64("x")).withColumn("ws", words(F.col("x")))
    out = out.withColumn(
        "lines", F.filter(F.split("x", "\n", -1), lambda line: line.rlike(NOT_WS))
    ).withColumn(
        "grams",
        F.transform(
            F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("ws", i + 1), F.get("ws", i + 2)),
        ),
    )
    out = out.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    out = out.withColumn("places", repeat_words(F.col("sorted")))
    covered = F.aggregate(
        F.transform("places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1), x + 3) - x)), F.lit(0), lambda a, b: a + b
    )
    return out.select(
        "doc_id", "th",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("x", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_rows(docs: DataFrame) -> DataFrame:
    """A row per line that has a word: doc_id, host, th, pos, lh (hash of the normalised line), lw (its words)."""
    lines = docs.select("doc_id", host().alias("host"), text_hash().alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(NOT_WS))
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower("line"), f"{WS}+", " ")), "[0-9]", "0")
    return lines.select("doc_id", "host", "th", "pos", F.xxhash64(plain).alias("lh"), F.size(words(F.col("line"))).alias("lw"))


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int, percent: int, max_docs: int) -> DataFrame:
    """(host, lh) of the lines on more documents than the host's limit: ``percent`` of them, within ``min_docs`` and ``max_docs``.

    Documents are counted by content: copies of one text in a host count once, so a
    document that is merely copied often does not turn its own lines into boilerplate.
    """
    per_line = lines.groupBy("host", "lh", "th").agg(F.lit(1).alias("one")).groupBy("host", "lh").agg(F.count("*").alias("n_docs"))
    per_line = per_line.where(F.col("n_docs") > min_docs)
    per_host = docs.select(host().alias("host"), text_hash().alias("th")).groupBy("host", "th").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(min_docs), F.least(F.lit(max_docs), F.floor(F.col("host_docs") * percent / 100)))
    return per_line.join(per_host, "host").where(F.col("n_docs") > limit).select("host", "lh")


def removed_lines(docs: DataFrame, min_docs: int, percent: int, max_docs: int) -> DataFrame:
    """The line rows to remove, once per document and place: doc_id, th, pos, lw."""
    lines = durable(line_rows(docs))
    frequent = durable(frequent_lines(lines, docs, min_docs, percent, max_docs))
    if at_most(frequent, SMALL):
        found = lines.join(F.broadcast(frequent), ["host", "lh"], "left_semi")
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.withColumn("salt", F.pmod(F.hash("doc_id", "th"), F.lit(SALTS))).join(salted, ["host", "lh", "salt"], "left_semi")
    return found.select("doc_id", "th", "pos", "lw").distinct()


def judged(docs: DataFrame, lost: DataFrame, depleted: int, min_words: int, max_repeat: int) -> DataFrame:
    """The counts of every row of ``docs``, and the verdict, from the lines that go."""
    lost = lost.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.count("*").alias("removed_lines"), F.sum("lw").alias("removed_words"))
    counts = base_counts(docs)
    out = counts.join(lost, counts.doc_id.eqNullSafe(lost.d) & (counts.th == lost.t), "left").drop("d", "t")
    zero = F.lit(0).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return (
        out.withColumns({"removed_lines": F.coalesce("removed_lines", zero), "removed_words": F.coalesce("removed_words", zero)})
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * F.col("removed_words") <= depleted * F.col("n_words")))
    )


def quality(docs: DataFrame, min_docs: int = 5, percent: int = 2, max_docs: int = 20, depleted: int = 50, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Counts and verdict per row of ``docs`` (doc_id, text, source).

    Returns doc_id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under ``min_words`` words, or over ``max_repeat`` percent of words in
    repeated windows), removed_lines, removed_words, kept. A line is removed where more
    of its host's different texts hold it than ``percent`` of them; that limit is
    ``min_docs`` at least and ``max_docs`` at most, so the same line goes from large hosts
    too. Kept is false if base_failed or if over ``depleted`` percent of the words stand
    in removed lines. Null and empty texts have zero counts and fail; null sources are
    one host; repeated rows get equal results and count as one document; a null doc_id
    is a value like others. An empty table gives an empty result. Other columns are not read.
    """
    return judged(docs, removed_lines(docs, min_docs, percent, max_docs), depleted, min_words, max_repeat)


def clean(docs: DataFrame, min_docs: int = 5, percent: int = 2, max_docs: int = 20, depleted: int = 50, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, without the removed lines.

    Limits, nulls, repeated rows and the empty table as in ``quality``: null and empty
    texts go, equal rows stay or go together, a line goes at all its places. ``n_chars``,
    where it is a column, follows the new text of rows that lose lines. Other columns are
    handed on as they are, whatever their names.
    """
    d, t, lost = names_beside(docs, "d", "t", "lost")
    gone = durable(removed_lines(docs, min_docs, percent, max_docs))
    kept = durable(judged(docs, gone, depleted, min_words, max_repeat)).where("kept").select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    places = gone.groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("t2")).agg(F.collect_list("pos").alias(lost))
    marks = durable(kept.join(places, F.col(d).eqNullSafe(F.col("d2")) & (F.col(t) == F.col("t2")), "left").select(d, t, lost))
    out = docs.join(marks, docs["doc_id"].eqNullSafe(marks[d]) & (text_hash() == marks[t]))
    whole = F.col(lost).isNull()
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(without_lines(F.col("text"), F.col(lost))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*[f"`{c}`" for c in docs.columns])

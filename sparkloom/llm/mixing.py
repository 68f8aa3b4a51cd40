"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal size (``block`` words) are numbered; slot i takes the golden-ratio
point frac((i + 1) * 0.618...), which the cumulative target shares map to a source,
so that every stretch of slots holds the sources nearly in proportion. The r-th
slot of a source takes the r-th block of that source's stream: its documents in a
seeded shuffled order, one after the other, up to ``repeats`` times over. A source
ends with the block in which its target is reached, which is cut there; slots beyond
that stay empty, and the few blocks for which the points left no slot follow at the end.

Prefix sums over a source are made in two levels (hash-range buckets, then the
buckets' offsets), as one source may hold most rows; slots are ranked likewise in
chunks. No step gathers a source in a task. Tables with a row per source are the
only ones that pass a window without a partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import NOT_WS, WS, durable, let, names_beside, words

#: White space between words, as trimming takes it.
SPACES = " \t\n\x0b\x0c\r"

#: floor(2**31 / golden ratio), made odd: (i * GOLDEN) mod 2**31 walks the golden-ratio points in integers.
GOLDEN = 1327217885
POINTS = 2**31
#: Cells of [0, 1) in which points and sources' intervals meet.
CELLS = 4096
#: Words in one file of the mixed texts, at least and at most: the least where that gives no more files than the cluster has cores four times over.
FILE_WORDS = (2**20, 2**24)


def source_plan(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """A row per source: src, source_size, target, lo, hi (its interval of the cumulative shares), total.

    Sources by code point, null last, get the weights in turn and share all words by
    weight; a target stops at ``repeats`` times its source's size, and what is above
    goes to the others by weight. In order of size / weight the sources that stop come
    first, so running sums give the level at which the others are served.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    all_rows = Window.partitionBy()
    by_name, by_ratio = all_rows.orderBy("src"), all_rows.orderBy("ratio", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", repeats * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / F.col("rest_w"))
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(all_rows))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.lit(0.0))))
    )
    share = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    everything = F.sum("target").over(all_rows)
    return per.withColumn("hi", F.coalesce(F.try_divide(share, everything), F.lit(0.0))).select(
        "src", "source_size", "target", "total", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)).alias("lo"), "hi"
    )


def schedule(plan: DataFrame, slots: int, block: int) -> DataFrame:
    """Filled slots with their source and their rank in it: slot, src, rank (from 0)."""
    spark = plan.sparkSession
    chunk = max(1024, math.isqrt(slots))
    cell = lambda x: F.floor(x * CELLS).cast("long")
    spans = plan.where("hi > lo").select("src", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 1) % POINTS) * GOLDEN % POINTS / POINTS).alias("u"))
    dealt = (
        points.withColumn("cell", cell(F.col("u")))
        .join(spans, "cell")
        .where("u >= lo and u < hi")
        .select("slot", "src", F.floor(F.col("slot") / chunk).alias("chunk"))
        .withColumn("r", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")))
    )
    dealt = durable(dealt)
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = durable(dealt.groupBy("src", "chunk").count())
    offsets = sizes.select("src", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    blocks = plan.select("src", F.ceil(F.round("target") / block).cast("long").alias("blocks"))
    ranked = dealt.join(offsets, ["src", "chunk"]).select("slot", "src", (F.col("offset") + F.col("r") - 1).alias("rank"))
    ranked = ranked.join(blocks, "src").where("rank < blocks").drop("blocks")
    left = blocks.join(sizes.groupBy("src").agg(F.sum("count").alias("served")), "src", "left").withColumn("served", F.coalesce("served", F.lit(0)))
    left = left.where("served < blocks").withColumn("before", F.sum(F.col("blocks") - F.col("served")).over(Window.partitionBy().orderBy("src").rowsBetween(Window.unboundedPreceding, -1)))
    tail = left.select("src", "served", F.coalesce("before", F.lit(0)).alias("before"), F.explode(F.sequence("served", F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(tail.select((slots + F.col("before") + F.col("rank") - F.col("served")).alias("slot"), "src", "rank"))


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns: rows that agree in it and in doc_id are copies, and any of them may stand for any other."""
    return F.xxhash64(*(F.to_json(F.struct(f"`{c}`")) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes))


def placed(docs: DataFrame, seed: int) -> DataFrame:
    """A row per row of ``docs``: doc_id, rk (its key), copy (number among its equals), src, size, at (its place in the shuffled order)."""
    rows = docs.select(
        "doc_id", row_key(docs).alias("rk"), F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("src"), F.size(words(F.col("text"))).cast("long").alias("size")
    )
    counted = rows.groupBy("doc_id", "rk", "src", "size").agg(F.count("*").alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    return each.withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "rk", "copy"))


def scheduled(docs: DataFrame, weights: tuple[int, ...], repeats: int, block: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as rows of word ranges, the sizes of all rows, and the plan of the sources.

    The first has slot, src, rank, doc_id, rk, copy, size, round (from 0), from_word and
    to_word (end exclusive), p (place in the source's stream).
    """
    sizes = durable(placed(docs, seed))
    plan = durable(source_plan(sizes, weights, repeats))
    total = (plan.agg(F.max("total")).first()[0]) or 0
    bits = max(8, math.ceil(math.log2(max(1, sizes.count()) / 20_000)))
    slots = durable(schedule(plan, total // block, block))

    bucket = F.shiftright("at", 64 - bits)
    inside = Window.partitionBy("src", "b").orderBy("at", "doc_id", "rk", "copy")
    start = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    before = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.groupBy("src", bucket.alias("b"))
        .agg(F.sum("size").alias("words"))
        .select("src", "b", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
        .join(plan.select("src", "source_size", F.round("target").cast("long").alias("wanted")), "src")
    )
    pieces = (
        sizes.where("size > 0").withColumn("b", bucket).withColumn("start", start)
        .join(offsets, ["src", "b"])
        .withColumn("p", F.col("offset") + F.col("start"))
        .where("p < wanted")
        .withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(wanted - 1 - p) div source_size"))))
        .withColumn("p", F.col("p") + F.col("round") * F.col("source_size"))
        .withColumn("end", F.least(F.col("p") + F.col("size"), F.col("wanted")))
        .withColumn("rank", F.explode(F.sequence(F.expr(f"p div {block}"), F.expr(f"(end - 1) div {block}"))))
        .withColumn("from_word", F.greatest(F.col("rank") * block - F.col("p"), F.lit(0)))
        .withColumn("to_word", F.least(F.col("end"), (F.col("rank") + 1) * block) - F.col("p"))
    )
    mix = pieces.join(slots, ["src", "rank"]).select("slot", "src", "rank", "doc_id", "rk", "copy", "size", "round", "from_word", "to_word", "p")
    return mix, sizes, plan


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, block: int = 1024, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns a row per row of ``docs`` (doc_id, text, source): doc_id, src, size,
    source_size, target, taken. Size counts the words; null and empty texts have none
    and give none. ``block`` is the words in a slot, whatever the input; a source's last
    slot holds what is left of its target, so it takes its target to the word.
    Repeated rows and rows with a null doc_id are documents of their own, null sources
    one source, an empty table gives an empty result; other columns are not read.
    The order of a source's documents depends on their rows and ``seed`` alone; equal rows are told apart by a number.
    """
    pieces, sizes, plan = scheduled(docs.select("doc_id", "text", "source"), weights, repeats, block, seed)
    taken = pieces.groupBy(F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.col("copy").alias("c")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = sizes.join(taken, sizes.doc_id.eqNullSafe(taken.d) & (F.col("rk") == F.col("r")) & (F.col("copy") == F.col("c")), "left")
    return rows.join(plan.select("src", "source_size", "target"), "src").select("doc_id", "src", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def is_cut(piece: Column) -> Column:
    """Whether a piece (low, high: its words; size: the text's) is less than its text."""
    return (piece["low"] > 0) | (piece["high"] < piece["size"])


def shown(piece: Column, text: Column) -> Column:
    return F.struct(piece["slot"].alias("slot"), piece["p"].alias("p"), is_cut(piece).alias("cut"), text.alias("text"))


def cut_texts(text: Column, pieces: Column) -> Column:
    """The pieces of a text that has words, each with the white space before its words, and the last one with what follows."""
    ends = F.substring(text, F.length(F.rtrim(text, F.lit(SPACES))) + 1, F.length(text))

    def cut(words: Column) -> Column:
        own = lambda x: F.array_join(F.slice(words, x["low"] + 1, x["high"] - x["low"]), "")
        return F.transform(pieces, lambda x: shown(x, F.when(~is_cut(x), text).otherwise(F.concat(own(x), F.when(x["high"] == x["size"], ends).otherwise("")))))

    return let(F.regexp_extract_all(text, F.lit(f"{WS}*{NOT_WS}+"), F.lit(0)), cut)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, block: int = 1024, seed: int = 7) -> DataFrame:
    """The mix itself, in slot order: the columns of ``docs``, a row per document and slot with that slot's share of the text.

    The words of ``mix`` and no others, each with the white space before it (and the last
    one of a text with what follows); a document within one slot stands there unchanged.
    ``n_chars``, where it is a column, follows the piece. Texts without words are in no
    slot. Rows, nulls and empty tables as in ``mix``; other columns are handed on, whatever
    their names. Each file holds stretches of the schedule, in order.
    """
    d, r, slot, p, parts = names_beside(docs, "d", "r", "slot", "p", "parts")
    pieces, _, plan = scheduled(docs, weights, repeats, block, seed)
    pieces = durable(pieces)
    total = plan.agg(F.sum(F.round("target"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(1, math.ceil(total / FILE_WORDS[1]), min(math.ceil(total / FILE_WORDS[0]), 4 * cores))
    # Of equal rows one is enough, as the pieces number them.
    keyed = docs.withColumn(r, row_key(docs))
    again = durable(keyed.groupBy(F.col("doc_id").alias(d), r).count().where("count > 1").drop("count").withColumnRenamed(r, p))
    if not again.isEmpty():
        same = keyed["doc_id"].eqNullSafe(again[d]) & (keyed[r] == again[p])
        keyed = keyed.join(again, same, "left_anti").unionByName(keyed.join(again, same, "left_semi").dropDuplicates(["doc_id", r]))
    piece = F.struct("slot", "p", "size", F.col("from_word").cast("int").alias("low"), F.col("to_word").cast("int").alias("high"))
    of_row = pieces.groupBy(F.col("doc_id").alias(d), F.col("rk").alias(p), "copy").agg(F.collect_list(piece).alias(parts)).drop("copy")
    out = keyed.join(of_row, keyed["doc_id"].eqNullSafe(of_row[d]) & (keyed[r] == of_row[p]))
    n_slots = (pieces.agg(F.max("slot")).first()[0] or 0) + 1
    # A text is split into its words once, for all of its pieces, and not at all where each is the whole.
    out = out.withColumn(parts, F.explode(F.when(F.exists(parts, is_cut), cut_texts(F.col("text"), F.col(parts))).otherwise(F.transform(parts, lambda x: shown(x, F.col("text"))))))
    changed = {"text": F.col(f"{parts}.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(f"{parts}.cut"), F.length(f"{parts}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    out = out.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns), F.col(f"{parts}.slot").alias(slot), F.col(f"{parts}.p").alias(p))
    ordered = out.repartition(files, F.floor(F.col(slot) * files / n_slots)).sortWithinPartitions(slot, p)
    return ordered.drop(slot, p)

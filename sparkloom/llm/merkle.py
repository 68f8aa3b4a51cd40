"""Merkle manifest of a corpus: every row's digest, and the proof that it lies under the root.

Trees are built in blocks of 2**STEP nodes: a block folds up to STEP levels at once and
every member holds the sibling segment towards the block's root, its nearest ancestor.
Then pointer jumping: joining the nodes with themselves on the ancestor doubles the
distance that a segment covers, until every leaf's segment ends at the root. Siblings
are 33 bytes each, the side (0: left of the node) and the digest; a node without
sibling has an empty entry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import SMALL, at_most, durable, let, maybe_broadcast, numbered

#: Levels that a block folds, and nodes with their segments up to which they go to all tasks.
STEP, NODES = 8, 20_000
#: The tree above all trees: its leaves are their roots.
TOP = -1


def field(value: Column) -> Column:
    """A value in a leaf's input: its UTF-8 length, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with 2**h >= n."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def parents(nodes: Column) -> Column:
    """The level above: the hash of every two digests, and of a last one alone."""
    pair = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def fold(digest: Column, siblings: Column) -> Column:
    """The root that a digest and its siblings give."""

    def up(low: Column, s: Column) -> Column:
        other = F.lower(F.hex(F.substring(s, 2, 32)))
        left = F.substring(s, 1, 1) == F.unhex(F.lit("00"))
        return F.sha2(F.when(F.octet_length(s) == 0, low).when(left, F.concat(other, low)).otherwise(F.concat(low, other)), 256)

    return F.aggregate(siblings, digest, up)


def blocks(nodes: DataFrame, base: int) -> DataFrame:
    """One step of building: nodes (tree, place, total, digest, row) to blocks (tree, block, total, levels, root, members).

    A member has place, row and segment. ``levels`` is how many the block folded.
    """
    at = F.array_sort(F.collect_list(F.struct("place", "digest", "row")))
    grouped = nodes.groupBy("tree", F.shiftright("place", STEP).alias("block")).agg(F.first("total").alias("total"), at.alias("nodes"))
    grouped = grouped.withColumn("levels", F.least(F.lit(STEP), height(F.col("total"))))
    numbers = F.array(*map(F.lit, range(STEP)))
    above = F.aggregate(F.slice(numbers, 1, F.col("levels")), F.array(F.col("nodes.digest")), lambda got, _: let(F.element_at(got, -1), lambda top: F.concat(got, F.array(parents(top)))))

    def member(folded: Column) -> Column:
        def segment(i: Column) -> Column:
            def sibling(k: Column) -> Column:
                own = F.call_function("shiftright", i, k)
                digest = F.get(F.get(folded, k), own.bitwiseXOR(F.lit(1)))
                side = F.when(own.bitwiseAND(F.lit(1)) == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
                return F.coalesce(F.concat(side, F.unhex(digest)), F.unhex(F.lit("")))

            return F.transform(F.slice(numbers, 1, F.col("levels")), sibling)

        members = F.transform("nodes", lambda x, i: F.struct(x["place"].alias("place"), x["row"].alias("row"), segment(i).alias("segment")))
        return F.struct(F.get(F.get(folded, F.col("levels")), 0).alias("root"), members.alias("members"))

    return durable(grouped.select("tree", "block", "total", "levels", let(above, member).alias("f")).select("tree", "block", "total", "levels", "f.root", "f.members"))


def forest(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Trees over nodes (tree, place, total, digest, row), the largest of ``most`` leaves.

    Returns the leaves' hops, the roots (tree, root), the inner nodes' hops if any, and
    the hops from a leaf to its root. A hop is tree, base, place, row, segment and the
    ancestor at its end (up_tree, up_base, up_place); above a tree's root lies its place
    in the top tree, above that one's nothing (null).
    """
    hops, roots, base = [], [], 0
    while True:
        made = blocks(nodes, base)
        last = height(F.col("total")) <= STEP
        inner = F.col("tree") == TOP
        up = [F.when(~last, F.col("tree")).when(~inner, F.lit(TOP)), F.when(last, 0).otherwise(base + 1), F.when(last, F.col("tree")).otherwise(F.col("block"))]
        rows = made.select("tree", *(u.cast("long").alias(n) for u, n in zip(up, ("up_tree", "up_base", "up_place"), strict=True)), F.inline("members"))
        hops.append(rows.select("tree", F.lit(base).cast("long").alias("base"), "place", "row", "segment", "up_tree", "up_base", "up_place"))
        roots.append(made.where(last).select("tree", "root"))
        base += 1
        if most <= 2**STEP:
            break
        most = math.ceil(most / 2**STEP)
        total = F.ceil(F.col("total") / 2**STEP)
        nodes = made.where(~last).select("tree", F.col("block").alias("place"), total.alias("total"), F.col("root").alias("digest"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    inner = None
    for h in hops[1:]:
        inner = h if inner is None else inner.unionByName(h)
    return hops[0], durable(out), inner, base


def jump(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with their ancestors' segments behind their own, and the ancestors' ancestors in their place.

    Rows that reached the root join nothing and are spread by hash.
    """
    there = F.col("up_tree").isNull()
    keyed = rows.withColumns({"k1": F.when(there, TOP - 1).otherwise(F.col("up_tree")), "k2": F.coalesce("up_base", F.lit(0)), "k3": F.when(there, F.xxhash64("tree", "place")).otherwise(F.col("up_place"))})
    above = nodes.select(F.col("tree").alias("k1"), F.col("base").alias("k2"), F.col("place").alias("k3"), F.col("segment").alias("more"), *(F.col(c).alias(f"n_{c}") for c in ("up_tree", "up_base", "up_place")))
    joined = keyed.join(above, ["k1", "k2", "k3"], "left")
    return joined.select("tree", "base", "place", "row", F.concat("segment", F.coalesce("more", F.array().cast("array<binary>"))).alias("segment"), *(F.col(f"n_{c}").alias(c) for c in ("up_tree", "up_base", "up_place")))


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's leaf, its language's subroot, the root, the proof's digest and what folding a tampered row gives.

    Returns doc_id, lang, leaf, subroot, root, siblings (33 bytes each, from the leaf to
    the root), proof_sha256, folded_root and verified, a row per row of ``docs``
    (doc_id, source, lang, n_chars, text; other columns are not read). Rows lie by
    doc_id, null first, ties by their leaf; equal rows have equal digests at places of
    their own. Any column may be null (``-`` in the leaf); a null doc_id or n_chars is
    not tampered with. No rows give no rows.
    """
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    struck = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False)) & n_chars.isNotNull()
    bad = F.when(struck, leaf(doc_id, source, lang, n_chars.cast("decimal(20,0)") + 1, text))
    leaves = durable(docs.select("doc_id", "lang", leaf(doc_id, source, lang, n_chars, text).alias("leaf"), bad.alias("bad")))
    langs = durable(leaves.groupBy("lang").agg(F.count("*").alias("n")).withColumn("one", F.lit(0)))
    whole = Window.partitionBy("one")
    few = at_most(langs, SMALL)  # so many rows lie in one window
    ordered = langs.withColumns({"place": (F.row_number().over(whole.orderBy("lang")) - 1).cast("long"), "total": F.count("*").over(whole)}) if few else numbered(langs, "one", "lang")
    trees = durable(ordered.select(F.col("lang").alias("l"), F.col("place").alias("tree"), "n", "total"))
    size = trees.agg(F.max("n"), F.max("total")).first()
    if size[0] is None:
        columns = "doc_id {}, lang {}, leaf string, subroot string, root string, siblings array<binary>, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], columns.format(*(docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang"))))
    placed = numbered(leaves.join(maybe_broadcast(trees.select("l", "tree"), SMALL), F.col("lang").eqNullSafe(F.col("l"))).drop("l"), "tree", "doc_id", "leaf")
    rows, roots, inner, hops = forest(placed.select("tree", "place", "total", F.col("leaf").alias("digest"), F.struct("doc_id", "lang", "leaf", "bad").alias("row")), size[0])
    tops = roots.join(maybe_broadcast(trees.select("tree", "total"), SMALL), "tree").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "total", F.col("root").alias("digest"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    top, root, above, more = forest(tops, size[1])
    nodes = durable(top if inner is None else inner.unionByName(top))
    nodes = nodes if above is None else durable(nodes.unionByName(above))
    for k in range(math.ceil(math.log2(hops + more))):
        far = 2**k
        met = nodes.where((F.col("tree") == TOP) | (F.col("base") == far))
        # A hot ancestor's rows meet a broadcast of counted nodes; with more nodes, the splitting of skewed joins.
        rows = jump(rows, F.broadcast(met)) if at_most(met, NODES) else durable(jump(rows, met.hint("merge")))
        nodes = durable(jump(nodes.where((F.col("tree") == TOP) | (F.col("base") % (2 * far) == 0)), nodes))
    roots = maybe_broadcast(roots.withColumnRenamed("root", "subroot"), SMALL)
    root = root.first().root
    held = F.filter("segment", lambda s: F.octet_length(s) > 0)
    proof = F.array_join(F.transform(held, lambda s: F.lower(F.hex(F.substring(s, 2, 32)))), "")
    out = rows.join(roots, "tree").select("row.doc_id", "row.lang", "row.leaf", "subroot", F.lit(root).alias("root"), F.col("segment").alias("siblings"), F.sha2(proof, 256).alias("proof_sha256"), fold(F.coalesce("row.bad", "row.leaf"), F.col("segment")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

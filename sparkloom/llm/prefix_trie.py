"""Prefix trie of rebuilt conversations, from fingerprints of their parts.

A conversation is rebuilt from the head of another one and its own later turns. The
fingerprint of turns t0, t1, ... is the sum of t_k * B**k in two prime fields: that of
two pieces in a row is the first one's plus the second one's times a power of B, so a
rebuilt prefix's comes from running sums over the original turns, and no rebuilt text
is made. Nodes of the trie are the prefixes of one depth and fingerprint. A group is
checked: its members' last turns have one content and their parents one fingerprint,
down to the root; and turns of one content hash have the same role and text as the
first one of them, read back by its stored place. Where a check fails, all is done anew
with another base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import SMALL, durable, maybe_broadcast, numbered, words

#: Two primes below 2**31: a fingerprint is one long, its halves the sums in either field.
PRIMES = (2147483647, 2147483629)
#: Bases by attempt, and turns of the head that another conversation may lend, at most.
BASES = ((911382323, 972663749), (1000003579, 448924513), (613651349, 1234567907))
HEAD = 3
#: Ends of a node that one row lists before they go to its digest.
ENDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def power(base: int, exponent: Column, p: int) -> Column:
    """base ** exponent mod p, for exponents below 2**40."""
    squares, b = [], base
    for _ in range(40):
        squares.append(b)
        b = b * b % p
    bits = F.filter(F.transform(F.array(*map(F.lit, squares)), lambda s, k: F.when(F.call_function("shiftright", exponent, k).bitwiseAND(F.lit(1)) == 1, s)), lambda s: s.isNotNull())
    return F.aggregate(bits, F.lit(1).cast("long"), lambda a, s: a * s % p)


def packed(high: Column, low: Column) -> Column:
    """Both fields' sums as one long."""
    return F.shiftleft(high % PRIMES[0], 31).bitwiseOR(low % PRIMES[1])


def halves(f: Column) -> tuple[Column, Column]:
    return F.shiftright(f, 31), f.bitwiseAND(F.lit(2**31 - 1))


def shifted(f: Column, back: Column, bases: tuple[int, int]) -> Column:
    """A fingerprint whose turns come ``back`` (0 to HEAD) places earlier."""
    out = []
    for half, base, p in zip(halves(f), bases, PRIMES, strict=True):
        inverse = pow(base, -1, p)
        factor = F.element_at(F.array(*(F.lit(pow(inverse, k, p)) for k in range(HEAD + 1))), back.cast("int") + 1)
        out.append(half * factor % p)
    return packed(*out)


def added(a: Column, b: Column) -> Column:
    return packed(*(x + y for x, y in zip(halves(a), halves(b), strict=True)))


def less(a: Column, b: Column) -> Column:
    return packed(*(x - y + p for x, y, p in zip(halves(a), halves(b), PRIMES, strict=True)))


def turns_of(conversations: DataFrame, attempt: int) -> DataFrame:
    """The original turns in order: conv_id, place, content (hash), n_words, term and upto (fingerprints of the turn at its place, and of all up to it), n (turns of its conversation)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.xxhash64(F.lit(attempt), text("role"), text("text")).alias("content"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    placed = numbered(rows, "conv_id", "turn", "content")
    terms = [F.pmod(F.xxhash64(F.lit(i), "content"), F.lit(p)) * power(b, F.col("place"), p) % p for i, (b, p) in enumerate(zip(BASES[attempt], PRIMES, strict=True))]
    placed = durable(placed.select("conv_id", "place", F.col("total").alias("n"), "content", "n_words", "part", "seq", packed(*terms).alias("term")))
    # Running sums within a part, then of the parts before: no conversation lies in one task.
    high, low = halves(F.col("term"))
    here = Window.partitionBy("part", "conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A sum of remainders goes on as a remainder, as a part's rows are below 2**31.
    sums = placed.groupBy("part", "conv_id").agg(F.sum(high).alias("h"), F.sum(low).alias("l"))
    sums = sums.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), *((F.coalesce(F.sum(F.col(x) % q).over(before), F.lit(0)) % q).alias(x) for x, q in zip("hl", PRIMES, strict=True)))
    carried = placed.withColumns({"sh": F.sum(high).over(here) % PRIMES[0], "sl": F.sum(low).over(here) % PRIMES[1]}).join(maybe_broadcast(durable(sums), SMALL), (F.col("part") == F.col("p")) & (F.col("conv_id") == F.col("c")))
    return durable(carried.select("conv_id", "place", "n", "content", "n_words", "term", packed(F.col("sh") + F.col("h"), F.col("sl") + F.col("l")).alias("upto")))


def same_contents(conversations: DataFrame, attempt: int) -> bool:
    """Whether all turns of one content hash have the role and text of the first of them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.xxhash64(F.lit(attempt), text("role"), text("text")).alias("content"), text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("ref"))
    shared = durable(rows.groupBy("content").agg(F.count("*").alias("n"), F.min("ref").alias("ref")).where("n > 1"))
    first = rows.join(maybe_broadcast(shared.select("ref"), SMALL), "ref", "left_semi").select("content", F.col("role").alias("r"), F.col("text").alias("t"))
    return rows.join(first.hint("merge"), "content").where("role <> r or text <> t").isEmpty()


def rebuilt(turns: DataFrame, every: int, attempt: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, length), and all their prefixes: conv_id, depth, length, f, parent, content, n_words."""
    c = F.col("conv_id")
    first = F.array_sort(F.collect_list(F.struct("place", "content", "n_words", "term", "upto")))
    heads = turns.where(F.col("place") < HEAD).groupBy("conv_id").agg(F.first("n").alias("n"), first.alias("head"))
    lent = heads.where(c % every == 0).select(c.alias("base"), F.col("head").alias("lent"))
    wide = heads.withColumns({"base": c - c % every, "h": (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")}).join(lent.hint("merge"), "base", "left")
    taken = F.when(F.col("lent").isNull(), 0).otherwise(F.least("h", F.size("lent")))
    wide = wide.withColumn("b", taken).withColumn("length", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    upto = lambda a, k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(a, k - 1)["upto"])
    wide = durable(wide.select("conv_id", "h", "b", "length", F.slice("lent", F.lit(1), F.col("b")).alias("lent"), upto(F.col("lent"), F.col("b")).alias("before"), F.when(F.col("n") > F.col("h"), upto(F.col("head"), F.col("h"))).alias("own")))
    borrowed = wide.select("conv_id", "length", F.inline("lent")).select("conv_id", (F.col("place") + 1).alias("depth"), "length", F.col("upto").alias("f"), "term", "content", "n_words")
    later = turns.join(wide.select("conv_id", "h", "b", "length", "before", "own").hint("merge"), "conv_id").where("place >= h")
    back = F.col("h") - F.col("b")
    moved = lambda f: shifted(f, back, BASES[attempt])
    later = later.select("conv_id", (F.col("place") - back + 1).alias("depth"), "length", added(F.col("before"), moved(less(F.col("upto"), F.col("own")))).alias("f"), moved(F.col("term")).alias("term"), "content", "n_words")
    both = borrowed.unionByName(later)
    return wide.select("conv_id", "length"), both.select("conv_id", "depth", "length", "f", less(F.col("f"), F.col("term")).alias("parent"), "content", "n_words")


def ends_of(prefixes: DataFrame) -> DataFrame:
    """depth, f and the digest of the ascending conv_ids (depth, f, conv_id: one row a conversation that ends there).

    Ids are numbered in their node and listed in rows of so many; a node's lists run through its digest in order.
    """
    key = F.struct("depth", "f")
    lists = numbered(prefixes.withColumn("node", key).select("node", "conv_id"), "node", "conv_id")
    lists = lists.groupBy("node", F.floor(F.col("place") / ENDS).alias("at")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.first("total").alias("total"))
    one = F.col("total") <= ENDS
    lists = durable(lists)
    few = lists.where(one).select("node.depth", "node.f", F.sha2("ids", 256).alias("ends_sha256"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in now] + [pa.array([digest.hexdigest()])], ["depth", "f", "ends_sha256"])
        for batch in batches:
            for depth, f, ids in zip(*(batch.column(c) for c in ("depth", "f", "ids")), strict=True):
                node = (depth.as_py(), f.as_py())
                if node != now:
                    if now:
                        yield done()
                    now, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
        if now:
            yield done()

    many = lists.where(~one).select("node.depth", "node.f", "at", "ids").repartition("depth", "f").sortWithinPartitions("depth", "f", "at")
    return few.unionByName(many.select("depth", "f", "ids").mapInArrow(digests, "depth long, f long, ends_sha256 string"))


def subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """Nodes (depth, f, parent, leaf, saved) with n_leaves and saved_tokens, summed over their subtrees.

    In round k a node holds its sum over the 2**k levels from itself down and its
    ancestor 2**k levels up; adding what those below it with that ancestor hold doubles the levels.
    """
    now = nodes.select("depth", "f", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    far = 1
    while far <= deepest:
        below = now.where(F.col("depth") >= far).groupBy((F.col("depth") - far).alias("depth"), F.col("up").alias("f")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        summed = now.join(below, ["depth", "f"], "left")
        summed = summed.select("depth", "f", "up", *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))))
        if 2 * far <= deepest:
            # A hot ancestor is one row of the looked-up side; skewed joins are split.
            above = now.where(F.col("depth") >= far).select((F.col("depth") + far).alias("at"), F.col("f").alias("up"), F.col("up").alias("next"))
            high, deep = summed.where(F.col("depth") < 2 * far), summed.where(F.col("depth") >= 2 * far)
            deep = deep.withColumn("at", F.col("depth")).join(above.hint("merge"), ["at", "up"])
            summed = high.withColumn("up", F.lit(None).cast("long")).unionByName(deep.select("depth", "f", F.col("next").alias("up"), "n_leaves", "saved_tokens"))
        now = durable(summed)
        far *= 2
    return now.drop("up")


COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame, every: int = 20) -> DataFrame:
    """The trie's nodes, a row each: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not read.
    Turns lie by ``turn``, null first, ties by the hash of role and text; repeated rows
    are turns each. Null roles and texts are empty ones. Rows without a conv_id are in no
    conversation. A node's conv_id is its smallest member. No rows give no nodes.
    """
    conversations = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    for attempt in range(len(BASES)):
        turns = turns_of(conversations, attempt)
        convs, prefixes = rebuilt(turns, every, attempt)
        prefixes = durable(prefixes)
        nodes = prefixes.groupBy("depth", "f").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.max("parent").alias("p2"), F.min("content").alias("content"), F.max("content").alias("c2"), F.max("n_words").alias("n_words"), F.max(F.col("length") > F.col("depth")).alias("goes_on"))
        nodes = durable(nodes)
        if nodes.where("parent <> p2 or content <> c2").isEmpty() and same_contents(conversations, attempt):
            break
    else:
        raise RuntimeError("fingerprints met under every base")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max(F.col("length") > 0).alias("goes_on")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f"), "conv_id", "n_convs", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("n_words"), "goes_on")
    nodes = durable(nodes.select("depth", "f", "conv_id", "n_convs", "parent", "n_words", "goes_on").unionByName(root))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    saved = (F.col("n_convs") - 1) * F.col("n_words")
    sums = subtree_sums(nodes.select("depth", "f", "parent", F.when(F.col("goes_on"), 0).otherwise(1).cast("long").alias("leaf"), saved.alias("saved")), deepest)
    ends = ends_of(prefixes.where("depth = length").select("depth", "f", "conv_id").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f"), "conv_id")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("f")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above.hint("merge"), ["depth", "parent"], "left").join(sums, ["depth", "f"]).join(children, ["depth", "f"], "left").join(ends, ["depth", "f"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

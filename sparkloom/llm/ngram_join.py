"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair, and the components of its links.

A document is the set of its distinct word shingles, ordered by how often each
occurs in the corpus (from a sketch over all documents that grows with them), rarest
first. Two sets of Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each, so documents meet only on these. In a group of documents
that share such a shingle, pairs pass

* the length filter (t times the larger size),
* the positional filter (the common shingle's places bound the overlap),
* the suffix filter: the sets are parted by hash into ``BITS`` ranges, and the
  ranges with an odd difference bound the sets' Hamming distance from below,

and what passes is verified on the whole sets, a pair once. Texts are the
nodes, each of them once; rows with one doc_id are one document.

The first rounds look at groups of many texts only, and compare each text with a few
others: first with the one text that is the hub of its largest group, then with those in
a small random part of it. What is a copy of many others is linked then, by a few pairs
a text. The last round looks at all pairs of different components, which loses no
component. For that the members of a group are cut into blocks of bounded size that meet
pair by pair; in a group of several blocks the members of its largest component don't
meet each other at all. In large groups a pair is handed on at its first common shingle,
as far as the first ``EARLY`` shingles of either tell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import components, durable, let, maybe_broadcast
from sparkloom.llm.shingles import shingle_set, text_words

#: Counters of the frequency sketch: one to a document, at least and at most; and those in one row while it is summed.
SKETCH, CELL = (2**18, 2**24), 2**14
#: Tasks to a core that count for the sketch.
SPLITS = 3
BITS = 512
#: Documents of a group in one block; groups over HOT are in the first rounds, in parts of about PART documents.
BLOCK, HOT, PART, ROUNDS = 256, 8, 48, 2
#: Earlier shingles of large groups that a document is known by in such a group.
EARLY = 64
#: Rows of at most 50 bytes up to which a counted side is broadcast.
SMALL = 400_000


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of all documents' shingles by hash, a power of two of them; counts over 2**31 stop there."""
    size = 1 << (min(SKETCH[1], max(SKETCH[0], docs.count())) - 1).bit_length()
    # A task hands on one sketch, whatever it read: few tasks read many splits each.
    tasks = min(docs.rdd.getNumPartitions(), SPLITS * docs.sparkSession.sparkContext.defaultParallelism)
    lanes = math.isqrt(tasks) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text_words(text.as_py()), width)
                np.add.at(seen, (s & np.uint64(size - 1)).astype(np.int64), 1)
        lane = TaskContext.get().partitionId() % lanes
        cells = np.flatnonzero(seen.reshape(-1, CELL).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), pa.array([lane] * len(cells), pa.int32()), pa.array([seen[k * CELL : (k + 1) * CELL].tobytes() for k in cells], pa.binary())],
            ["cell", "lane", "counts"],
        )

    def add(rows):
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return rows[["cell", "lane"]].head(1).assign(counts=[total.tobytes()])

    kind = "cell int, lane int, counts binary"
    summed = docs.select("text").coalesce(tasks).mapInArrow(count, kind).groupBy("cell", "lane").applyInPandas(add, kind)
    out = np.zeros(size, np.int32)
    for row in summed.withColumn("lane", F.lit(0)).groupBy("cell", "lane").applyInPandas(add, kind).toLocalIterator():
        out[row.cell * CELL : (row.cell + 1) * CELL] = np.minimum(np.frombuffer(row.counts, np.int64), 2**31 - 1)
    return out


def features(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: rid (a number for it), doc_id, th (hash of the text), seq (hash of its words in order, null without words), n, prefix (rare first), bits."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for batch in batches:
            seqs, ns, prefixes, bits = [], [], [], []
            for text in batch.column(2):
                ws = text_words(text.as_py())
                s = shingle_set(ws, width)
                n = len(s)
                first = n - -(-percent * n // 100) + 1 if n else 0
                order = np.lexsort((s, often[(s & np.uint64(len(often) - 1)).astype(np.int64)]))[:first]
                odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1
                seqs.append(hashlib.md5(b" ".join(ws)).digest() if ws else None)
                ns.append(n)
                prefixes.append(s[order].view(np.int64))
                bits.append(np.packbits(odd).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seqs, pa.binary()), pa.array(ns, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "th", "seq", "n", "prefix", "bits"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = rows.mapInArrow(run, f"doc_id {kind}, th long, seq binary, n long, prefix array<long>, bits binary")
    return rows.select(F.monotonically_increasing_id().alias("rid"), "*")


def _parts(members: DataFrame, turn: int) -> DataFrame:
    """Rows dealt to (token, bi, bj): random small parts of every text's largest group, other ones each turn."""
    rows = members.select("doc", "n", "bits", "comp", F.explode(F.filter("toks", lambda t: t["token"] == F.col("top"))).alias("t")).where(F.col("t.g") > HOT)
    part = F.pmod(F.hash("doc", "t.token", F.lit(turn)), F.ceil(F.col("t.g") / PART).cast("int"))
    rows = rows.select("t.token", part.alias("bi"), part.alias("bj"), "n", "doc", "t.pos", "bits", "comp", F.lit(0).alias("b"), F.array().cast("array<long>").alias("early"))
    return rows.repartition("token", "bi").sortWithinPartitions("token", "bi", "bj", "n", "doc")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows dealt to (token, bi, bj): the pairs of blocks of a group in which two components can meet."""
    large = F.filter("toks", lambda t: t["g"] > HOT)
    before = lambda ts: F.transform(ts, lambda t, k: F.struct(t["token"].alias("token"), t["pos"].alias("pos"), t["g"].alias("g"), F.transform(F.slice(ts, F.lit(1), F.least(k, F.lit(EARLY))), lambda x: x["token"]).alias("early")))
    none = lambda t: F.struct(t["token"].alias("token"), t["pos"].alias("pos"), t["g"].alias("g"), F.array().cast("array<long>").alias("early"))
    all_of = F.concat(let(large, before), F.transform(F.filter("toks", lambda t: t["g"] <= HOT), none))
    rows = members.select("doc", "n", "bits", "comp", F.explode(all_of).alias("t")).select("t.*", "doc", "n", "bits", "comp")
    wide = rows.where(F.col("g") > BLOCK).groupBy("token", "comp").agg(F.count("*").alias("c"), F.first("g").alias("g"))
    wide = wide.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("most"), F.first("g").alias("all"))
    rows = rows.join(maybe_broadcast(durable(wide), SMALL), "token", "left")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = rows.withColumn("ns", F.when(F.col("major").isNull(), 1).otherwise(blocks(F.col("all") - F.col("most"))))
    rows = rows.withColumn("nm", F.when(F.col("major").isNull(), 0).otherwise(blocks(F.col("most")))).where("ns > 0")
    many, h = F.coalesce(F.col("comp") == F.col("major"), F.lit(False)), F.hash("doc", "token")
    rows = rows.withColumn("b", F.when(many, F.col("ns") + F.pmod(h, F.col("nm"))).otherwise(F.pmod(h, F.col("ns"))))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(many, F.col("ns")).otherwise(F.col("ns") + F.col("nm")) - 1)))
    rows = rows.select("token", F.least("b", "j").alias("bi"), F.greatest("b", "j").alias("bj"), "n", "doc", "pos", "bits", "comp", "b", "early")
    return rows.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "n", "doc")


def candidates(dealt: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, a before b by size, that pass the filters at a common shingle of a block."""

    def pairs(t: dict[str, np.ndarray], early: list) -> np.ndarray:
        size = len(t["token"])
        group = np.concatenate([[0], np.cumsum((np.diff(t["token"]) != 0) | (np.diff(t["bi"]) != 0) | (np.diff(t["bj"]) != 0))])
        known = [frozenset(x) for x in early]
        left, right = [], []
        for d in range(1, size):
            x = np.flatnonzero(group[:-d] == group[d:])
            if not len(x):
                break
            y = x + d
            keep = (t["comp"][x] != t["comp"][y]) & ((t["bi"][x] == t["bj"][x]) | (t["b"][x] != t["b"][y]))
            x, y = x[keep], y[keep]
            nx, ny = t["n"][x], t["n"][y]
            need = -(-percent * (nx + ny) // (100 + percent))
            keep = (100 * nx >= percent * ny) & (np.minimum(nx - t["pos"][x], ny - t["pos"][y]) >= need)
            x, y, need = x[keep], y[keep], need[keep]
            far = np.bitwise_count(t["bits"][x] ^ t["bits"][y]).sum(axis=1)
            keep = far <= t["n"][x] + t["n"][y] - 2 * need
            for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                if known[i].isdisjoint(known[j]):
                    left.append(i)
                    right.append(j)
        docs, of = np.unique(t["doc"], return_inverse=True)
        code = np.unique(of[np.array(left, int)] * len(docs) + of[np.array(right, int)])
        return np.array([docs[code // len(docs)], docs[code % len(docs)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ready, waiting = None, [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in ("token", "bi", "bj")]
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = int(table.num_rows - np.argmin(same[::-1])) if not same.all() else 0
            kept = table.slice(cut).combine_chunks().to_batches()[0]
            ready.append(found(table.slice(0, cut)))
            waiting += ready[-1].shape[1]
            if waiting > 200_000:
                yield once(ready)
                ready, waiting = [], 0
        if kept is not None:
            ready.append(found(pa.Table.from_batches([kept])))
        if ready:
            yield once(ready)

    def once(ready: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(ready, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def found(table: pa.Table) -> np.ndarray:
        if table.num_rows < 2:
            return np.empty((2, 0), np.int64)
        t = {c: table.column(c).to_numpy() for c in ("token", "bi", "bj", "n", "doc", "pos", "comp", "b")}
        t["bits"] = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, BITS // 64)
        return pairs(t, table.column("early").to_pylist())

    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, rows: DataFrame, repeated: bool, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of rids, a table, whose whole shingle sets reach the similarity; the texts are read again for those that need it.

    ``repeated`` says whether some doc_id and text stand in several rows, of which one is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text_words(x.as_py()), width).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    wanted = durable(rows.select("rid", "doc_id", "th").join(maybe_broadcast(durable(ends), SMALL), "rid", "left_semi"))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    texts = texts.join(maybe_broadcast(wanted, SMALL), ["doc_id", "th"]).select("rid", "text")
    if repeated:
        texts = texts.dropDuplicates(["rid"])
    sets = texts.mapInArrow(run, "doc long, s binary")
    both = sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")).join(maybe_broadcast(pairs, SMALL), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")).hint("merge"), "b"
    )
    return both.select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long")


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Groups of documents whose shingle sets' Jaccard similarity is ``percent`` / 100 or more.

    Takes doc_id (of any type that has an order) and text; other columns are not read.
    Returns a row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, itself included). Texts without words (null, empty, white
    space) have no shingles and link with nothing, not with each other; fewer words than
    ``width`` are one shingle. Rows of one doc_id are one document, whose texts link it
    with whatever any of them is like. Rows with a null doc_id can't be named as
    partners: they stay alone, with a null component. An empty table gives an empty result.
    """
    whole = durable(features(docs, width, percent))
    copies = whole.where("seq is not null and doc_id is not null").groupBy("seq").agg(F.min("rid").alias("rep"), F.count("*").alias("rows")).where("rows > 1")
    copies = durable(copies.drop("rows"))
    extra = whole.select("rid", "seq").where("doc_id is not null").join(copies.hint("merge"), "seq").where("rid <> rep").select("rid")
    reps = whole.where("n > 0 and doc_id is not null").join(maybe_broadcast(durable(extra), SMALL), "rid", "left_anti")

    tokens = reps.select("rid", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("g"), F.bit_xor(F.xxhash64("rid")).alias("sig"), F.sum("pos").alias("places")).where("g > 1")
    # Shingles held by the same documents stand for each other; the first of them in the order is the one at the least places.
    shared = durable(shared.groupBy("g", "sig").agg(F.min_by("token", F.struct("places", "token")).alias("token")).select("token", "g"))
    held = (
        tokens.join(maybe_broadcast(shared, SMALL), "token")
        .groupBy("rid")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "token", "g"))).alias("toks"), F.max(F.struct("g", "token")).alias("top"))
    )
    members = durable(reps.select("rid", "n", "bits").join(held, "rid").select(F.col("rid").alias("doc"), "n", "bits", "toks", F.col("top.token").alias("top")))

    hubs = durable(members.groupBy("top").agg(F.min(F.struct("doc", "n")).alias("hub")).select("top", F.col("hub.doc").alias("a"), F.col("hub.n").alias("na")))
    star = members.select("doc", "n", "top").join(maybe_broadcast(hubs, SMALL), "top").where("doc <> a")
    star = star.where(100 * F.least("n", "na") >= percent * F.greatest("n", "na")).select("a", F.col("doc").alias("b"))
    repeated = not whole.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    tried = durable(star)
    links = durable(verified(docs, whole, repeated, tried, width, percent))

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among pairs that were not compared before."""
        nonlocal tried
        low, high = F.least("a", "b"), F.greatest("a", "b")
        before = tried.select(low.alias("low"), high.alias("high"))
        fresh = durable(pairs.join(maybe_broadcast(before, SMALL), (low == F.col("low")) & (high == F.col("high")), "left_anti"))
        tried = tried.union(fresh)
        return durable(verified(docs, whole, repeated, fresh, width, percent))

    def labelled(links: DataFrame) -> DataFrame:
        label = durable(components(links)).select(F.col("node").alias("doc"), F.col("component").alias("comp"))
        return durable(members.join(maybe_broadcast(label, SMALL), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")))

    for turn in range(ROUNDS):
        found = linked(candidates(_parts(labelled(links), turn), percent))
        if found.isEmpty():
            break
        links = links.union(found)
    links = links.union(linked(candidates(_blocks(labelled(links)), percent)))

    named = whole.select("rid", "doc_id", "n", "seq").join(copies.hint("merge"), "seq", "left")
    named = durable(named.select("doc_id", "n", F.when(F.col("doc_id").isNull(), F.col("rid")).otherwise(F.coalesce("rep", "rid")).alias("rep")))
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same = named.select("doc_id", F.col("rep").alias("b")).join(maybe_broadcast(durable(several), SMALL), "doc_id").select("a", "b")
    found = durable(components(links.union(same))).select(F.col("node").alias("rep"), "component")
    named = durable(named.join(found.hint("merge"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("comp")))
    least = named.where("doc_id is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = named.join(durable(least).hint("merge"), "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

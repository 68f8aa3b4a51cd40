"""Embedding near-dedup by p-stable (Gaussian) hashing, with exact cosine checks.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. Each of ``tables`` tables
projects them on ``dims`` Gaussian directions, shifts, and cuts into steps of
``step``; vectors with equal label and equal steps meet in a bucket. At cosine 0.98
(distance 0.2) and the default parameters a pair shares at least one of the 48 buckets
with probability 0.999, and unrelated vectors one of them with 0.000001, so what
meets is nearly all linked.

Equal vectors are one from the start, with a count. Buckets are cut into blocks of
bounded size that meet pair by pair. A pair is counted in the first table where it
meets, so counts need no list of pairs: a block of any size hands on each vector's
number of links and, for components, a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import components, durable

#: Vectors in one block; groups up to PAIRED are compared pair by pair over a whole batch at once, larger ones as a matrix product.
BLOCK, PAIRED = 256, 24
#: Pairs compared at once.
CHUNK = 50_000
GROUP = ["label", "t", "key", "bi", "bj"]


def hashes(dim: int, tables: int, dims: int, step: float, seed: int):
    """Directions (dim, tables * dims) and shifts of the tables."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * dims)), rng.uniform(0, step, tables * dims)


def usable(ids: pa.Array, labels: pa.Array, column: pa.ListArray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """By length: the rows of a batch that can link, and their vectors, normalised."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    known = ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
    at, vectors = {}, {}
    for dim in np.unique(sizes[known & (sizes > 0)]):
        rows = np.flatnonzero(known & (sizes == dim))
        x = values[starts[rows][:, None] + np.arange(dim)]
        most = np.abs(x).max(axis=1)
        keep = np.isfinite(most) & (most > 0)
        x = x[keep] / most[keep, None]
        at[int(dim)], vectors[int(dim)] = rows[keep], x / np.sqrt((x * x).sum(axis=1))[:, None]
    return at, vectors


def hashed(vectors: DataFrame, tables: int, dims: int, step: float, seed: int) -> DataFrame:
    """Vectors that can link: vec_id, label, v (normalised doubles as bytes), keys (a 64-bit hash of the steps, one to a table)."""
    kinds = dict(vectors.dtypes)
    names = ["vec_id", "label", "v", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for batch in batches:
            at, found = usable(*batch.columns)
            for dim, x in found.items():
                if dim not in made:
                    made[dim] = hashes(dim, tables, dims, step, seed)
                a, b = made[dim]
                for low in range(0, len(x), 2000):  # so many projections at once
                    part, rows = x[low : low + 2000], pa.array(at[dim][low : low + 2000])
                    steps = np.floor((part @ a + b) / step).astype(np.int64).view(np.uint64).reshape(-1, tables, dims)
                    key = np.full(steps.shape[:2], dim, np.uint64)
                    for d in range(dims):
                        key = (key ^ steps[:, :, d]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(31)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * tables, pa.int32()), pa.array(key.view(np.int64).ravel()))
                    whole = pa.array([v.tobytes() for v in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), whole, lists], names)

    rows = vectors.select("vec_id", "label", "embedding")
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary, keys array<long>")


def near_in_block(x: np.ndarray, keys: np.ndarray, blk: np.ndarray, t: int, across: bool, cosine: float) -> np.ndarray:
    """Which vectors of a block link, and meet nowhere before table ``t``."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if across:
        near &= blk[:, None] != blk[None, :]
    for k in range(t):
        near &= keys[:, None, k] != keys[None, :, k]
    return near


def forest(near: np.ndarray) -> np.ndarray:
    """For each vector of a block the first one that it is linked with over any number of steps."""
    size = len(near)
    root, seen = np.arange(size), np.zeros(size, bool)
    for start in range(size):
        if seen[start]:
            continue
        seen[start], todo = True, np.array([start])
        while len(todo):
            todo = np.flatnonzero(near[todo].any(axis=0) & ~seen)
            seen[todo], root[todo] = True, start
    return root


def block_links(rows: DataFrame, cosine: float) -> DataFrame:
    """From sorted rows (GROUP, blk, vec_id, m, v, keys): vec_id, links (vectors linked in a block, copies counted), to (or null)."""
    kind = dict(rows.dtypes)["vec_id"]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, m, t, blk = table.column("vec_id").combine_chunks(), *(table.column(c).to_numpy() for c in ("m", "t", "blk"))
        new = np.zeros(table.num_rows, bool)
        for c in GROUP:
            column = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= column[1:] != column[:-1]
        group = np.cumsum(new)
        ends = np.append(np.flatnonzero(new), table.num_rows)
        starts = np.append(0, ends[:-1])
        across = (table.column("bi").to_numpy() != table.column("bj").to_numpy())[starts]
        vs, ks = table.column("v").combine_chunks(), table.column("keys").combine_chunks()
        lengths = np.diff(np.frombuffer(vs.buffers()[1], np.int32)[vs.offset : vs.offset + len(vs) + 1])
        at, links, to = [], [], []
        keys = ks.flatten().to_numpy().reshape(table.num_rows, -1)
        whole = np.frombuffer(vs.buffers()[2], np.float64)
        first = np.frombuffer(vs.buffers()[1], np.int32)[vs.offset : vs.offset + len(vs)] // 8
        sizes = ends - starts
        small = np.repeat(sizes <= PAIRED, sizes)
        for dim in np.unique(lengths[small]) // 8:
            for d in range(1, PAIRED):
                i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d] & (lengths[:-d] == 8 * dim) & (lengths[d:] == 8 * dim))
                i = i[(blk[i] != blk[i + d]) | ~across[group[i]]]
                for low in range(0, len(i), CHUNK):
                    a = i[low : low + CHUNK]
                    b = a + d
                    x, y = (whole[first[k][:, None] + np.arange(dim)] for k in (a, b))
                    keep = np.einsum("ij,ij->i", x, y) >= cosine
                    a, b = a[keep], b[keep]
                    once = ~((keys[a] == keys[b]) & (np.arange(keys.shape[1])[None, :] < t[a][:, None])).any(axis=1)
                    a, b = a[once], b[once]
                    at += [a, b]
                    links += [m[b], m[a]]
                    to += [b, a]
        for g in np.flatnonzero(sizes > PAIRED):
            mine = np.arange(starts[g], ends[g])
            for size in np.unique(lengths[mine]):
                part = mine[lengths[mine] == size]
                x = whole[first[part][:, None] + np.arange(size // 8)]
                near = near_in_block(x, keys[part], blk[part], int(t[part[0]]), bool(across[g]), cosine)
                n, root = near @ m[part], forest(near)
                keep = n > 0
                at.append(part[keep])
                links.append(n[keep])
                to.append(part[root[keep]])
        if at and len(at := np.concatenate(at)):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate(links), pa.int64()), ids.take(pa.array(np.concatenate(to)))], ["vec_id", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]).combine_chunks()
            if not table.num_rows:
                continue
            same = np.ones(table.num_rows, bool)
            for c in GROUP:
                codes = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                same &= codes == codes[-1]
            cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = table.slice(cut).combine_chunks()
            if cut:
                yield from found(table.slice(0, cut).combine_chunks())
        if kept is not None and kept.num_rows:
            yield from found(kept)

    return rows.mapInArrow(run, f"vec_id {kind}, links long, to {kind}")


def embed_dedup(vectors: DataFrame, cosine: float = 0.98, tables: int = 48, dims: int = 24, step: float = 2.0, seed: int = 11) -> DataFrame:
    """Near copies among ``vectors`` (vec_id, label, embedding) of one label, by cosine in double precision.

    Returns a row per row: vec_id, n_links (other vectors found at ``cosine`` or more),
    component_id (smallest vec_id reachable by links, itself included), kept (vec_id is
    component_id). Vectors that are null, empty, zero, or hold null or non-finite
    components, and those with a null label or vec_id, link with nothing; so do vectors of
    different lengths. Repeated rows of a vec_id are one vector, the first by label and
    value of those that can link. A null vec_id has a null component and is not kept. An
    empty table gives an empty result. vec_id and label may be of any type that has an
    order; other columns are not read.
    """
    each = hashed(vectors, tables, dims, step, seed).groupBy("vec_id").agg(F.min(F.struct("label", "v", "keys")).alias("x"))
    rows = durable(each.select("vec_id", "x.label", "x.v", "x.keys", F.sha2("x.v", 256).alias("vh")))
    classes = durable(rows.groupBy("label", "vh").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    reps = durable(rows.join(classes.select("rep", "m").hint("merge"), F.col("vec_id") == F.col("rep")).select("vec_id", "label", "m", "v", "keys"))
    dealt = reps.select("vec_id", "label", F.posexplode("keys").alias("t", "key"))
    sizes = durable(dealt.groupBy("label", "t", "key").agg(F.count("*").alias("g")).where("g > 1"))
    nb = F.ceil(F.col("g") / BLOCK).cast("int")
    met = (
        dealt.join(sizes.hint("merge"), ["label", "t", "key"])
        .withColumn("blk", F.pmod(F.hash("vec_id", "t"), nb))
        .withColumn("j", F.explode(F.sequence(F.lit(0), nb - 1)))
        .select("label", "t", "key", F.least("blk", "j").alias("bi"), F.greatest("blk", "j").alias("bj"), "blk", "vec_id")
        .join(reps.select("vec_id", "m", "v", "keys").hint("merge"), "vec_id")
        .select(*GROUP, "blk", "vec_id", "m", "v", "keys")
    )
    found = durable(block_links(met.repartition(*GROUP).sortWithinPartitions(*GROUP), cosine))
    links = found.groupBy(F.col("vec_id").alias("id")).agg(F.sum("links").alias("n_links"))
    same = components(found.select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    known = durable(links.join(same, links.id == same.node, "left").select("id", "n_links", "component"))
    named = classes.join(known.hint("merge"), F.col("rep") == F.col("id"), "left").select(
        "label", "vh", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    of = durable(rows.select(F.col("vec_id").alias("id"), "label", "vh").join(named, ["label", "vh"]).select("id", "n_links", "component"))
    out = vectors.select("vec_id").join(of.hint("merge"), F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )

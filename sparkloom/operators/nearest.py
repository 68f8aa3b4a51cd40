"""Nearest vectors: exactly, block of queries by block, or through an inverted file of cells around centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.store import stored

#: Queries in a block of the exact search, vectors and queries in a block of a cell, vectors that centroids are fitted on.
BLOCK, ROWS, QUERIES, SAMPLE = 500, 1024, 256, 20_000
#: Distances that a task holds at a time, however many vectors or centroids there are.
HELD = 1 << 20
#: Share of the cells that a search looks into (set for a recall of 0.9 of vectors that spread nearly evenly, as random
#: ones do; real ones take far less), rounds of the fit, and cells: some four times the root of the vectors' number, at most so many.
PROBES, ROUNDS, MOST_CELLS = 0.4, 8, 4096


def in_blocks(queries: DataFrame, key: str) -> list[DataFrame]:
    """The queries in parts of about BLOCK rows, by hash of their key."""
    parts = queries.count() // BLOCK + 1
    return [queries.where(F.pmod(F.hash(key), F.lit(parts)) == p) for p in range(parts)]


def matrix(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Vectors of a list column by their length: which rows, and the rows as a matrix; rows that are null or hold null are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    if values.null_count:
        flat = np.where(values.is_null().to_numpy(zero_copy_only=False), np.nan, flat)
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    out = {}
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        m = flat[starts[rows][:, None] + np.arange(d)]
        whole = ~np.isnan(m).any(axis=1)
        out[int(d)] = (rows[whole], m[whole])
    return out


def measure(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every query (rows) to every vector (columns)."""
    dot = q @ v.T
    if metric == "dot":
        return -dot
    a, b = (q * q).sum(axis=1)[:, None], (v * v).sum(axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dot / np.sqrt(a * b) if metric == "cosine" else np.sqrt(np.maximum(a + b - 2 * dot, 0))


def measured(v: np.ndarray, q: np.ndarray, metric: str) -> Iterator[tuple[int, np.ndarray]]:
    """``measure`` by parts of the queries, some HELD distances each: the first query's place, and the part."""
    step = max(1, HELD // max(1, len(v)))
    return ((i, measure(v, q[i : i + step], metric)) for i in range(0, len(q), step))


def closest(centers: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The nearest centroid of every point."""
    return np.concatenate([part.argmin(axis=1) for _, part in measured(centers, points, "l2")])


def exactly(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query to some vectors, without cancellation."""
    return np.sqrt(((v - q) ** 2).sum(axis=1)) if metric == "l2" else measure(v, q[None, :], metric)[0]


def best(v: np.ndarray, q: np.ndarray, k: int, metric: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query the places and distances of its ``k`` nearest vectors, and of those that tie with them after rounding."""
    for first, rough in measured(v, q, metric):
        for i, row in enumerate(rough, first):
            near = np.flatnonzero(~np.isnan(row))
            if len(near) > k:
                near = near[row[near] <= np.partition(row[near], k - 1)[k - 1] + 1e-5]
            if len(near):
                yield i, near, exactly(v[near], q[i], metric)


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, id and distance (6 places) of each query's nearest vectors, ``k`` or more of each batch of vectors.

    ``vectors`` has id and embedding, ``queries`` qid and embedding. A block of queries
    goes to the tasks as one matrix; the vectors are read once a block.
    """
    types = {c: f.dataType.simpleString() for df in (vectors, queries) for c, f in zip(df.columns, df.schema, strict=True)}
    schema = f"qid {types['qid']}, id {types['id']}, distance double"

    def of_block(rows: list) -> DataFrame:
        sides = {}
        for r in rows:
            if r.embedding and None not in r.embedding:
                sides.setdefault(len(r.embedding), []).append((r.qid, r.embedding))
        sides = {d: ([x for x, _ in s], np.array([x for _, x in s], dtype=np.float64)) for d, s in sides.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, (rows, v) in matrix(batch.column(1)).items():
                    if d not in sides or not len(rows):
                        continue
                    qids, q = sides[d]
                    found = [(i, rows[near], at) for i, near, at in best(v, q, k, metric)]
                    if found:
                        ids = batch.column(0).take(pa.array(np.concatenate([r for _, r, _ in found])))
                        qid = pa.array([qids[i] for i, r, _ in found for _ in range(len(r))])
                        yield pa.RecordBatch.from_arrays([qid, ids, pa.array(np.concatenate([a for _, _, a in found]))], ["qid", "id", "distance"])

        return vectors.select("id", "embedding").mapInArrow(run, schema)

    asked = queries.where("embedding is not null").select("qid", "embedding")
    found = reduce(DataFrame.unionByName, [of_block(part.collect()) for part in in_blocks(asked, "qid")])  # a block is some BLOCK rows
    return found.withColumn("distance", F.round("distance", 6))


def fitted(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` centroids of a sample, from rows spread over it, after a few rounds of means."""
    centers = points[np.linspace(0, len(points) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        own = closest(centers, points)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=n)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


@dataclass
class Cells:
    """Every vector in the cell of its nearest centroid, packed in blocks of some ROWS vectors (cell, ids, embeddings)."""

    centers: np.ndarray
    blocks: DataFrame
    types: tuple[str, str]

    @classmethod
    def fit(cls, vectors: DataFrame, sample: int = SAMPLE, cells: int | None = None) -> Cells:
        """Fits the centroids on at most ``sample`` vectors, by hash of their id, and assigns every vector.

        Vectors that are null, hold null or have another length than most of the sample are in no cell.
        """
        rows = [r.embedding for r in vectors.where("embedding is not null").orderBy(F.xxhash64("id")).limit(sample).select("embedding").collect()]
        rows = [r for r in rows if r and None not in r]
        d = max({len(r) for r in rows}, key=[len(r) for r in rows].count, default=0)
        points = np.array([r for r in rows if len(r) == d], dtype=np.float64).reshape(-1, d)
        n = min(cells or max(1, int(4 * math.sqrt(vectors.count()))), MOST_CELLS, max(1, len(points)))
        centers = fitted(points, n) if len(points) else np.zeros((1, max(d, 1)))
        types = (vectors.schema["id"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString())

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = matrix(batch.column(1)).get(centers.shape[1])
                if found is not None and len(found[0]):
                    own = closest(centers, found[1])
                    taken = batch.take(pa.array(found[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), taken.column(0), taken.column(1)], ["cell", "id", "embedding"])

        placed = stored(vectors.select("id", "embedding").mapInArrow(assign, f"cell long, id {types[0]}, embedding {types[1]}"))
        counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).alias("parts"))  # a row a cell, MOST_CELLS at most
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        packed = placed.join(F.broadcast(counts), "cell").groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("id", "embedding")).alias("v"))
        return cls(centers, stored(packed.select("cell", F.col("v.id").alias("ids"), F.col("v.embedding").alias("vectors"))), types)

    def nearest_rows(self, queries: DataFrame, k: int, metric: str = "l2", probes: float = PROBES) -> DataFrame:
        """qid, id and distance (6 places): of each query the ``k`` nearest, or more, in each block of the cells nearest to it.

        ``probes`` is the share of the cells; with all of them the search is exact.
        """
        centers = self.centers
        asked_cells = max(1, math.ceil(probes * len(centers)))
        qid, own = queries.schema["qid"].dataType.simpleString(), queries.schema["embedding"].dataType.simpleString()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = matrix(batch.column(1)).get(centers.shape[1])
                if found is not None and len(found[0]):
                    near = np.concatenate([part.argsort(axis=1, kind="stable")[:, :asked_cells] for _, part in measured(centers, found[1], "l2")])
                    at = pa.array(np.repeat(found[0], near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "qid", "embedding"])

        asked = stored(queries.where("embedding is not null").select("qid", "embedding").mapInArrow(probe, f"cell long, qid {qid}, embedding {own}"))
        counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
        packed = asked.join(F.broadcast(counts), "cell").groupBy("cell", F.pmod(F.xxhash64("qid"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("qid", "embedding")).alias("q"))
        packed = packed.select("cell", F.col("q.qid").alias("qids"), F.col("q.embedding").alias("queries"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, vectors, qids, asks = (batch.column(c)[i].values for c in ("ids", "vectors", "qids", "queries"))
                    (_, v), (_, q) = (next(iter(matrix(x).values())) for x in (vectors, asks))
                    found = list(best(v, q, k, metric))
                    rows = np.concatenate([near for _, near, _ in found])
                    at = np.repeat([j for j, _, _ in found], [len(near) for _, near, _ in found])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), ids.take(pa.array(rows)), pa.array(np.concatenate([a for _, _, a in found]))], ["qid", "id", "distance"])

        pairs = self.blocks.join(packed.hint("merge"), "cell").select("ids", "vectors", "qids", "queries")
        return pairs.mapInArrow(run, f"qid {qid}, id {self.types[0]}, distance double").withColumn("distance", F.round("distance", 6))

"""What the operators share: reading, durable intermediate tables, size-checked joins, components.

Every operator keeps to these rules: intermediate tables that are read more than
once are written as Parquet below the folder named by ``spark.checkpoint.dir``
(so a lost executor costs a reread, not a wrong answer), a side is broadcast only
after its rows were counted against a stated bound, and nothing of the size of
the corpus is collected.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that ends a word: U+0020 and U+0009 to U+000D, and nothing else.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
#: Rows of a few numbers up to which a counted table is broadcast.
SMALL = 200_000
#: Spark's setting to delete a query's shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Python workers then find this package also where the session was started elsewhere.

    A table of no more parts than there are cores is dealt over all of them, as its file may be one row group.
    """
    root = str(Path(__file__).parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{path}".strip(":")
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and the session is local, as in tests.

    Raises on a cluster without that setting: a folder of the driver's own would be out of the executors' sight.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def without_lines(text: Column, lost: Column) -> Column:
    """The text without the lines at the places in the array ``lost``, in time proportional to its lines."""

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    return let(F.split(text, "\n", -1), left)


def names_beside(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has or begins with, however its columns are called."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [f"{mark}{n}" for n in names]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffles behind; otherwise they stay until the driver collects its garbage, on a large heap to the end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written in the shared folder; cuts the lineage, and its shuffles go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than so many rows; stops counting soon after the bound."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int, entries: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint where a count proves the bound, else as it is (a shuffle join).

    The other columns are few numbers or short keys; with ``entries`` (of an array) the
    sum over all rows is held to the bound as well.
    """
    small = at_most(df, rows) and (entries is None or (df.agg(F.sum(entries)).first()[0] or 0) <= rows)
    return F.broadcast(df) if small else df


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df``, written, with ``place`` (its row's number in its group in that order, from 0), ``total`` (the group's rows), ``part`` and ``seq``.

    A group of any size is spread: rows are dealt by ranges of group and order, numbered
    within each range, and the ranges' counts give each one's offset. Rows that tie get
    the places in any order. Within a ``part`` rows lie by ``seq``.
    """
    p, g, offset = names_beside(df, "p", "g", "offset")
    tied = df.withColumn("seq", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(group, *order, "seq").sortWithinPartitions(group, *order, "seq")
    dealt = durable(dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)))
    counts = dealt.groupBy("part", group).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select(F.col("part").alias(p), F.col(group).alias(g), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias(offset), F.sum("n").over(whole).alias("total")))
    joined = dealt.join(maybe_broadcast(offsets, SMALL), (F.col("part") == F.col(p)) & F.col(group).eqNullSafe(F.col(g)))
    return joined.withColumn("place", F.col("seq") + F.col(offset)).drop(p, g, offset)


#: Links of one file that are drawn together at once.
LINKS = 300_000


def contracted(edges: DataFrame) -> DataFrame:
    """Links (u, v) with the same components and no shuffle: those of each task as stars around their smallest nodes."""
    kind = edges.schema["u"].dataType.simpleString()

    def stars(links: pa.Table) -> pa.RecordBatch:
        up: dict = {}

        def root(x):
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for a, b in zip(links.column(0).to_pylist(), links.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        pairs = [(x, r) for x in nodes if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], links.schema.types[0]), pa.array([r for _, r in pairs], links.schema.types[0])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LINKS:
                yield stars(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield stars(pa.Table.from_batches(held))

    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, max_rounds: int = 60, native: bool = False) -> DataFrame:
    """Connected components of (a, b): rows (node, component), component the smallest node reached.

    Each task first draws its links together into stars; then large-star and small-star
    steps alternate (both only ever relink a node to the smallest neighbour, so the links
    stay linear in the nodes) until every node has one parent that has none. The smallest
    neighbours are looked up by a broadcast of a counted table, beyond that with a join
    of two shuffled tables, so that adaptive execution can split a node with very many.
    Self-links and nulls are dropped; nodes without a link get no row. Raises if
    ``max_rounds`` do not suffice. With ``native`` no Python runs in the tasks: equal links
    are dropped instead of being drawn together.
    """
    drawn = (lambda links: links.select("u", "v").distinct()) if native else contracted

    def near(links: DataFrame) -> DataFrame:
        low = durable(links.groupBy("u").agg(F.min("v").alias("m")))
        return F.broadcast(low) if at_most(low, SMALL) else low.hint("merge")

    now = durable(drawn(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    for _ in range(max_rounds):
        stars = durable(now.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")))
        again = stars.select(F.col("m").alias("u")).distinct()
        if stars.where("m <> x").isEmpty() and stars.join(again, "u", "left_semi").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("m").alias("component")).union(again.select(F.col("u").alias("node"), F.col("u").alias("component")))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(near(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = durable(drawn(large))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now = durable(drawn(large.join(near(large), "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

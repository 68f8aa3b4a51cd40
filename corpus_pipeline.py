"""The training-corpus pipeline: stages in order, each applied to all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next one's ``docs``; all but the last return the columns of
``documents``. In every stage nulls in any column, empty and very long texts, repeated
rows, extra columns of any name and the empty table are taken: its docstring says what
they give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, line_dedup, mixing, ngram_join, quality
from sparkloom.llm.common import durable, maybe_broadcast, names_beside, read

#: Rows up to which a counted table of doc_ids is broadcast.
SMALL = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others.

    Null, empty and short texts are rejected. A null source is a host of its own, a null
    doc_id a value like others. Repeated rows stay or go together. No rows give no rows.
    """
    return quality.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated lines go, and with them documents that had no other line.

    Null and blank texts have no lines and stay as they are. Of equal rows all lose the
    same lines, the first occurrence being kept in one text, by doc_id (null first), in
    all its copies. ``n_chars``, where it is a column, follows the text. No rows give no rows.
    """
    out, kept, lost = line_dedup.thinned(docs)
    out = out.where((F.col(kept) > 0) | (F.col(lost) == 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays, once.

    Null and blank texts, and rows without a doc_id, are in no group and stay. Of several
    rows with one doc_id one stays, the first by hash of its text and its row. No rows
    give no rows.
    """
    (key,) = names_beside(docs, "key")
    columns = [f"`{c}`" for c in docs.columns]
    groups = durable(ngram_join.ngram_join(docs, width=5, percent=80))
    drop = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(maybe_broadcast(durable(drop), SMALL), "doc_id", "left_anti").select(columns)
    again = durable(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    repeated = maybe_broadcast(again, SMALL)
    order = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), mixing.row_key(docs))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias(key))
    return kept.join(repeated, "doc_id", "left_anti").select(columns).unionByName(once.select(f"{key}.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its slots' order: a row per document and slot, with the words that the slot takes from it.

    A document that the mix takes more than once or that lies across slots has several
    rows; one beyond its source's target has none, or is cut. Texts without words are in
    no slot and go. Null sources are one source; rows without a doc_id and repeated rows
    are documents of their own. No rows give no rows.
    """
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the text that they decode to: doc_id, n_tokens, ids, decoded. Null and empty texts have none; rows stay as they come."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode_tokens),
]

#: Components of links and BPE have no SQL here; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

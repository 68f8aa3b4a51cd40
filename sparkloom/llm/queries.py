"""The registered queries of this subpackage, one to an operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, embed_dedup, html_text, lattice_lm, line_dedup, merkle, mixing, ngram_join, oracles, pii, prefix_trie, quality, token_counts, toxicity
from sparkloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]

#: The vocabulary files of the BPE operator, the token counts and the lattice model; parameters of them.
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("th")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(read(spark, sf_dir, "documents"), RANKS_FILE)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(read(spark, sf_dir, "documents"))
    return out.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), BPE_FILE, digests=True)


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embed_dedup(read(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("src")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "kept_lines", "lost_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_text(read(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents")).drop("lang", "siblings")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), PIECES_FILE)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_lattice_lm": op3_lattice_lm,
        "op4_pii": op4_pii,
        "op5_bpe": op5_bpe,
        "op6_embed_dedup": op6_embed_dedup,
        "op7_mixing": op7_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_html_text": op9_html_text,
        "op10_ngram_join": op10_ngram_join,
        "op11_merkle": op11_merkle,
        "op12_token_counts": op12_token_counts,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": oracles.QUALITY, "op6_embed_dedup": oracles.EMBED_DEDUP, "op10_ngram_join": oracles.NGRAM_JOIN, "op11_merkle": oracles.MERKLE, "op13_prefix_trie": oracles.PREFIX_TRIE}

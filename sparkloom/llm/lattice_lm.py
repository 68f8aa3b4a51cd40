"""Subword-lattice language model: a word's probability sums over all its segmentations.

One vocabulary has the pieces of a public byte-level vocabulary, whose ranks are the
scores that they come with (a piece of rank r has weight 1 / (r + 10)), and every word
of the training documents as a piece of its own. A word is written with a blank before
it; its lattice has an arc for each piece at each place, and one arc over all of it
where the word itself is a piece. The forward recursion adds up all paths in logs.

Scores are one distribution: a word piece that occurred c times in N tokens has
(c - D) / N, and what the discounts D of the V different words leave, D V / N, goes to
the subword paths (D by Ney from the counts of counts). These add up to one over all
words, as a word's end is told by the blank of the next piece. Two passes of
forward-backward over the distinct training words turn the subword pieces' scores into
expected relative frequencies. Pieces do not cross white space, so a text's marginal
probability is the product of its words' and the end's, and a word, however often it
occurs, needs its lattice once: distinct words are counted, scored and joined back.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable
from sparkloom.llm.shingles import text_words

LOG10 = log(10)
BLANK = set(b" \t\n\x0b\x0c\r")
#: The end of a text as a word; it can be in no text.
END = b"\n"
#: Bytes up to which words of one length go through the lattice together; longer ones go one by one.
LONG = 48
#: Distinct words that are counted or scored at once in a task.
AT_ONCE = 200_000
#: Every task knows the words that are at least one in so many tokens (so there are no more of them); the others come by a join.
COMMON = 1_000_000


def start_scores(path: str) -> dict[bytes, float]:
    """Log weights of the vocabulary's pieces that can stand in a word with one leading blank."""
    pieces = {}
    with open(path, "rb") as f:
        for line in f:
            piece, rank = line.split()
            piece = base64.b64decode(piece)
            if len(piece) == 1 or (piece == piece.lower() and not set(piece[1:]) & BLANK and piece[0] not in BLANK - {32}):
                pieces[piece] = 1 / (int(rank) + 10)
    total = sum(pieces.values())
    return {p: log(w / total) for p, w in pieces.items()}


def log_add(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


class Lattice:
    """The pieces as a trie in arrays, with their scores; walks many words of one length at a time."""

    def __init__(self, scores: dict[bytes, float]):
        self.pieces = sorted(scores)
        self.score = np.array([scores[p] for p in self.pieces])
        edges: dict[int, int] = {}
        ends = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if (node := edges.get(key, -1)) < 0:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = number
        self.ends = np.array(ends)
        self.bits = max(4, len(edges).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.full(1 << self.bits, -1, np.int64)
        for key, node in edges.items():
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (1 << self.bits) - 1
            self.keys[slot], self.next[slot] = key, node

    @functools.cached_property
    def table(self) -> dict[bytes, int | None]:
        """Piece numbers, and None for what only begins a piece: a walk over a single word stops where nothing begins."""
        out: dict[bytes, int | None] = {}
        for piece in self.pieces:
            for k in range(1, len(piece)):
                out.setdefault(piece[:k])
        return out | {p: k for k, p in enumerate(self.pieces)}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's nodes one byte on; -1 where there is none."""
        key = node << 8 | byte
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        while len(other := np.flatnonzero((held != key) & (held >= 0))):
            slot[other] = (slot[other] + 1) & (1 << self.bits) - 1
            held[other] = self.keys[slot[other]]
        return np.where(held == key, self.next[slot], -1)

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of the lattices of words (n, bytes), by start."""
        n, size = words.shape
        everything = np.arange(n)
        for start in range(size):
            rows, node = everything, np.zeros(n, np.int64)
            for end in range(start + 1, size + 1):
                node = self.step(node, words[rows, end - 1])
                keep = node >= 0
                if not keep.all():
                    rows, node = rows[keep], node[keep]
                if not len(rows):
                    break
                piece = self.ends[node]
                hit = piece >= 0
                if hit.any():
                    yield start, end, rows[hit], piece[hit]

    def forward(self, words: np.ndarray) -> np.ndarray:
        """Log probabilities, summed over all segmentations, of words of one length."""
        ahead = np.full((words.shape[1] + 1, len(words)), -np.inf)
        ahead[0] = 0
        for start, end, rows, piece in self.arcs(words):
            ahead[end, rows] = np.logaddexp(ahead[end, rows], ahead[start, rows] + self.score[piece])
        return ahead[-1]

    def expected(self, words: np.ndarray) -> np.ndarray:
        """How often each piece occurs in the segmentations of words of one length, on average, in all."""
        size = words.shape[1]
        ahead = np.full((size + 1, len(words)), -np.inf)
        back = ahead.copy()
        ahead[0] = back[size] = 0
        lattice = list(self.arcs(words))
        for start, end, rows, piece in lattice:
            ahead[end, rows] = np.logaddexp(ahead[end, rows], ahead[start, rows] + self.score[piece])
        share = []
        for start, end, rows, piece in reversed(lattice):
            s = self.score[piece] + back[end, rows]
            share.append(np.exp(ahead[start, rows] + s - ahead[size, rows]))
            back[start, rows] = np.logaddexp(back[start, rows], s)
        return np.bincount(np.concatenate([x[3] for x in reversed(lattice)]), np.concatenate(share), len(self.pieces))

    def arcs_of(self, word: bytes) -> list[tuple[int, int, int]]:
        """(start, end, piece) of one word's lattice, by start."""
        out = []
        for start in range(len(word)):
            for end in range(start + 1, len(word) + 1):
                piece = self.table.get(word[start:end], -1)
                if piece == -1:
                    break
                if piece is not None:
                    out.append((start, end, piece))
        return out

    def forward_of(self, word: bytes) -> list[float]:
        """Log probabilities of one word's prefixes, summed over all segmentations."""
        out: list[float | None] = [0.0] + [None] * len(word)
        for start, end, piece in self.arcs_of(word):
            s = self.score[piece] + out[start]
            out[end] = s if out[end] is None else log_add(out[end], s)
        return out

    def expected_of(self, word: bytes) -> dict[int, float]:
        """``expected`` of one word."""
        ahead, back = self.forward_of(word), [None] * len(word) + [0.0]
        out: dict[int, float] = {}
        for start, end, piece in reversed(self.arcs_of(word)):
            s = self.score[piece] + back[end]
            out[piece] = out.get(piece, 0.0) + exp(ahead[start] + s - ahead[-1])
            back[start] = s if back[start] is None else log_add(back[start], s)
        return out


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes with the leading blank as a matrix) of the words of each length up to LONG."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes[sizes < LONG]):
        at = np.flatnonzero(sizes == size)
        for low in range(0, len(at), 20_000):
            part = at[low : low + 20_000]
            raw = np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), size)
            yield part, np.hstack([np.full((len(part), 1), 32, np.uint8), raw])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (its count in training documents), n (in all), the ends of texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> Iterator[pa.RecordBatch]:
            for c, train in zip(seen, (True, False), strict=True):
                n = pa.array(c.values(), pa.int64())
                zero = pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), n if train else zero, n], ["word", "c", "n"])
                c.clear()

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = seen[held]
                c.update(text_words(text.as_py()))
                c[END] += 1
                if len(c) >= AT_ONCE:
                    yield from rows()
        yield from rows()

    found = docs.select(held_out().alias("held_out"), "text").mapInArrow(run, "word binary, c long, n long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to AT_ONCE rows and more."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def learned_scores(words: DataFrame, path: str, passes: int = 2, smooth: float = 0.1) -> dict[bytes, float]:
    """The subword pieces' log probabilities, as many as the vocabulary: after each pass the expected
    counts over the distinct training words (new words resemble those more than running text),
    each piece ``smooth`` more."""
    scores = start_scores(path)
    for _ in range(passes):
        shared = words.sparkSession.sparkContext.broadcast(Lattice(scores))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = shared.value
            total = np.zeros(len(lattice.pieces))
            for table in gathered(batches):
                found = table.column(0).to_pylist()
                for _, several in by_length(found):
                    total += lattice.expected(several)
                for word in found:
                    if len(word) >= LONG:
                        for piece, e in lattice.expected_of(b" " + word).items():
                            total[piece] += e
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "e"])

        got = words.where(F.col("c") > 0).where(F.col("word") != F.lit(END)).select("word").mapInArrow(run, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e"))
        counts = np.full(len(scores), smooth)
        for row in got.collect():
            counts[row.piece] += row.e
        scores = dict(zip(sorted(scores), np.log(counts / counts.sum()).tolist(), strict=True))
    return scores


def discounts(tokens: int, different: int, once: int, twice: int) -> tuple[float, float, float]:
    """(log of the share of subword paths, discount D, tokens): the end of a text counts once more, so that it is always a piece."""
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.75
    return log(d * max(1, different) / (tokens + 1)), d, tokens + 1


def score(docs: DataFrame, path: str) -> DataFrame:
    """Log10 probabilities of every row of ``docs`` (doc_id, text).

    Documents whose crc32 of doc_id as text leaves 2 on division by 7 are held out; the
    others train. Returns doc_id, held_out, n_tokens (words and the end), n_known (tokens
    that occur in training), train_tokens, base_score (add-one word unigrams), lattice_score
    (the marginal of the subword pieces alone: the end of a text by its share of the tokens,
    every word by all its segmentations) and score (the lattice's marginal with words as pieces too, which spells unknown words, while the base gives each of
    them the same and leaves its letters unsaid). Words have A-Z in lower case. Null and
    empty texts are the end alone; a null doc_id is not held out. Repeated rows of a
    doc_id are told apart by their text; equal ones count as training each and give equal
    rows. Without training documents the scores come from smoothing alone. An empty table
    gives an empty result. Other columns are not read; texts and words are taken whole.
    """
    spark = docs.sparkSession
    words = durable(word_counts(docs).repartition(4 * spark.sparkContext.defaultParallelism))
    count = lambda c: F.count_if(F.col("c") == c)
    ends = F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    n, v, once, twice, tokens, ends = (x or 0 for x in words.agg(F.sum("c"), F.count_if(F.col("c") > 0), count(1), count(2), F.sum("n"), ends).first())
    new, less, of = discounts(n, v, once, twice)
    end = (ends + 1) / (n + 2)
    shared = spark.sparkContext.broadcast(Lattice(learned_scores(words, path)))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for table in gathered(batches):
            found = table.column(0).to_pylist()
            c = table.column(1).to_numpy() + np.array([w == END for w in found])
            spelt = np.full(len(found), -np.inf)
            for at, several in by_length(found):
                spelt[at] = lattice.forward(several)
            for k, word in enumerate(found):
                if len(word) >= LONG:
                    spelt[k] = lattice.forward_of(b" " + word)[-1]
                elif word == END:
                    spelt[k] = -np.inf
            lp = new + spelt
            alone = np.where([w == END for w in found], log(end), log1p(-end) + spelt) / LOG10
            whole = np.log(np.maximum(c - less, 1e-300) / of)
            lp = np.where(c > 0, np.logaddexp(lp, whole), lp) / LOG10
            yield from pa.table({"word": table.column(0), "c": table.column(1), "n": table.column(2), "lp": lp, "alone": alone}).to_batches()

    scored = durable(words.select("word", "c", "n").mapInArrow(marginal, "word binary, c long, n long, lp double, alone double"))
    common = scored.where(F.col("n") * COMMON >= tokens).select("word", "c", "lp", "alone").toArrow()
    keys = pd.util.hash_array(np.array(common.column(0).to_pylist(), dtype=object), categorize=False) if common.num_rows else np.empty(0, np.uint64)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], *(common.column(c).to_numpy()[order] for c in (1, 2, 3))))
    base = lambda c: np.log10((c + 1) / (n + v + 1))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "th", "held_out", "word", "n", "n_known", "base", "lp", "alone"]
    fields = f"doc_id {kind}, th long, held_out boolean, word binary, n long, n_known long, base double, lp double, alone double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, probabilities, pure = known.value

        def rows(batch: pa.RecordBatch, low: int, found: list[bytes], sizes: list[int]) -> pa.RecordBatch:
            """A row per text with the sums of its common words, and one per other word."""
            doc = np.repeat(np.arange(len(sizes)), sizes)
            all_words = np.array(found, dtype=object)
            at, rare = np.zeros(len(found), np.int64), np.ones(len(found), bool)
            if len(keys) and len(found):
                hashes = pd.util.hash_array(all_words, categorize=False)
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                rare = keys[at] != hashes
            here, which = doc[~rare], at[~rare]
            sums = [np.bincount(here, w, len(sizes)) for w in (np.ones(len(here)), counts[which] > 0, base(counts[which]), probabilities[which], pure[which])]
            other = np.flatnonzero(rare)
            take = pa.array(np.concatenate([np.arange(len(sizes)), doc[other]]) + low)
            nulls = pa.nulls(len(other), pa.int64())
            columns = [pa.concat_arrays([pa.nulls(len(sizes), pa.binary()), pa.array(all_words[other], pa.binary())])]
            columns.append(pa.concat_arrays([pa.array(sums[0].astype(np.int64)), pa.array(np.ones(len(other), np.int64))]))
            columns.append(pa.concat_arrays([pa.array(sums[1].astype(np.int64)), nulls]))
            columns += [pa.concat_arrays([pa.array(x.astype(np.float64)), nulls.cast(pa.float64())]) for x in sums[2:]]
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), *columns], names)

        for batch in batches:
            low, found, sizes = 0, [], []
            for i, text in enumerate(batch.column(3)):
                own = text_words(text.as_py())
                own.append(END)
                found += own
                sizes.append(len(own))
                if len(found) >= AT_ONCE or i == batch.num_rows - 1:
                    yield rows(batch, low, found, sizes)
                    low, found, sizes = i + 1, [], []

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), held_out().alias("held_out"), "text").mapInArrow(run, fields)
    rows = durable(rows)
    rest = rows.where("word is not null").select("doc_id", "th", "held_out", "word")
    got = rest.join(scored.select("word", "c", F.col("lp").alias("p"), F.col("alone").alias("pure")).hint("merge"), "word").select(
        "doc_id", "th", "held_out", F.lit(1).alias("n"), F.when(F.col("c") > 0, 1).otherwise(0).alias("n_known"),
        F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"), F.col("p").alias("lp"), F.col("pure").alias("alone"), F.lit(0).alias("rows"),
    )
    whole = rows.where("word is null").select("doc_id", "th", "held_out", "n", "n_known", "base", "lp", "alone", F.lit(1).alias("rows"))
    sums = whole.unionByName(got).groupBy("doc_id", "th", "held_out").agg(F.sum("rows").alias("r"), *(F.sum(x).alias(x) for x in ("n", "n_known", "base", "lp", "alone")))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("r").cast("int"))))
    return each.select(
        "doc_id", "held_out", (F.col("n") / F.col("r")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("r")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("r")).alias("base_score"), (F.col("lp") / F.col("r")).alias("score"), (F.col("alone") / F.col("r")).alias("lattice_score"),
    )

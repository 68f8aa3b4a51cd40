"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector for all ordered
thresholds; the answer is the expected grade. Labels only say whether a text is toxic,
so its grade is taken from other texts: the sample is parted in two, and a toxic text of
one part has grade 1, 2 or 3 by the share of its words that stand, in the other part, in
toxic texts alone. No text's grade comes from its own label's effect on the words.
Features say that a word or a word's first four or five letters occur in the text. Fitted on a
bounded sample of labelled rows (``sample`` of each label, by hash of doc_id), then
applied to every document where it lies: the model has an entry for each feature that
tells the sample's labels apart, and no more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable

WORD = re.compile(r"[^\W\d_]+")
#: Least G statistic of a feature; chance exceeds it for one in 600.
TELLING = 10
#: Lower bounds of the share of words that the other part has in toxic texts alone, for grades 2 and 3.
DENSE = (0.01, 0.03)


def text_features(text: str | None) -> set[str]:
    """Words in lower case, and with a star their first four and five letters."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {f"{w[:4]}*" for w in words if len(w) > 4} | {f"{w[:5]}*" for w in words if len(w) > 5}


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """d (doc_id), t (toxic), part (0 or 1), f (features) and n_words (distinct words) of at most ``sample`` labelled documents of either label, the first by hash."""
    marked = labels.select(F.col("doc_id").alias("d"), F.col("toxic").alias("t")).where("d is not null and t in (0, 1)").groupBy("d").agg(F.max("t").alias("t"))
    picked = [marked.where(F.col("t") == t).orderBy(F.xxhash64("d"), "d").limit(sample) for t in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(text_features(x.as_py())) for x in batch.column(3)]
            words = pa.array([sum(w[-1] != "*" for w in x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sets, pa.list_(pa.string())), words], ["d", "t", "part", "f", "n_words"])

    part = F.pmod(F.shiftright(F.xxhash64("d"), 7), F.lit(2)).cast("int")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("d")).select("doc_id", F.col("t").cast("int"), part.alias("part"), "text")
    return texts.distinct().mapInArrow(run, f"d {kind}, t int, part int, f array<string>, n_words long")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, rounds: int = 500, ridge: float = 0.01) -> dict:
    """The model: weights by feature, thresholds, and the cut of P(grade > 0) with the best F1 on the sample,
    its labels weighted as in the whole table.

    ``labels`` has doc_id and toxic. Rows without a doc_id or a toxic of 0 or 1
    are not labels; of several labels of a document the worst counts. Null and empty texts have no features; equal rows of a document count once,
    different texts of it each. Features are all those of the sample with a G statistic
    of presence against label of TELLING or more. Without a document of either label
    (an empty table too) the model says grade 0 for all. doc_ids are of any type that
    has an order; other columns are not read.
    """
    drawn = durable(sample_rows(docs, labels, sample).withColumn("r", F.monotonically_increasing_id()))
    n = {r["t"]: r["count"] for r in drawn.groupBy("t").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {"cut": 0.5, "weights": {}, "thetas": [30.0]}
    each = drawn.select("r", "t", "part", F.explode("f").alias("f"))
    part = lambda x, m: F.when(F.col(x) > 0, 2 * F.col(x) * F.log(F.col(x) * (n1 + n0) / ((F.col("a") + F.col("b")) * m))).otherwise(0)
    both = [F.sum(F.when(F.col("part") == k, F.col("t")).otherwise(0)).alias(f"a{k}") for k in (0, 1)] + [F.sum(F.when(F.col("part") == k, 1 - F.col("t")).otherwise(0)).alias(f"b{k}") for k in (0, 1)]
    told = each.groupBy("f").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"), *both).withColumn("g", part("a", n1) + part("b", n0))
    told = sorted(told.where(F.col("g") >= TELLING).select("f", "a0", "a1", "b0", "b1").collect(), key=lambda r: r["f"])
    names = [r["f"] for r in told]
    number = {f: k for k, f in enumerate(names)}
    only = [{r["f"] for r in told if r[f"a{k}"] and not r[f"b{k}"] and r["f"][-1] != "*"} for k in (0, 1)]
    rows = drawn.select("r", "t", "part", "n_words")
    if names:
        known = drawn.sparkSession.createDataFrame([(f,) for f in names], "f string")
        held = each.join(F.broadcast(known), "f").groupBy("r").agg(F.array_sort(F.collect_list("f")).alias("held"))
        rows = rows.join(held, "r", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("held", F.array().cast("array<string>"))
    rows = sorted(rows.select("t", "part", "n_words", "held").collect())  # equal rows are alike: the sums below are the same in every run
    toxic = np.array([r["t"] for r in rows])
    share = np.array([len(only[1 - r["part"]].intersection(r["held"])) / max(1, r["n_words"]) for r in rows])
    grade = toxic * (1 + sum((share >= d).astype(int) for d in DENSE))
    hits = [[number[f] for f in r["held"]] for r in rows]
    levels = np.unique(grade)
    doc = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    feat = np.concatenate([np.array(h, int) for h in hits]) if len(doc) else np.empty(0, int)
    over = (grade[:, None] >= levels[None, 1:]).astype(float)
    weights, thetas = np.zeros(len(names)), np.linspace(0, len(levels) - 2, len(levels) - 1)
    gw, gt = np.full(len(names), 1e-6), np.full(len(thetas), 1e-6)
    for _ in range(rounds):
        z = np.bincount(doc, weights[feat], len(hits)) if len(doc) else np.zeros(len(hits))
        err = 1 / (1 + np.exp(np.clip(thetas[None, :] - z[:, None], -30, 30))) - over
        dw = np.bincount(feat, err.sum(1)[doc], len(names)) / len(hits) + ridge * weights / 100
        dt = -err.mean(0)
        gw += dw * dw
        gt += dt * dt
        weights -= dw / np.sqrt(gw)
        thetas = np.maximum.accumulate(thetas - 0.5 * dt / np.sqrt(gt))
    z = np.bincount(doc, weights[feat], len(hits)) if len(doc) else np.zeros(len(hits))
    p = 1 / (1 + np.exp(np.clip(thetas[0] - z, -60, 60)))
    cuts = np.unique(p)
    of = {r["toxic"]: r["count"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    weight = np.where(toxic == 1, of[1] / n1, of[0] / n0)
    f1 = [2 * (toxic * weight * (p >= c)).sum() / (of[1] + (weight * (p >= c)).sum()) for c in cuts]
    best = int(np.argmax(f1))  # of equal ones the lowest
    cut = float(cuts[best] + (cuts[best - 1] if best else cuts[0])) / 2
    return {"cut": cut, "weights": dict(zip(names, weights.tolist(), strict=True)), "thetas": thetas.tolist(), "levels": levels.tolist()}


def severity(docs: DataFrame, model: dict) -> DataFrame:
    """Severity of every row of ``docs`` (doc_id, text): doc_id, p_toxic, expected_severity, grade, toxic, n_features.

    p_toxic is P(grade > 0), expected_severity the expected grade, grade the likeliest,
    toxic whether p_toxic reaches the model's cut, n_features how many of the model's
    features the text has. Null and empty texts have none and get the model's base rate;
    texts are read whole; rows are kept as they come, repeated ones and null doc_id
    included. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights, thetas = model["weights"], np.array(model["thetas"])
        steps = np.diff(np.array(model.get("levels", range(len(thetas) + 1)), float))
        levels = np.concatenate([[0.0], np.cumsum(steps)])
        for batch in batches:
            z, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(1)):
                found = [weights[f] for f in text_features(text.as_py()) if f in weights]
                z[k], n[k] = sum(sorted(found)), len(found)
            above = 1 / (1 + np.exp(np.clip(thetas[None, :] - z[:, None], -60, 60)))
            each = np.hstack([np.ones((len(z), 1)), above]) - np.hstack([above, np.zeros((len(z), 1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above[:, 0]), pa.array(above @ steps), pa.array(levels[each.argmax(1)].astype(np.int32)), pa.array(above[:, 0] >= model["cut"]), pa.array(n)],
                ["doc_id", "p_toxic", "expected_severity", "grade", "toxic", "n_features"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_toxic double, expected_severity double, grade int, toxic boolean, n_features long")

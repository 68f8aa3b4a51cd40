"""Scores within the tasks: against plain ones, with ties, and with no shuffle of hits."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.operators import build as B
from sparkloom.operators import evaluation as E
from sparkloom.operators import scoring as C
from sparkloom.operators import search as R
from sparkloom.operators.index import Index
from sparkloom.plans import query_plan as P


def test_finder_finds_what_in_finds():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abé", k=rng.randrange(n)))
    texts = [word(60) for _ in range(200)] + ["", "a", "abababababababababababab"]
    terms = list(dict.fromkeys([*(word(5) for _ in range(60)), *(t[3 : 3 + n] for t, n in zip(texts, range(200), strict=False)), "abababababababababababab", "b" * 8, "b" * 9]))
    terms = [t for t in terms if t]
    rows, found, whole = C.Finder(terms).find(pa.array(["x", *texts])[1:])
    assert {(r, f): bool(w) for r, f, w in zip(rows, found, whole, strict=True)} == {(i, j): t == s for i, s in enumerate(texts) for j, t in enumerate(terms) if t in s}


def test_best_of_ties():
    rng = np.random.default_rng(2)
    for k in (1, 7):
        best, every = C.Best(3, k, np.full(3, -np.inf)), []
        for batch in range(40):
            query, score = rng.integers(0, 3, 50), rng.integers(0, 3, 50).astype(float)
            ids = pa.array([f"{rng.integers(1e6)}-{batch}-{i}" for i in range(50)])
            best.add(query, score, C.ties(ids), ids, np.arange(50), np.ones(50))
            best.settle()
            every += [(q, -s, i) for q, s, i in zip(query, score, ids.to_pylist(), strict=True)]
        query, score, _, ids, _ = best.rows()
        wanted = [x for q in range(3) for x in sorted(x for x in every if x[0] == q)[:k]]
        assert sorted(zip(query, -score, ids, strict=True)) == wanted


def test_terms_are_counted_in_their_row(spark):
    texts = ["b a b", "", None, "c", "à a A"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.counted(X.terms_of(F.coalesce("t", F.lit("")))).alias("x"))
    assert [[tuple(x) for x in r.x] for r in got.collect()] == [[("a", 1), ("b", 2)], [], [], [("c", 1)], [("a", 3)]]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_searches_shuffle_no_hits(spark, monkeypatch):
    chunk = "id string, symbol_name string, path string, signature string, text_raw string"
    c = spark.createDataFrame([(f"c{k:03}", f"The{k % 7}", f"a{k % 9}/b.kt", None, f"the word {k % 5}") for k in range(300)], chunk)
    c = c.withColumns({"symbol_fqname": F.col("symbol_name"), "tags": F.array(F.lit("t")), "kind": F.lit("class"), "language": F.lit("kotlin"), "module": F.lit(":a"), "start_line": F.expr("int(substring(id, 2))")})
    index, plans = Index(c), P.plan(spark.createDataFrame([(q, f"the word {q}") for q in range(9)], "qid long, query string"))
    monkeypatch.setattr(C, "BLOCK", 7)
    monkeypatch.setattr(C, "PLANS", 2)
    monkeypatch.setattr(C, "CELLS", 50)
    variants = plans.select("qid", F.inline("variants"))
    every = R.bm25(index, variants)
    assert "Exchange" not in every._jdf.queryExecution().executedPlan().toString()
    key = lambda df: {tuple(r) for r in df.select("qid", "id", "score").collect()}
    for k in (1, 4):
        order = F.desc("score"), F.col("id")
        assert key(R.bm25_top(index, variants, k).where("name = 'broad'")) == key(R.ranked(every.where("name = 'broad'"), k, *order))
        order = F.desc("score"), F.col("path"), F.col("start_line")
        assert key(R.ranked(R.symbol_scores(index, plans, k), k, *order)) == key(R.ranked(R.symbol_scores(index, plans), k, *order))
        near = {"kind": "class", "tags": ("T",)}
        assert key(R.bm25_top(index, variants, k, filters=near)) == key(R.bm25_top(index, variants, k))


def test_class_metrics_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    made = [(i, rng.choice([1, 1, 2, 3, None]), 1 + rng.randrange(3)) for i in range(60)] + [(60, 9, 1)]
    items = spark.createDataFrame(made, "item long, label int, gain long")
    asked = spark.createDataFrame([(i, label) for i, label, _ in made if i % 4 == 0] + [(500, 2), (501, 7)], "query long, label int")
    found = spark.createDataFrame([(q, i, r) for q in (*range(0, 61, 4), 500) if q % 3 for r, i in enumerate(rng.sample(range(61), 12), 1)], "query long, item long, rank long")
    pairs = items.join(asked, "label").where("item <> query").select("query", "item", "gain")
    for k in (1, 5, 100):
        got = E.class_metrics(found, items, asked, k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.rank_metrics(found, pairs, k).collect())) and got.count() > 9


def test_pipeline_decodes_what_it_encodes(spark):
    import corpus_pipeline

    texts = ["Zwei Wörter", "", None, "a<|endoftext|> b\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.encode_tokens(spark, docs, "").collect()
    assert [r.decoded for r in sorted(out, key=lambda r: r.doc_id)] == [t or "" for t in texts]


def test_built_postings_lie_with_their_chunks(spark, tmp_path):
    made = [("/repo/1", f"a{k}.kt", f"fun f{k}() a a b") for k in range(20)]
    files = spark.createDataFrame(made, "repo_path string, path string, content string")
    store = B.Store(spark, str(tmp_path / "index"))
    store.build(files, "v1")
    assert "Exchange" not in B.chunk_postings(store.chunks)._jdf.queryExecution().executedPlan().toString()
    got = store.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    assert {r.term: (r.df, r.cf) for r in got.where("term in ('a', 'b')").collect()} == {"a": (20, 40), "b": (20, 20)}

"""Queries that read the chunks once derive them, and no more of them than they read."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import nearest as N
from sparkloom.operators import structure as S
from sparkloom.operators.index import Index, Tables, frequencies, terms_in
from sparkloom.plans import registry
from sparkloom.sources import store
from sparkloom.sources import views as V

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tree_text", "source_context", "postings_df"])
def test_no_table_of_chunks_is_written(spark, name, monkeypatch):
    monkeypatch.setattr(Tables, "of", lambda *_: pytest.fail("the whole table of chunks is written"))
    assert registry.queries()[name](spark, DATA).limit(1).count() == 1


def test_a_map_makes_no_sketch(spark):
    plan = S.tree(V.chunks(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "regexp" not in plan.split("Relation")[0].replace("/src/", "")


def test_small_tables_are_dealt_into_some_parts_a_core(spark):
    assert store.spread(spark.range(9).coalesce(1)).rdd.getNumPartitions() == store.WAVES * spark.sparkContext.defaultParallelism
    many = spark.range(0, 99, 1, 50)
    assert store.spread(many).rdd.getNumPartitions() == 50


@pytest.mark.parametrize("rows", [100, 0])
def test_sources_of_files_listed_twice(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "small", lambda t: F.broadcast(t) if rows else t)
    files = spark.createDataFrame([("r", "a", "1\n2\r\n3\n4"), ("r", "a", "1\n2\r\n3\n4"), ("r", "b", "x"), ("q", "a", "other")], "repo_path string, path string, content string")
    c = [("c1", "r", "a", "class", "The", "m.The", 2, 2, "2"), ("c2", "r", "b", "class", "No", "m.No", 1, 1, "x")]
    chunks = spark.createDataFrame(c, "id string, repo_path string, path string, kind string, symbol_name string, symbol_fqname string, start_line long, end_line long, text_raw string")
    got = S.sources(chunks, files, "The", 1, 1)
    assert [tuple(r) for r in got.collect()] == [("c1", "a", "class", "The", "2-2", "2", "1", "3")]


def test_frequencies_are_those_of_the_index(spark):
    c = V.chunks(spark, DATA)
    rows = lambda df: sorted(map(tuple, df.select("term", "df", "cf").collect()))
    assert rows(frequencies(terms_in(c))) == rows(Index(c).terms)


def test_distances_held_at_a_time_are_bounded(monkeypatch):
    rng = np.random.default_rng(5)
    points, centers = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    whole, seen, measure = N.measure(centers, points, "l2"), [], N.measure
    nearest = [(i, sorted(near.tolist())) for i, near, _ in N.best(points, centers, 5, "l2")]
    monkeypatch.setattr(N, "HELD", 1000)
    monkeypatch.setattr(N, "measure", lambda v, q, metric: seen.append(len(v) * len(q)) or measure(v, q, metric))
    assert (N.closest(centers, points) == whole.argmin(axis=1)).all() and N.fitted(points, 40).shape == (40, 8)
    assert [(i, sorted(near.tolist())) for i, near, _ in N.best(points, centers, 5, "l2")] == nearest
    assert len(seen) > 20 and max(seen) <= 1000


@pytest.mark.parametrize("name", ["file_summary", "chunks"])
def test_files_without_symbols_and_of_wide_spaces(spark, tmp_path, name):
    texts = ["12\n34", "1\n\n\n\n\nAb", "\u00a0\u3000", "\u2003Cd e\u00a0\nf", " ", "", None, "\u00a0\n1", "A\n" * 6 + "7"]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()[name](spark, str(tmp_path))
    sql = registry.oracle_sql()[name]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want

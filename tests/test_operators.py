"""Golden facts of the operators on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.operators import evaluation as E
from sparkloom.operators import packaging as K
from sparkloom.operators import search as R
from sparkloom.operators import structure as S
from sparkloom.operators import telemetry as T


def test_rrf_goldens(spark):
    left = spark.createDataFrame([(1, "a", 1, "exact"), (1, "b", 4, "broad"), (1, "c", 1, "exact"), (2, "a", 1, "exact")], "qid long, id string, rank long, variants string")
    right = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "d", 2)], "qid long, id string, rank long")
    got = {(r.qid, r.id): (r.rrf, r.source) for r in R.rrf(left, right).collect()}
    assert got[1, "a"] == (round(1 / 61 + 1 / 62, 9), "both") and got[1, "d"] == (round(1 / 62, 9), "vector") and got[2, "a"][1] == "lexical"
    assert got[1, "a"][0] > got[1, "b"][0]


def test_savings(spark):
    rows = [("search", 500, 3000), ("search", 600, 4000), ("map", 200, 10000), ("zero", 5, 0)]
    got = {r.tool: r for r in T.usage_by_tool(spark.createDataFrame(rows, "tool string, tokens_sent long, tokens_raw long")).collect()}
    assert got["map"].saved_pct == 98.0 and got["search"].saved_pct == 84.3 and got["zero"].saved_pct is None


def test_round_half_up(spark):
    got = [r[0] for r in spark.createDataFrame([(-2.25,), (2.25,), (-2.26,)], "x double").select(X.round_half_up(F.col("x"))).collect()]
    assert got == [-2.2, 2.3, -2.3]


def test_guided_reads_ties(spark):
    t, u = datetime(2024, 1, 1), datetime(2024, 1, 2)
    search, read = "mcp__engine__engine_search", "Read"
    rows = [(1, 1, t, search, True), (1, 2, u, read, True), (1, 3, u, "Grep", True), (1, 4, u, read, True), (2, 5, t, read, True), (3, 6, t, "pi:engine_lookup", True), (3, 7, t, "Edit", True), (3, 8, t, "pi:read", True), (3, 9, t, read, False)]
    rows += [(4, 1, t, "Grep", True), (4, 2, t, search, True), (4, 3, u, read, True)]  # at one time the native call wins, whatever the order
    df = spark.createDataFrame(rows, "sid long, seq long, t timestamp, tool string, is_code boolean")
    assert {(r.sid, r.seq, r.guided_by) for r in T.guided_reads(df).collect()} == {(1, 2, "search"), (3, 8, "lookup")}


def test_tools(spark):
    rows = ["mcp__engine__engine_search", "mcp__my-engine-x__map", "pi:engine_deps", "pi:engine_status", "Read", "pi:grep", "pi:edit", "Bash", "mcp__other__search", "mcp__engine__engine_export", "pi:search"]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "t string").select(X.categorize(F.col("t")), X.tool_short(F.col("t"))).collect()]
    assert got == [("engine", "search"), ("engine", "map"), ("engine", "deps"), ("admin", "status"), ("native", "Read"), ("native", "Grep"), ("other", "Edit"), ("other", "Bash"), ("other", "search"), ("admin", "export"), ("other", "Search")]


def test_symbols_of_names(spark):
    rows = ["src/UserStore.d.ts", "user-store.ts", "a/index.ts", "plain.py", "Ab.kt", ""]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(X.symbol_of_path(F.col("p"))).collect()] == ["UserStore", "UserStore", None, None, None, None]
    rows = ["user_service", "a.b.UserX()", "`Foo1`", "word", "src/My.kt", "ab", "  "]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(X.symbol_of(F.col("p"))).collect()] == ["UserService", "UserX", "Foo1", None, None, None, None]


def test_paths(spark):
    rows = [("app/ui/src/main/A.kt",), ("src/test/b.gradle.kts",), ("x.D.TS",), ("README",), (None,), ("",), ("a.",)]
    df = spark.createDataFrame(rows, "p string")
    got = [tuple(r) for r in df.select(X.classify(F.col("p")), X.module_of(F.col("p")), X.source_set_of(F.col("p")), X.path_extension(F.col("p"))).collect()]
    assert got == [("kotlin", ":app:ui", "main", ".kt"), ("gradle", None, None, ".kts"), ("typescript", None, None, ".d.ts"), ("other", None, None, "(no ext)"), ("other", None, None, "(unknown)"), ("other", None, None, "(unknown)"), ("other", None, None, ".")]


def test_budget_and_diversity(spark):
    df = spark.createDataFrame([(1, f"i{k}", "p" if k < 6 else "q", k, 10) for k in range(1, 9)], "qid long, id string, path string, rank long, tokens long")
    kept = K.diverse(df, 3)
    assert kept.where("path = 'p'").count() == 3
    assert [r.rank for r in K.within_budget(kept, 35).orderBy("rank").collect()] == [1, 2, 3]


def test_highlights(spark):
    text = "fun load() {\n  first line\n\n}\n  load\nnone here"
    df = spark.createDataFrame([(text, "fun load() {", ["load"]), (text, None, ["absent"]), ("", None, ["x"])], "t string, s string, q array<string>")
    got = [r[0] for r in df.select(K.highlights(F.col("t"), F.col("s"), F.col("q"))).collect()]
    assert got == [["fun load() {", "load"], ["fun load() {", "first line", "load", "none here"], []]


def test_csv_and_changes(spark):
    cells = "id long, tool string, repo string, called_at string, duration_ms long, tokens_sent long, tokens_raw long, channel string, model string"
    rows = spark.createDataFrame([(1, "a,b", 'say "x"', "t", 2, 3, None, "mcp", None)], cells)
    assert [r.line for r in T.csv_lines(rows).collect()] == [cells.replace(" string", "").replace(" long", "").replace(" ", ""), '1,"a,b","say ""x""",t,2,3,,mcp,']
    assert T.csv_lines(rows.limit(0)).count() == 0
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in S.changed(old, new).collect()} == {("b", "changed"), ("c", "deleted"), ("d", "added")}
    assert {tuple(r) for r in S.upsert(old, new, "path").collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")}
    assert {tuple(r) for r in S.applied(old, new, S.changed(old, new)).collect()} == {tuple(r) for r in new.collect()}
    assert {r.path for r in S.without(old, new, "path").collect()} == {"c"}
    assert {tuple(r) for r in S.latest(old.union(new), "content_hash", "path").collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")}


def test_metrics(spark):
    found = spark.createDataFrame([("q", 5, 1), ("q", 7, 2)], "query string, item long, rank long")
    wanted = spark.createDataFrame([("q", 7, 1), ("z", 1, 1)], "query string, item long, gain long")
    got = {r["query"]: r for r in E.rank_metrics(found, wanted, 3).collect()}
    assert got["q"].mrr == 0.5 and got["q"].precision == round(1 / 3, 6) and got["q"].recall == 1.0 and got["z"].mrr == 0.0


def test_part_files_are_dealt_over_all_cores(spark):
    """The files made of parts are worked on by all cores, though their table is one small file."""
    from sparkloom.plans import registry

    for made in (registry.part_files, registry.odd_paths, registry.xml_files):
        assert made(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1

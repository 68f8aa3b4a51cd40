"""The corpus operators against brute-force versions, on small fixtures and edge cases."""

import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe, common, embed_dedup, html_text, lattice_lm, line_dedup, mixing, ngram_join, pii, quality, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_words string"
EDGE = [
    (1, None, None, None, "x"),
    (2, "", "a", "en", "x"),
    (3, " \t\n ", "a", "en", "x"),
    (None, "one two three four five", None, "en", None),
    (4, "one two three four five", "b", "en", "x"),
    (4, "one two three four five", "b", "en", "x"),
    (5, "word " * 3000, "a", "en", "x"),
    (6, "é😀 <|endoftext|> a@b.co 1.2.3.4", "é", None, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, DATA, "documents")


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


class Sets:
    """Disjoint sets; the root is the smallest member."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    random.seed(5)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    sets = Sets({x for p in pairs for x in p})
    for a, b in pairs:
        sets.join(a, b)
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {r.node: r.component for r in common.components(links, native=True).collect()}
    alone = {x for a, b in pairs if a == b for x in (a,) if sum(x in p for p in pairs) == 1}
    assert got == {x: sets.root(x) for x in sets.up if x not in alone}


def base_quality(text):
    w, g = split(text), []
    lines = [x for x in (text or "").split("\n") if split(x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    held = {k for i, x in enumerate(g) if c[x] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held)


def test_quality(spark, docs, edge, empty):
    for df in (docs, edge):
        got = sorted(tuple(r) for r in quality.quality(df).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
        wanted = []
        for r in df.collect():
            b = base_quality(r.text)
            wanted.append((-1 if r.doc_id is None else r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
        assert got == sorted(wanted)
    assert quality.quality(empty).count() == 0 and quality.clean(empty).columns == empty.columns


def test_frequent_lines_go(spark):
    word = lambda k, j: "".join(chr(97 + x) for x in (k % 26, k // 26, j % 26, j // 26))
    body = lambda k: " ".join(word(k, j) for j in range(60))
    rows = [(k, f"Subscribe  NOW {k}\n{body(k)}", "h", "en", "x") for k in range(30)]
    rows += [(100 + k, "\n".join([f"subscribe now {k}", body(100 + k)]), "other", "en", "x") for k in range(3)]
    rows += [(200, "subscribe now 7\n" * 1 + "few", "h", "en", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.quality(df, min_docs=5, percent=10).collect()}
    assert all(got[k].removed_lines == 1 and got[k].kept for k in range(30))
    assert all(got[100 + k].removed_lines == 0 for k in range(3))
    depleted = {r.doc_id: r.kept for r in quality.quality(df, min_docs=5, percent=10, min_words=2).collect()}
    assert not depleted[200] and all(depleted[k] for k in range(30))
    clean = {r.doc_id: r.text for r in quality.clean(df.withColumns({"_d": F.lit(1), "__lost": F.lit("k")}), 5, 10).collect()}
    assert clean[3] == body(3) and 200 not in clean


def test_frequent_lines_go_from_hosts_of_any_size(spark):
    rows = [(1000 * n + k, f"all rights reserved\nown line {'x' * k}" if k < 25 else f"other line {'x' * k}", f"h{n}", "en", "x") for n in (30, 400) for k in range(n)]
    rows += [(500_000 + k, f"a few hold this\nown line {'y' * k}" if k < 20 else f"other line {'y' * k}", "h20", "en", "x") for k in range(400)]
    rows += [(600_000 + k, f"on five of few\nown line {'z' * k}" if k < 5 else f"on six of few\nown line {'z' * k}" if k < 11 else "other", "few", "en", "x") for k in range(12)]
    got = {r.doc_id: r.removed_lines for r in quality.quality(spark.createDataFrame(rows, DOCS), percent=5).collect()}
    assert got == {i: int((i < 500_000 and i % 1000 < 25) or 600_005 <= i < 600_011) for i, *_ in rows}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, n):
    out = list(text)
    for _ in range(n):
        k, at = random.randrange(3), random.randrange(len(out))
        if k == 0:
            out[at] = random.choice("abc")
        elif k == 1:
            out.insert(at, random.choice("abc"))
        else:
            out.pop(at)
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    random.seed(most)
    pairs = []
    for k in range(1500):
        a = "".join(random.choice("abé😀") for _ in range(random.randint(6, 25)))
        pairs.append((k, k, a, changed(a, random.randint(0, 5))))
    got = {r.a for r in line_dedup.near_pairs(spark.createDataFrame(pairs, "a long, b long, la string, lb string"), most).collect()}
    assert got == {k for k, _, a, b in pairs if edits(a, b) <= most}


def test_counts_tell_lines_apart(spark):
    """Counts pass all lines within two edits, and stop lines that differ in rare letters or in length."""
    random.seed(14)
    rows = []
    for k in range(200):
        line = "".join(random.choice("etaonkq \u00e9") for _ in range(40))
        near = list(line)
        for _ in range(2):
            at = random.randrange(len(near))
            near[at : at + random.choice([0, 1])] = random.choice(["", "k", "z", "\u00fc"])
        rows.append((k, line, "".join(near), True))
    rows += [(900, "ab kfbb cd" * 3, "ab qxz cd" * 3, False), (901, "e" * 30, "e" * 33, False), (902, "kkkq" * 8, "zzzj" * 8, False)]
    df = spark.createDataFrame(rows, "k long, a string, b string, near boolean")
    got = df.select("near", line_dedup.may_be_near(line_dedup.counts(F.col("a")), line_dedup.counts(F.col("b")), 2).alias("kept"))
    assert got.where("near <> kept").isEmpty()


def test_met_keys(spark):
    """Keys that an index row shares with another line are met; those of one line's index row, or of no index row, are not."""
    rows = [(1, 5, True), (1, 9, False), (2, 5, True), (2, 5, True), (3, 5, False), (3, 9, False), (4, 5, True), (4, 9, True), (5, -5, False), (5, 7, False), (5, 7, True)]
    got = line_dedup.met_keys(spark.createDataFrame(rows, "key long, lh long, index boolean"))
    assert sorted(r.key for r in got.collect()) == [1, 4, 5]


def test_written_tables_leave_no_shuffles(spark):
    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before, setting = held(), spark.conf.get(common.CLEANUP)
    rows = common.durable(spark.range(50).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while held() > before and time.time() < end:
        time.sleep(0.1)
    assert held() <= before and rows.count() == 7 and spark.conf.get(common.CLEANUP) == setting


@pytest.mark.parametrize("slots", [line_dedup.SLOTS, 1])
def test_texts_that_lose_no_line_are_not_shuffled(spark, monkeypatch, slots):
    monkeypatch.setattr(line_dedup, "SLOTS", slots)
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    marks, n = line_dedup.bitmap(hashes, "h")
    tell = lambda df: df.join(F.broadcast(marks), F.pmod("h", F.lit(n)) == F.col("slot"), "left").where(line_dedup.in_bitmap(F.col("bits"), F.col("h"))).count()
    assert tell(hashes) == 20_000 and (slots == 1 or tell(spark.range(50_000, 70_000).select(F.xxhash64("id").alias("h"))) < 2000)
    rows = [(k, f"{'same line ' * 12}\n{k}" if k in (3, 9, None) else f"own text of {k}", "s", "en", "x") for k in [*range(40), None]]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id or -1, r.lost_lines) for r in got.where("lost_lines > 0").collect()) == [(3, 1), (9, 1)] and got.count() == 41
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftOuter") >= 2


def test_members_of_many_keys_are_shuffled_as_numbers(spark, monkeypatch):
    texts = [f"the line number {i % 40} of a text {'x' * (i % 3)} that is long enough" for i in range(120)]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "lh long, line string")
    keys = line_dedup.segment_keys(lines, 2, 15)
    met = common.durable(line_dedup.met_keys(keys))
    rows = lambda: sorted(map(tuple, line_dedup.met_members(lines, keys, met).select("key", "lh", "index", "line").collect()))
    few, shuffled, write = rows(), [], common.durable
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    monkeypatch.setattr(line_dedup, "durable", lambda df: shuffled.append(df.columns) or write(df))
    assert rows() == few and few and shuffled == [["key", "lh", "index"], ["lh", "line"]]


def test_line_dedup(spark, edge, empty):
    random.seed(9)
    seeds = ["".join(random.choice("abcd ") for _ in range(random.randint(*n))).strip() for n in ((32, 50), (16, 33), (8, 18)) for _ in range(7)]
    rows = [(k, "\n".join(changed(random.choice(seeds), random.randint(0, 2)) for _ in range(3)), "s", "en", "x") for k in range(110)]
    texts = {k: t for k, t, *_ in rows}
    lines = sorted({x.strip() for t in texts.values() for x in t.split("\n")})
    sets = Sets(lines)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and edits(a, b) <= min(2, min(len(a), len(b)) // 15):
                sets.join(a, b)
    seen = collections.Counter(sets.root(x.strip()) for t in texts.values() for x in t.split("\n"))
    met, wanted = set(), {}
    for k in sorted(texts):
        keep = []
        for x in texts[k].split("\n"):
            c = sets.root(x.strip())
            if seen[c] <= 6 or c not in met:
                keep.append(x)
            met.add(c)
        wanted[k] = "\n".join(keep)
    df = spark.createDataFrame(rows, DOCS).withColumns({"kept_lines": F.lit("v"), "_lost": F.lit(1), "__d": F.lit(2)})
    got = line_dedup.line_dedup(df)
    assert {r.doc_id: r.text for r in got.collect()} == wanted and got.columns[-2:] == ["kept_lines", "lost_lines"]
    twice = spark.createDataFrame([(1, f"{'same line ' * 12}\n{k}", "s", "en", "x") for k in range(2)], DOCS)
    assert sorted(r.lost_lines for r in line_dedup.line_dedup(twice).collect()) == [0, 1]
    assert line_dedup.line_dedup(edge).count() == len(EDGE) and line_dedup.line_dedup(empty).count() == 0


def test_long_lines_go_from_the_second_on(spark, monkeypatch):
    passage = lambda k: " ".join(f"word{k}x{j}" for j in range(25))
    rows = [(2 * k + c, f"{passage(k)}{'.' * c}\nits own {k} {c}\n{hashlib.md5(bytes([k])).hexdigest()[:16]} twice", "s", "en", "x") for k in range(40) for c in (0, 1)]
    rows += [(500, "\u4e2d" * 120 + "\n" + "\u4e2d" * 120, "s", "en", "x")]
    wanted = {i: t if i % 2 == 0 else t.split("\n", 1)[1] for i, t, *_ in rows} | {500: "\u4e2d" * 120}
    df = spark.createDataFrame(rows, DOCS)
    for small, hot in ((200_000, 1000), (3, 1)):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(df, edits=1).collect()}
        assert got == wanted


def brute_groups(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = split(fold(text))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    groups = Sets(sets)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.root(i)) for i in ids}


def test_ngram_join(spark, docs, edge, empty):
    random.seed(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seed = [f"w{random.randrange(80)}" for _ in range(150)]
    for k in range(150):
        copy = seed[:]
        for _ in range(random.randint(0, 6)):
            copy[random.randrange(len(copy))] = f"v{k}"
        rows.append((10_000 + k, " ".join(copy)))
    for width, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
        assert got == brute_groups(rows, width, percent)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(edge).collect())
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (-1, 2, None), (4, 2, 4), (4, 2, 4), (5, 1, 5), (6, 1, 6)], key=lambda x: x[:2])
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_of_rows_with_one_doc_id_and_other_keys(spark, monkeypatch):
    t, u = (" ".join(f"{x}{k}" for k in range(200)) for x in "tu")
    rows = [(1, t), (5, t), (5, u), (9, u + " more"), (9, u + " more"), (12, None), (13, ""), (14, "t1 t2 t3")]
    for kind, of in (("int", int), ("string", lambda x: f"k{x:02}")):
        got = ngram_join.ngram_join(spark.createDataFrame([(of(i), x) for i, x in rows], f"doc_id {kind}, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(of(i), of(1 if i < 10 else i)) for i, _ in rows]
    random.seed(14)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: 60 - k % 12] + [f"v{k}"] * (k % 3))) for k in range(120)]
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "SMALL", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows, 4, 85)


def brute_plan(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by the rule in words: share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted(sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > repeats * sizes[s]]
        if not over:
            return stopped | {s: w[s] * level for s in rest}
        stopped |= {s: repeats * sizes[s] for s in over}


def test_mixing(spark, docs, edge, empty):
    copies = spark.createDataFrame([(7, "a b c " * 60, "src1", "en", 1)] * 5 + [(None, f"x{k} y z", None, "en", 1) for k in range(40)], docs.schema)
    df = docs.unionByName(copies)
    table = collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())
    pieces, sizes, _ = mixing.scheduled(df.select("doc_id", "text", "source"), (5, 2, 1), 3, 64, 7)
    order = sorted((tuple(r) for r in sizes.select("src", "at", F.coalesce("doc_id", F.lit(-1)), "rk", "copy", "size").collect()))
    of = collections.defaultdict(int)
    for src, *_, size in order:
        of[src] += size
    targets = brute_plan(of)
    # Each source's stream is its rows by place in the shuffled order, over and over; the mix takes the first target words of it.
    wanted = collections.Counter()
    for src in of:
        left, stream = round(targets[src]), [x for x in order if x[0] == src]
        while left:
            for _, _, i, rk, copy, size in stream:
                wanted[i, rk, copy] += min(size, left)
                left -= min(size, left)
    got = collections.Counter()
    rows = pieces.collect()
    for r in rows:
        got[-1 if r.doc_id is None else r.doc_id, r.rk, r.copy] += r.to_word - r.from_word
        assert 0 <= r.from_word < r.to_word <= r["size"] and (r.p + r.from_word) // 64 == r["rank"] == (r.p + r.to_word - 1) // 64
    assert +got == +wanted
    slots = collections.defaultdict(set)
    for r in rows:
        slots[r.slot].add((r.src, r["rank"]))
    assert all(len(x) == 1 for x in slots.values()) and len({next(iter(x)) for x in slots.values()}) == len(slots)
    by_slot = [next(iter(slots[k]))[0] for k in sorted(slots)]
    everything = sum(targets.values())
    for src, t in targets.items():
        for n in range(10, len(by_slot), 37):  # every stretch holds the sources in proportion
            assert abs(by_slot[:n].count(src) - n * t / everything) < 8
    counts = mixing.mix(df).collect()
    assert sorted(map(str, counts)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert collections.Counter((r.doc_id, r["size"]) for r in counts) == sum((collections.Counter({(i, len(split(t))): n}) for (i, t, _), n in table.items()), collections.Counter())
    for src in {r.src for r in counts}:
        own = [r for r in counts if r.src == src]
        assert own[0].target == pytest.approx(targets[src]) and own[0].source_size == of[src] and all(r.taken <= 3 * r["size"] for r in own)
        assert sum(r.taken for r in own) == round(targets[src])
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(empty).count() == 0
    few = spark.createDataFrame([(k, "w " * n, s, "en", "x") for k, (n, s) in enumerate([(1000, "b"), (10, "a"), (1000, "c")])], DOCS)
    got = {r.src: r.target for r in mixing.mix(few).collect()}
    assert got == pytest.approx({"0a": 30, "0b": 1980 * 2 / 3, "0c": 1980 / 3})


def test_mixed_texts(spark, edge, empty):
    random.seed(12)
    text = lambda k: "".join(random.choice([f"w{k}x{j}", f"v{j}"]) + random.choice([" ", "\n", " \t "]) for j in range(random.randint(1, 90)))
    rows = [(k, text(k), random.choice(["a", "b", "c", None]), "en", "x") for k in range(60)]
    rows += [rows[0], rows[0], (None, " lone\n", "a", "en", "x"), (0, "other text", "a", "en", "y")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_d": F.lit(1), "__r": F.lit("z"), "__slot": F.lit(2)})
    got = mixing.mixed(df, block=32)
    assert got.columns == df.columns
    seen, whole = collections.Counter(), {(r.doc_id, r.text) for r in df.collect()}
    for r in got.collect():
        seen[r.doc_id] += len(split(r.text))
        assert any(r.doc_id == i and r.text in t for i, t in whole)
    wanted = collections.Counter()
    for r in mixing.mix(df, block=32).collect():
        wanted[r.doc_id] += r.taken
    assert +seen != {} and sum(seen.values()) == sum(wanted.values())
    assert mixing.mixed(edge).columns == edge.columns and mixing.mixed(empty).count() == 0
    one = spark.createDataFrame([(1, " a b\n c ", "s", "en", "x")], DOCS)
    assert [r.text for r in mixing.mixed(one).collect()] == [" a b\n c "]
    assert [r.text for r in mixing.mixed(one, block=2).collect()] == [" a b", "\n c "]


def test_mixed_without_python(spark):
    """The pieces are cut in Spark's own tasks: texts over many slots, odd spaces, code points beyond 16 bits, extra columns with dots."""
    random.seed(13)
    text = lambda n: "".join(random.choice([" ", "\n\n", "\t", "\x0b\x0c", "\r\n "]) + random.choice(["w", "\u00a0x", "\U0001f600y", "\u2028"]) for _ in range(n)) + random.choice(["", " ", "\n\t"])
    rows = [(k, text(random.choice([1, 3, 40, 300])), random.choice(["a", None]), "en", k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("a.b", F.col("doc_id") + 1)
    out = mixing.mixed(df, block=16)
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()
    wanted = collections.Counter()
    for x in mixing.scheduled(df, (5, 2, 1), 3, 16, 7)[0].collect():
        text, ends = rows[x.doc_id][1], [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", rows[x.doc_id][1])]
        low, high = ends[x.from_word - 1] if x.from_word else 0, ends[x.to_word - 1] if x.to_word < x["size"] else len(text)
        wanted[x.doc_id, text[low:high], high - low if high - low < len(text) else x.doc_id, x.doc_id + 1] += 1
    assert len(wanted) > 100 and wanted == collections.Counter((r.doc_id, r.text, r.n_chars, r["a.b"]) for r in out.collect())


def test_bpe(spark, docs, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - k, r[1]) for k, r in enumerate(EDGE)]
    random.seed(2)
    for k in range(400):
        rows.append((20_000 + k, "".join(chr(random.choice([random.randint(9, 0x2FF), random.randint(0x300, 0xD7FF), random.randint(0xE000, 0x10FFFF), 0x85, 0x1F, 0x20, 0x27])) for _ in range(random.randint(1, 40)))))
    rows.append((30_000, "a" * 5000 + " " * 300 + "\n"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df, path).collect()}
    marks = {r.doc_id: r for r in bpe.encode(df, path, digests=True).collect()}
    for i, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == model.decode(ids, skip_special_tokens=False)
        assert marks[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(empty, path).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 32))
    rows = [(k, int(k % 2), (centres[k % 6] + rng.standard_normal(32) * 0.06).tolist()) for k in range(300)]
    rows += [(300 + k, 0, rng.standard_normal(32).tolist()) for k in range(200)]
    rows += [(500 + k, k % 3, rows[k % 2][2]) for k in range(60)]  # exact copies, in three labels
    odd = [(900, 0, None), (901, 0, []), (902, 0, [0.0] * 32), (903, 0, [None] + [1.0] * 31), (904, 0, [float("nan")] + [1.0] * 31), (905, None, rows[0][2]), (None, 0, rows[0][2]), (906, 0, rows[0][2] * 2)]
    df = spark.createDataFrame(rows + odd + [rows[1]], "vec_id long, label long, embedding array<double>")
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = len(rows)
    near = (x @ x.T >= 0.98) & (np.array([r[1] for r in rows])[:, None] == np.array([r[1] for r in rows])[None, :])
    sets = Sets(range(size))
    for a, b in np.argwhere(near):
        sets.join(int(a), int(b))
    for block, paired in ((256, 24), (8, 3)):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        monkeypatch.setattr(embed_dedup, "PAIRED", paired)
        got = {r.vec_id: r for r in embed_dedup.embed_dedup(df).collect()}
        found = sum(r.n_links for r in got.values())
        assert near.sum() - size >= found >= 0.98 * (near.sum() - size) > 1000
        assert all(got[k].n_links <= near[k].sum() - 1 for k in range(size))
        assert sum(got[k].component_id == sets.root(k) for k in range(size)) >= size - 10
        assert all(got[k].n_links == 0 and got[k].component_id == k for k, *_ in odd if k)
        assert got[None].component_id is None and not got[None].kept
    assert embed_dedup.embed_dedup(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x", [1.0, 0.0]), ("a", "x", [2.0, 0.0]), ("c", "y", [2.0, 0.0]), ("d", "x", [1.0, 0.001])], "vec_id string, label string, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embed_dedup(named).collect()} == {"a": (2, "a"), "b": (2, "a"), "c": (0, "c"), "d": (2, "a")}


def brute_model(texts, path, passes=2):
    """A word's log probability, by the definition: every word's lattice alone, no arrays, no join."""
    c = collections.Counter(w for t in texts for w in [*fold(t).encode().split(), b"\n"])
    scores = lattice_lm.start_scores(path)
    for _ in range(passes):
        lattice, counts = lattice_lm.Lattice(scores), dict.fromkeys(scores, 0.1)
        for w in c:
            for k, e in (lattice.expected_of(b" " + w) if w != b"\n" else {}).items():
                counts[lattice.pieces[k]] += e
        total = sum(counts.values())
        scores = {p: math.log(x / total) for p, x in counts.items()}
    lattice = lattice_lm.Lattice(scores)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.75
    n = sum(c.values()) + 1

    def log_p(w):
        p = d * max(1, len(c)) / n * math.exp(lattice.forward_of(b" " + w)[-1]) if w != b"\n" else 0
        m = c[w] + (w == b"\n")
        return math.log10(p + (m - d) / n if m else p)

    end = (c[b"\n"] + 1) / (n + 1)
    log_p.alone = lambda w: math.log10(end) if w == b"\n" else math.log10(1 - end) + lattice.forward_of(b" " + w)[-1] / math.log(10)
    return log_p


def test_language_model(spark, docs, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    random.seed(3)
    long = "".join(random.choice("abcdefghij") for _ in range(70))
    df = docs.where("doc_id < 60").unionByName(spark.createDataFrame([(70_000, f"A new-word zqx {long} der\u00e9 \u4e2d\u6587", "en", "s", 1), (70_000, "", "en", "s", 1), (70_003, long, "en", "s", 1)], docs.schema))
    rows = df.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [r.text or "" for r in rows if not held(r.doc_id)]
    c = collections.Counter(w for t in train for w in [*split(fold(t)), "\n"])
    n, v = sum(c.values()), len(c)
    log_p = brute_model(train, path)
    got = {(r.doc_id, r.n_tokens): r for r in lattice_lm.score(df, path).collect()}
    assert len(got) == len(rows)
    for r in rows:
        tokens = [*split(fold(r.text)), "\n"]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens)
        g = got[r.doc_id, len(tokens)]
        assert (g.held_out, g.n_known, g.train_tokens) == (held(r.doc_id), sum(c[t] > 0 for t in tokens), n)
        assert g.lattice_score == pytest.approx(sum(log_p.alone(t.encode()) for t in tokens))
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(sum(log_p(t.encode()) for t in tokens))
    assert lattice_lm.score(edge, path).count() == len(EDGE) and lattice_lm.score(empty, path).count() == 0


def test_words_that_every_task_knows_change_nothing(spark, docs, monkeypatch):
    path, few = public_tokenizers.path("byte_bpe_50k.tiktoken"), docs.where("doc_id < 30")
    scores = []
    for common in (1, 100, 1_000_000):
        monkeypatch.setattr(lattice_lm, "COMMON", common)
        scores.append({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lattice_lm.score(few, path).collect()})
    assert scores[0] == scores[1] == scores[2]


def test_lattice_sums_all_segmentations():
    scores = {b"a": math.log(0.2), b"b": math.log(0.3), b"ab": math.log(0.1), b"ba": math.log(0.05), b" ": math.log(0.1), b" a": math.log(0.25)}
    lattice = lattice_lm.Lattice(scores)

    def every(word):
        return 1.0 if not word else sum(math.exp(s) * every(word[len(p) :]) for p, s in scores.items() if word.startswith(p))

    words = [b"abba", b"aaab", b"a", b"bab", b"b" * 60]
    for at, several in lattice_lm.by_length(words):
        assert np.exp(lattice.forward(several)) == pytest.approx([every(b" " + words[k]) for k in at])
        one = collections.Counter()
        for k in at:
            one.update(lattice.expected_of(b" " + words[k]))
        assert {k: e for k, e in enumerate(lattice.expected(several)) if e} == pytest.approx(dict(one))
        assert sum(len(lattice.pieces[k]) * e for k, e in one.items()) == pytest.approx(several.size)
    assert math.exp(lattice.forward_of(b" abba")[-1]) == pytest.approx(every(b" abba"))


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in re.sub("[ -]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data(spark, docs, edge, empty):
    random.seed(8)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 + k, r[1]) for k, r in enumerate(EDGE)]
    rows += [(9000 + k, "".join(random.choice("ab.@_-% +(1234567890.5)") for _ in range(40))) for k in range(500)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].base for i, _ in rows} == {i: base_pii(t or "") for i, t in rows}
    assert all(r.spans.startswith(r.base) and r.n_email == r.base.count("email:") for r in got.values())
    assert pii.personal_data(empty).count() == 0 and pii.personal_data(edge).count() == len(EDGE)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"x{k} please reach me under ann{k}@mail.example.com today") for k in range(12)] + [(50, "please reach me under ZQ-8841-77 today"), (51, "it weighs AB-1234-55 there")]
    # What the first pattern found stands behind a second one, whose slot holds others; keys find a token of any look.
    rows += [(100 + k, f"please reach me under QX-{k}-{k * 7}00 or so") for k in range(7)] + [(120 + k, f"the customer number QX-{k}-{k * 7}00 is old") for k in range(7)]
    rows += [(140, "a customer number PP-1/77 was lost"), (141, "a customer counter PP-1/77 was lost")]
    rows += [(200 + k, f'api_token = "{hashlib.md5(bytes([k])).hexdigest()}"') for k in range(6)] + [(210, "old-token: correct-horse, said by none"), (211, "the time: 12345678")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {i: r.spans for i, r in got.items()}
    assert spans[50] == "id:22:32" and spans[51] == ""
    assert spans[140] == "id:18:25" and spans[141] == "" and got[140].n_id == 1
    assert all(spans[200 + k] == "id:13:45" for k in range(6)) and spans[210] == "id:11:24" and spans[211] == ""


def test_trust_by_hand(spark):
    rows = [(k, f"alpha beta u{k}@x.co gamma") for k in range(6)] + [(10 + k, f"alpha beta code-{k}9 gamma") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # "alpha beta _" and "beta _ gamma" hold six seeds and two others, once each: first trust 6/8, then the others score 1 - (1/4)^2, ...
    score = 0.0
    for _ in range(3):
        trust = (6 + 2 * score) / 8
        score = 1 - (1 - trust) ** 2
    edges = pii.scan(df)
    found = {r.pattern for r in pii.trusted_patterns(common.durable(edges), 1, trust - 1e-9, 5).collect()}
    assert found == {"alpha beta _", "beta _ gamma"}
    assert pii.trusted_patterns(common.durable(edges), 1, trust + 1e-9, 5).count() == 0


def test_personal_data_takes_time_in_proportion():
    for text in ("x" * 300_000 + " a@b.co 7", "1" * 300_000, "1." * 150_000, "7 " * 150_000, "k=" * 150_000 + "1", "+" * 200_000 + "1", "@" * 300_000):
        start = time.time()
        spans = pii.base_spans(text)
        named = {m.end(): m[1] for m in pii.ASSIGNED.finditer(text)}
        found = [pii.patterns(text, s, e, named) for s, e in pii.tokens(text, named)]
        assert time.time() - start < 5 and len(found) + len(spans) < 400_000


def test_page_text(spark):
    boiler = '<div class="x"><p>Join our club</p></div>'
    page = lambda k: f"<html><head><title>T{k}</title><script>var a='</p>';</script></head><body><nav><ul><li>Menu</ul></nav>{boiler}<article><h1>H{k} &amp; more</h1><p><b>One\n two<br>three<p>Four {k}</p>{boiler}<div class='comments'><p>Nice!</p></div><aside>Side</aside></article><footer>&copy; x</footer>"
    rows = [(k, f"https://h.example.com/{k}", page(k)) for k in range(20)] + [(90, None, None), (91, "u", ""), (92, "http://y/", "<p>Only <i>this</i> here<p class='t"), (93, "https://h.example.com/z", "<article><p>a &lt;b&gt; c</p></article>")]
    got = {r.page_id: r for r in html_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"H{k} & more\nOne two three\nFour {k}" for k in range(20))
    assert (got[90].text, got[91].text, got[92].text, got[93].text) == ("", "", "Only this here", "a <b> c")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.page_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_menus_are_templates_by_their_shape(spark):
    random.seed(20)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    menu = lambda n: "<div class='m1'><ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(n)) + "</ul></div>"
    rows, wanted = [], {}
    for k in range(40):
        host, title, paragraphs = "many" if k < 30 else f"few{k}", word(), [" ".join(word() for _ in range(8)) for _ in range(random.randint(1, 4))]
        links = [word() for _ in range(3)]
        own = "<ul>" + "".join(f"<li><a href=x>{w}</a>" for w in links) + "</ul>"
        rows.append((k, f"https://{host}/{k}", f"<body>{menu(random.randint(3, 9))}<div class=c><article><h2>{title}</h2>{''.join(f'<div><p>{x}</div>' for x in paragraphs)}{own}</article></div><p>after &amp; all</p></body>"))
        wanted[k] = "\n".join([title, *paragraphs, *links, "after & all"])
    got = {r.page_id: r.text for r in html_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in range(30)} == {k: wanted[k] for k in range(30)}
    assert all(got[k].endswith(wanted[k]) and got[k] != wanted[k] for k in range(30, 40))


def test_all_main_parts_are_read(spark):
    rows = [(1, "http://a/", "<body><main><h1>T</h1><article>A</article><p>B</main><div>no</div><main>C</main></body>"), (2, "http://a/", "<p>x<article>A</article>y<article>B</article>")]
    assert [r.text for r in html_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()] == ["T\nA\nB\nC", "x\nA\ny\nB"]


def test_broken_pages_take_time_in_proportion():
    n = 100_000
    for page in ("<a " * n, "<a b='" * n, "<div>" * n + "</x>" * n, "<i>" * n + "<h1>" * n, "<script>" + "</script " * n, "<!-- " * n, "<p x=\"" + "<p>" * n, "< " * n, "</" * n, "&amp" * n, "<li><i>" * n, "<title" * n):
        start = time.time()
        root = html_text.parse(page)
        list(html_text.digests(root))
        html_text.main_text(root, set())
        assert time.time() - start < 6, page[:20]
    assert html_text.main_text(html_text.parse("a < b <p t='1>2' u=\"x\">c<br/>d</p x>e<!-- f -->g<?h?>i</>j<b"), set()) == "a < b\nc d\negij"


def test_class_names_drop_whole_names_only(spark):
    kept = ["<p class='related-work'>A</p>", "<div class=social-science>A</div>", "<figure class='banner wide'>A</figure>", "<div class='related'>A</div>", "<div id=no-sidebar>A</div>"]
    pages = [f"<body class='has-sidebar'><article class='post comments-open'>{x}<p>B</article></body>" for x in kept]
    pages += [f"<html class='no-sidebar nav'><body class=sidebar><main class=comments><p>{x}</p><p>B</main>" for x in "A"]
    gone = [f"<body><article><{t} class='x {c}'>A</{t}><p>B</article></body>" for t, c in (("div", "sidebar"), ("p", "AD"), ("section", "comments"))]
    rows = [(k, f"http://h{k}/", x) for k, x in enumerate(pages + gone)]
    got = {r.page_id: r.text for r in html_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "A\nB" if k < len(pages) else "B" for k in range(len(rows))}


def test_templates_are_counted_over_different_pages(spark, monkeypatch):
    own = lambda k: f"<article><div class='body'><p>Story {k}</p></div></article>"
    box = "<div class='box'><p>Join us</p></div>"
    rows = [(k, "http://copies/same", f"<!-- {k % 7} -->{own(0)}") for k in range(60)]
    rows += [(1000 + k, f"http://large/{k}", f"{own(k)[:-10]}{box if k < 25 else ''}</article>") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for small in (200_000, 0):
        monkeypatch.setattr(html_text, "SMALL", small)
        got = {r.page_id: r.text for r in html_text.page_text(pages).collect()}
        assert got == {i: f"Story {i - 1000 if i >= 1000 else 0}" for i, *_ in rows}


def test_toxicity(spark, edge, empty):
    random.seed(6)
    rows, labels = [], []
    for k in range(400):
        words = [f"w{random.randrange(300)}" for _ in range(random.randint(20, 200))]
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        toxic = k % 4 == 0
        for _ in range(random.randint(2, 8) * toxic):
            words[random.randrange(len(words))] = random.choice(["grumpf", "blargh", "snorty"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id < 280"))
    assert model["thetas"] == sorted(model["thetas"])
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    right = sum(got[k].toxic == bool(t) for k, _, t in labels if k >= 280)
    assert right >= 114
    assert np.mean([got[k].expected_severity for k, _, t in labels if t]) > 0.5 > np.mean([got[k].expected_severity for k, _, t in labels if not t])
    assert toxicity.severity(edge, model).count() == len(EDGE) and toxicity.severity(empty, model).count() == 0
    assert toxicity.fit(empty, marks.limit(0))["weights"] == {}
    # The operator by its definition, from the model alone.
    levels, thetas = model["levels"], model["thetas"]
    for i, text in rows[:60]:
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        features = words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}
        z = sum(model["weights"].get(f, 0.0) for f in features)
        above = [1.0] + [1 / (1 + math.exp(t - z)) for t in thetas] + [0.0]
        each = [a - b for a, b in zip(above, above[1:], strict=False)]
        assert got[i].expected_severity == pytest.approx(sum(p * x for p, x in zip(each, levels, strict=True)))
        assert got[i].p_toxic == pytest.approx(above[1]) and got[i].grade == levels[int(np.argmax(each))]
        assert got[i].n_features == sum(f in model["weights"] for f in features)
    named = toxicity.fit(docs.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text"), marks.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "quality", "toxic"))
    assert {"grumpf", "blargh", "snorty"} <= set(named["weights"])


def test_toxicity_features_and_grades_by_brute_force(spark):
    random.seed(16)
    words = ["".join(random.choice("bcdfg") + random.choice("aeiou") for _ in range(2)) for _ in range(60)]
    bad = ["vile", "worse", "worst", "foul"]
    rows = [(k, " ".join(random.sample(words, 40) + (random.sample(bad, 1 + k % 4) if k % 3 == 0 else []))) for k in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    n1, n0 = 80, 160
    g = {}
    sets = {k: toxicity.text_features(t) for k, t in rows}
    for f in {f for x in sets.values() for f in x}:
        a, b = sum(f in sets[k] for k in range(0, 240, 3)), sum(f in sets[k] for k in range(240) if k % 3)
        g[f] = sum(2 * x * math.log(x * 240 / ((a + b) * m)) for x, m in ((a, n1), (b, n0)) if x)
    assert set(model["weights"]) == {f for f, x in g.items() if x >= toxicity.TELLING}
    part = {r.d: r.part for r in toxicity.sample_rows(docs, labels, 3000).collect()}
    assert 60 < sum(part.values()) < 180
    graded = set()
    for k in range(0, 240, 3):
        others = [j for j in part if part[j] != part[k]]
        only = {w for w in bad if any(w in sets[j] for j in others if j % 3 == 0)}
        share = len(only & sets[k]) / sum(w[-1] != "*" for w in sets[k])
        graded.add(1 + sum(share >= d for d in toxicity.DENSE))
    assert model["levels"] == sorted(graded | {0}) and len(graded) > 1
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert all((got[k].grade > 0) == (k % 3 == 0) for k in range(240))
    few, many = ([got[k].expected_severity for k in range(0, 240, 3) if k % 4 == n] for n in (0, 3))
    assert np.mean(few) < np.mean(many)


def test_toxicity_of_unseen_documents(spark):
    docs, labels = (common.read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = labels.where("doc_id % 2 = 1").join(toxicity.severity(docs, model).withColumnRenamed("toxic", "said"), "doc_id").collect()
    assert sum(r.said == bool(r.toxic) for r in rest) >= 0.97 * len(rest) > 1500


def test_pipeline_stages_on_odd_rows(spark, edge, empty):
    import corpus_pipeline

    odd = edge.withColumns({"kept_lines": F.lit("v"), "__lost": F.lit(1), "_d": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "a.b": F.lit(2)})
    text = {-1: EDGE[3][1]} | {r[0]: r[1] for r in EDGE if r[0] is not None}
    wanted = {  # every row of the edge table but 1 to 3 has words; none has 50 different ones; 4 stands twice
        "quality_rules": [], "line_dedup": [-1, 1, 2, 3, 4, 4, 5, 6], "near_duplicates": [-1, 1, 2, 3, 4, 5, 6], "mix_sources": None, "bpe": [-1, 1, 2, 3, 4, 4, 5, 6],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, DATA)
        rows = out.collect()
        ids = sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
        if name == "bpe":
            model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert all(r.ids == model.encode(text[-1 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)
        else:
            assert out.columns == odd.columns and all(r.kept_lines == "v" and r["a.b"] == 2 and (r.text is None or r.n_chars == len(r.text)) for r in rows), name
        if wanted[name] is None:
            assert set(ids) <= {-1, 4, 5, 6} and sum(len(split(r.text)) for r in rows) == sum(r.taken for r in mixing.mix(odd).collect())
        else:
            assert ids == wanted[name], name
        assert stage(spark, empty, DATA).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.durable(stage(spark, table, DATA))
        assert out.columns == docs.columns, name
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in table.collect()]
            groups = brute_groups(rows, 5, 80)
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
        table = out
    last = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
    assert last.count() == table.count() > 50
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"

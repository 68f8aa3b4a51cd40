"""Merkle proofs, token counts and the prefix trie against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparkloom.llm import common, merkle, oracles, prefix_trie, queries, token_counts

DATA = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, `a.b` string, place long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def crc(value):
    return zlib.crc32(str(value).encode())


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    leaf = lambda r: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    per = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in per[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        for i, r in enumerate(per[lang]):
            struck = r[0] is not None and r[3] is not None and crc(r[0]) % 7 == 0
            now, proof = leaf((*r[:3], r[3] + 1, r[4]) if struck else r), []
            for levels, at in ((trees[lang], i), (top, place)):
                for nodes in levels[:-1]:
                    other = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
                    proof.append(other)
                    now = sha(other, now) if at & 1 else sha(now, other)
                    at //= 2
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha(*proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("step", "few"), [(8, False), (2, False), (1, True)])
def test_manifest(spark, monkeypatch, step, few):
    monkeypatch.setattr(merkle, "STEP", step)
    if few:  # as on tables beyond every bound of a broadcast
        for module, name in ((merkle, "NODES"), (merkle, "SMALL"), (common, "SMALL")):
            monkeypatch.setattr(module, name, 2)
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.choice([None, "s", "é"]), rng.choice([None, "", "de", "Ω", "en", "en", "en"]), rng.choice([None, 3, 2**62]), rng.choice([None, "", "x" * 3000, "ü\n"]), "q", "r", 1) for _ in range(70)]
    rows += [(None, None, None, None, None, None, None, None)] * 3 + [(7, "a", "one", 1, "t", "", "", 0)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == brute_manifest([r[:5] for r in rows])


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, "a", "one", 1, "t", "", "", 0)]
    got = merkle.manifest(spark.createDataFrame(one, DOCS)).collect()
    assert got[0].leaf == got[0].root == got[0].subroot and got[0].proof_sha256 == sha()
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_numbers_within_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 1)
    rows = [(k % 3 if k % 10 else None, k * 7 % 50, k) for k in range(200)] + [(1, 5, 0)] * 100
    got = common.numbered(spark.createDataFrame(rows, "g long, o long, k long").repartition(5), "g", "o").collect()
    per = defaultdict(list)
    for r in got:
        per[r.g].append((r.place, r.o, r.total))
    assert len(got) == len(rows)
    for v in per.values():
        assert [x[0] for x in sorted(v)] == list(range(len(v))) and {x[2] for x in v} == {len(v)}
        assert [x[1] for x in sorted(v)] == sorted(x[1] for x in v)


def random_texts(n):
    rng = random.Random(8)
    kinds = ["ab", "aeiou the", "  x", "=-*#", "aA0 \n\t", "日本語の中文字", "é ̀ñ😀", "▁ _", "<s>|▁</s>", " ", "the"]
    pick = lambda: rng.choice(kinds) + rng.choice(kinds)
    return ["".join(rng.choices(pick(), k=rng.randrange(1, 90))) for _ in range(n)]


def test_transducer_counts_as_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.Counter(PIECES)
    texts = ["", " ", "▁", "a" * 999, " " * 99, "the" * 200, "<unk> <0x0A>", "x\0y", "ﬁ Ａ"] + random_texts(1500)
    for text, wanted in zip(texts, map(len, library.encode(texts)), strict=True):
        assert counter.count(token_counts.escaped(text)) == wanted == counter.machine.run(token_counts.escaped(text))[1], text


def test_transducer_forgets(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 20)
    monkeypatch.setattr(token_counts, "WORDS", 5)
    test_transducer_counts_as_the_library()


@pytest.mark.parametrize("chunk", [7, 64, 1 << 15])
def test_token_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    monkeypatch.setattr(token_counts, "BEFORE", 3)
    rng = random.Random(1)
    texts = [rng.choice(["a", "ab", "aa ", " ", "=", "-", "thethe", "abab ", " the", "日本"]) * rng.randrange(1, 90) for _ in range(15)] + random_texts(10) + ["x y"]
    rows = [(k, t, "q") for k, t in enumerate(texts)] + [(None, None, None), (3, "", "q"), (4, "x", None), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n_tokens` string")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    wanted = [(d, len((t or "").encode()), n, n > 30) for (d, t, _), n in zip(rows, map(len, library.encode([t or "" for _, t, _ in rows])), strict=True)]
    assert sorted(map(tuple, token_counts.token_counts(docs, PIECES, chunk, most=30).collect()), key=repr) == sorted(wanted, key=repr)


def test_token_counts_of_no_rows(spark):
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), PIECES).collect() == []


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in turns.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = crc(c) % 4
        whole = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", node[-1][1]) if w]) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    least = lambda node: min(c for c, _ in members[node])
    for node, m in members.items():
        ends = sha(",".join(map(str, sorted(c for c, last in m if last))))
        out.append((least(node), len(node), least(node[:-1]) if node else None, len(m), len(children[node]), leaves[node], saved[node], ends))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, place long, `a.b` string"


def trie_rows():
    rng = random.Random(2)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x y", "z", "", None, "hello"])) for c in [*range(70), -3, -20] for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(5)]
    return rows + [(None, 1, "u", "x"), (150, None, None, "q"), (150, 0, None, "w"), (151, 1, "u", "r"), (151, 1, "u", "r")] + [(200, t, "u", f"m{t % 3}") for t in range(60)]


@pytest.mark.parametrize("few", [False, True])
def test_prefix_trie(spark, monkeypatch, few):
    if few:
        for module, name, value in ((prefix_trie, "ENDS", 4), (prefix_trie, "SMALL", 2), (common, "SMALL", 2)):
            monkeypatch.setattr(module, name, value)
    rows = trie_rows()
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, "q") for r in rows], TURNS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_prefix_trie_tries_another_base(spark, monkeypatch):
    asked = []

    def once_wrong(conversations, attempt):
        asked.append(attempt)
        return attempt > 0

    monkeypatch.setattr(prefix_trie, "same_contents", once_wrong)
    rows = trie_rows()[:40]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, "q") for r in rows], TURNS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows) and asked == [0, 1]


def test_contents_are_compared(spark, monkeypatch):
    rows = spark.createDataFrame([(*r, 1, "q") for r in trie_rows()], TURNS)
    assert prefix_trie.same_contents(rows, 0)
    monkeypatch.setattr(prefix_trie.F, "xxhash64", lambda *columns: F.pmod(F.length(columns[-1]), F.lit(2)).cast("long"))
    assert not prefix_trie.same_contents(rows, 0)


def test_prefix_trie_of_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


@pytest.mark.parametrize("name", ["op11_merkle", "op13_prefix_trie"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = db.execute({"op11_merkle": oracles.MERKLE, "op13_prefix_trie": oracles.PREFIX_TRIE}[name])
    columns = sorted(x[0] for x in wanted.description)
    at = [[x[0] for x in wanted.description].index(c) for c in columns]
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in wanted.fetchall()), key=repr)

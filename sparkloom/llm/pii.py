"""Personal data: rules find seeds, their contexts become patterns, patterns find more identifiers.

Rules give the base spans. Every base span, every token that holds a digit and every
token that a key names (``key = token``) is an instance with the lexical patterns around it:
the two words before, the word on either side, the key, and the key's last part (digits
in words are alike, letters are folded). Seeds are the base spans and tokens that look
like secrets (long, letters and digits mixed), the latter only to learn from. Spark
counts the graph of patterns and instances and scores it in rounds: a pattern by the
share of its instances' scores, an instance by the patterns that hold it, seeds being 1.
A pattern is looked at once ``support`` different instances of the needed confidence
stand in it, found ones included; rounds end when none is added. Tokens in patterns of
high confidence are new spans, of kind ``id``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, maybe_broadcast

#: The rules' patterns, and the kinds in the order in which spans are listed. No pattern tries a run of digits twice.
KINDS = ("email", "ip", "card", "phone", "id")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
ANY = re.compile(r"[0-9@]")
#: What ends a token; a key before its token; the last part of a key; a token that looks like a secret.
DELIMITERS = frozenset("\"'<>(){}[],;=:")
TOKEN = re.compile(r"[^\s\"'<>(){}\[\],;=:]+")
DIGIT = re.compile(r"[0-9]")
ASSIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]{2,63})[\"']?[ \t]*[=:][ \t]*[\"']?(?=[^\s\"'<>(){}\[\],;=:])")
LAST_PART = re.compile(r"[A-Za-z][a-z0-9]*$|[A-Z0-9]+$")
SECRET = re.compile(r"(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])[A-Za-z0-9+/_-]{32,}=*")
#: The word after a span and what stands right behind it.
AFTER = re.compile(r"\S*\s+(\S{1,64})(?!\S)")
#: Least characters of an instance, and most of a word that is a context.
LEAST, WORD = 6, 64
#: Instances after which a task hands on its rows.
BATCH = 100_000
SMALL = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of an address: from each @, back over what a local part can hold and on over the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in SIGNS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules' matches; a match that fails its test is dropped and not tried again."""
    if not ANY.search(text):
        return []
    out = [(0, s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def tokens(text: str, named: dict[int, str]) -> Iterator[tuple[int, int]]:
    """Tokens that hold a digit or that a key names, each once, without closing marks; every character is looked at a few times at most."""
    done = 0
    starts = sorted([m.start() for m in DIGIT.finditer(text)] + list(named)) if named else (m.start() for m in DIGIT.finditer(text))
    for at in starts:
        if at < done:
            continue
        start = at
        while start > done and not (text[start - 1] in DELIMITERS or text[start - 1].isspace()):
            start -= 1
        done = TOKEN.match(text, start).end()
        end = done
        while end > start and text[end - 1] in ".!?":
            end -= 1
        if end - start >= LEAST:
            yield start, end


def word_before(text: str, end: int) -> tuple[int, str]:
    """The word before a place, folded, and where it begins; none if it is longer than a context may be."""
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start, least = end, max(0, end - WORD - 1)
    while start > least and not text[start - 1].isspace():
        start -= 1
    return start, folded(text[start:end]) if end - start <= WORD else ""


def folded(word: str) -> str:
    return DIGIT.sub("0", word.lower())


def patterns(text: str, start: int, end: int, named: dict[int, str]) -> list[str]:
    """The lexical patterns around a span."""
    at, last = word_before(text, start)
    _, one = word_before(text, at) if last else (0, "")
    after = AFTER.match(text, end, end + 3 * WORD)
    out = []
    if last and one:
        out.append(f"{one} {last} _")
    if last and after and (after.end() == len(text) or text[after.end()].isspace()):
        out.append(f"{last} _ {folded(after[1])}")
    if key := named.get(start):
        out.append(f"{key.lower()} = _")
        part = LAST_PART.search(key)
        if part and part[0].lower() != key.lower():
            out.append(f"..{part[0].lower()} = _")
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, th, n_email ... n_phone, base (the spans' text), found (instances with their patterns)."""
    kind = dict(docs.dtypes)["doc_id"]
    struct = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("value", pa.string()), ("base", pa.bool_()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
    names = ["doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", "base", "found"]

    def instances(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
        named = {m.end(): m[1] for m in ASSIGNED.finditer(text)} if "=" in text or ":" in text else {}
        out = [{"s": s, "e": e, "value": text[s:e], "base": True, "seed": True, "patterns": patterns(text, s, e, named)} for _, s, e in spans]
        if not named and not ANY.search(text):
            return out
        taken, k = sorted((s, e) for _, s, e in spans), 0
        for s, e in tokens(text, named):
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            near = itertools.takewhile(lambda x: x[0] < e, itertools.islice(taken, k, None))  # noqa: B023
            if not any(s < b for _, b in near) and (found := patterns(text, s, e, named)):
                out.append({"s": s, "e": e, "value": text[s:e], "base": False, "seed": bool(SECRET.fullmatch(text, s, e)), "patterns": found})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, counts, base, found = 0, 0, [[] for _ in range(4)], [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                spans = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in spans))
                base.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans))
                found.append(instances(text, spans))
                held += len(found[-1])
                if held >= BATCH or i == batch.num_rows - 1:
                    keys = [batch.column(c).slice(low, len(base)) for c in range(2)]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(found, pa.list_(struct))], names)
                    low, held, counts, base, found = i + 1, 0, [[] for _ in range(4)], [], []

    text = F.coalesce("text", F.lit(""))
    schema = f"doc_id {kind}, th long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<s:int,e:int,value:string,base:boolean,seed:boolean,patterns:array<string>>>"
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, schema)


def rated(edges: DataFrame, patterns: DataFrame, confidence: float, support: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """Trust of ``patterns`` and score of the values in them, seeds being 1, after so many passes over their part of the graph."""
    part = durable(edges.join(maybe_broadcast(patterns.select("pattern"), SMALL), "pattern"))
    score = part.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(passes):
        score = durable(score)
        trust = part.join(score.hint("merge"), "value").groupBy("pattern").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("trust"))
        trust = durable(trust)
        missed = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6))))
        score = part.join(trust.hint("merge"), "pattern").groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(missed)).alias("score"))
    return trust, durable(score)


def trusted_patterns(scanned: DataFrame, rounds: int, confidence: float, support: int, passes: int = 3) -> DataFrame:
    """The patterns of ``confidence`` or more, among those that hold ``support`` different values that are seeds or were found."""
    edges = scanned.select(F.explode("found").alias("i")).select(F.explode("i.patterns").alias("pattern"), "i.value", "i.seed")
    edges = durable(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.log1p(F.count("*")).alias("weight")))
    known, trust = None, None
    for _ in range(rounds):
        sure = edges.where("seed").select("pattern", "value")
        if known is not None:
            sure = sure.union(edges.where("not seed").join(score.where(F.col("score") >= confidence).select("value").hint("merge"), "value").select("pattern", "value"))
        several = durable(sure.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern"))
        if known is not None and several.join(known, "pattern", "left_anti").isEmpty():
            break
        known = several
        trust, score = rated(edges, known, confidence, support, passes)
    return trust.where(F.col("trust") >= confidence).select("pattern")


def personal_data(docs: DataFrame, rounds: int = 6, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """Spans of personal data in every row of ``docs`` (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone, n_id (new spans), base (the rules' spans as
    kind:start:end by kind, then start, joined by commas; code points, end exclusive) and
    spans (base and then the new ones, of kind id). Null and empty texts have none. Texts
    are searched whole, in time proportional to their length; words over 64 characters
    are no context, tokens under six no instances. Repeated rows give equal results and
    count as occurrences each; ties need no order; a null doc_id is a value like others;
    an empty table gives an empty result. Other columns are not read.
    """
    scanned = durable(scan(docs))
    trusted = maybe_broadcast(durable(trusted_patterns(scanned, rounds, confidence, support)), SMALL)
    new = scanned.select("doc_id", "th", F.explode("found").alias("i")).where("not i.base").select("doc_id", "th", "i.s", "i.e", F.explode("i.patterns").alias("pattern"))
    new = durable(new.join(trusted, "pattern").groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("more")))
    new = maybe_broadcast(new, SMALL, F.size("more"))
    out = scanned.drop("found").join(new, scanned.doc_id.eqNullSafe(new.d) & (scanned.th == new.t), "left")
    more = F.coalesce("more", F.array().cast("array<struct<s:int,e:int>>"))
    added = F.transform(more, lambda x: F.concat(F.lit("id:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    spans = F.array_join(F.concat(F.array_compact(F.array(F.nullif("base", F.lit("")))), added), ",")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size(more).cast("long").alias("n_id"), "base", spans.alias("spans"))

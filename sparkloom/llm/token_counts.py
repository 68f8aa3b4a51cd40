"""Token counts by a transducer: how many tokens a merge-by-score vocabulary cuts a text into, without the tokens.

The merges are compiled into a deterministic transducer over characters. Its state
after a prefix of a text says, for each place where a token that has begun could still
end later on, which token ends there and how many tokens that prefix has beyond the
whole; a transition is annotated with the tokens that it adds to the count (or takes
back: two tokens may become one). Two tokens may stand side by side exactly if no
merge reaches across them while both come to be, so each transition finds the one
token that can end at the new place. Between two characters that no token holds
side by side the state carries nothing over.

A long text is cut into chunks. A chunk's map takes an entry state to its exit state and
count; maps compose. A chunk is first mapped from the state that the characters before it
give; entries that another chunk leaves in are added until every chunk's exits are the
next one's entries. Then a scan in groups of chunks composes the maps of each text.
"""

from __future__ import annotations

import json
import re
from collections import Counter as Tally
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable

#: Characters of a chunk, characters before it that give its first entry, and maps that a step of the scan composes.
CHUNK, BEFORE, GROUP = 1 << 15, 256, 64
#: States (some 500 bytes each) and counts of words (some 150) kept in a worker; beyond it they are found anew.
KEPT, WORDS = 200_000, 400_000
SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Characters of the longest word whose count is kept.
LONG = 64


class Transducer:
    """The transducer of a vocabulary file, filled as texts need it.

    A state is a tuple of (node of the tree of pieces, last token before it, tokens up to
    there beyond the tokens up to here), oldest first; the empty text's is START.
    """

    START = ((0, "", 0),)

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.next: dict[tuple[int, str], int] = {}
        self.piece = [""]
        inner = set()
        self.beside = set()
        for piece in self.score:
            node = 0
            for c in piece:
                inner.add(node)
                if (node, c) not in self.next:
                    self.next[node, c] = len(self.piece)
                    self.piece.append(self.piece[node] + c)
                node = self.next[node, c]
            self.beside.update(zip(piece, piece[1:]))
        self.inner = inner
        self.made: dict[str, tuple | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.rows: list[dict[str, tuple[int, int]]] = []
        self.names: list[tuple] = []

    def merges(self, token: str) -> tuple | None:
        """How a token comes to be: the scores of its merges in order, each with the new last and first symbol (or None); None if it never is one token."""
        if token not in self.made:
            parts, steps = list(token), []
            while len(parts) > 1:
                best, at = max(((self.score.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=(None, 0))
                if best is None:
                    break
                at = -at
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[-1] if at == len(parts) - 1 else None, parts[0] if at == 0 else None))
            self.made[token] = tuple(steps) if len(parts) == 1 and token in self.score else None
        return self.made[token]

    def stand(self, left: str, right: str) -> bool:
        """Whether two tokens may follow each other: replays both tokens' merges in the order of the whole, looking for one across."""
        pair = (left, right)
        if (got := self.fits.get(pair)) is None:
            a, b, score = self.merges(left), self.merges(right), self.score
            u, w, i, j = left[-1], right[0], 0, 0
            while True:
                across = score.get(u + w)
                one, two = (a[i][0] if i < len(a) else None), (b[j][0] if j < len(b) else None)
                # Of equal scores the leftmost merge comes first.
                if across is not None and (one is None or across > one) and (two is None or across >= two):
                    got = False
                    break
                if one is None and two is None:
                    got = True
                    break
                if two is None or (one is not None and one >= two):
                    u = a[i][1] or u
                    i += 1
                else:
                    w = b[j][2] or w
                    j += 1
            self.fits[pair] = got
        return got

    def number(self, state: tuple) -> int:
        if (n := self.states.get(state)) is None:
            n = self.states[state] = len(self.names)
            self.names.append(state)
            self.rows.append({})
        return n

    def step(self, n: int, c: str) -> tuple[int, int]:
        """The transition from state number ``n`` on a character: the next state's number and the tokens that it adds."""
        alone = self.next.get((0, c))
        if alone is None:  # a character without a piece becomes its bytes, and nothing merges with those
            out = (self.number(self.START), len(c.encode()))
        else:
            kept, found, added = [], "", 0
            for node, last, more in self.names[n]:
                if node == 0 and last and (last[-1], c) not in self.beside:
                    last = ""
                if (there := self.next.get((node, c))) is None:
                    continue
                token = self.piece[there]
                if not found and token in self.score and self.merges(token) is not None and (not last or self.stand(last, token)):
                    found, added = token, more + 1
                if there in self.inner:
                    kept.append((there, last, more))
            state = (*((node, last, more - added) for node, last, more in kept), (0, found, 0))
            out = (self.number(state), added)
        self.rows[n][c] = out
        return out

    def run(self, text: str, entry: tuple = START) -> tuple[tuple, int]:
        """The state and the count after a text read from a state."""
        if len(self.names) > KEPT:
            self.states, self.rows, self.names = {}, [], []
        if len(self.fits) > WORDS:
            self.fits = {}
        n, count = self.number(entry), 0
        rows, step = self.rows, self.step
        for c in text:
            got = rows[n].get(c)
            if got is None:
                got = step(n, c)
            n = got[0]
            count += got[1]
        return self.names[n], count


class Counter:
    """Counts of texts by a transducer; a word from space to space starts and ends in states without a past, so its count is kept."""

    def __init__(self, path: str) -> None:
        self.machine, self.known = Transducer(path), {}
        machine = self.machine
        # A space ends what no piece holds together with it.
        self.apart = all(b != SPACE or a == SPACE for a, b in machine.beside)

    def words(self, text: str) -> list[str]:
        """A text that begins with a space in parts that no token joins: a run of spaces and what follows up to the next; the whole where pieces hold inner spaces."""
        return WORD.findall(text) if self.apart else [text]

    def count(self, text: str) -> int:
        total, known = 0, self.known
        for word, times in Tally(self.words(text)).items():
            n = known.get(word)
            if n is None:
                n = self.machine.run(word)[1]
                if len(word) <= LONG:
                    if len(known) > WORDS:
                        known.clear()
                    known[word] = n
            total += n * times
        return total


def counters(path: str) -> Counter:
    """The worker's counter of a vocabulary file, made once."""
    if path not in MADE:
        MADE[path] = Counter(path)
    return MADE[path]


MADE: dict[str, Counter] = {}


def escaped(text: str) -> str:
    """A text as the vocabulary reads it: one space before it, spaces as U+2581; an empty one stays."""
    return SPACE + text.replace(" ", SPACE) if text else ""


MAPS = "doc_id {}, n_bytes long, key long, i long, entry string, exit string, n_tokens long"


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, most: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (over ``most`` tokens) of every row's whole text.

    ``path`` is a sentencepiece file of merges by score, read without its begin and end;
    strings of its special tokens are text like any other. Null and empty texts have no
    bytes and no tokens. Repeated rows and rows without a doc_id are rows like others,
    no rows give none, other columns are not read. A text of over ``chunk`` characters is
    counted in chunks by several tasks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = rows.where(F.length("text") <= chunk)
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counters(path)
        for batch in batches:
            counts = [counter.count(escaped(x.as_py())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = short.mapInArrow(whole, f"doc_id {key_type}, n_bytes long, n_tokens long")
    out = out.unionByName(chunked(rows.where(F.length("text") > chunk), path, chunk))
    return out.withColumn("over_limit", F.col("n_tokens") > most)


def chunked(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    """doc_id, n_bytes and n_tokens of texts, each cut into chunks that are mapped apart and composed."""
    key_type = rows.schema["doc_id"].dataType.simpleString()
    maps_schema = MAPS.format(key_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "key", "i", "before", "text"]
        for batch in batches:
            for at in range(batch.num_rows):
                text = escaped(batch.column(3)[at].as_py())
                for low in range(0, len(text), chunk * 16):  # so many chunks a batch
                    starts = range(low, min(low + chunk * 16, len(text)), chunk)
                    same = [pa.concat_arrays([batch.column(c).slice(at, 1)] * len(starts)) for c in range(3)]
                    pieces = [pa.array([s // chunk for s in starts], pa.int64()), pa.array([text[max(0, s - BEFORE) : s] for s in starts]), pa.array([text[s : s + chunk] for s in starts])]
                    yield pa.RecordBatch.from_arrays([*same, *pieces], names)

    keyed = rows.select("doc_id", "n_bytes", F.monotonically_increasing_id().alias("key"), "text")
    pieces = durable(keyed.mapInArrow(cut, f"doc_id {key_type}, n_bytes long, key long, i long, before string, text string").repartition("key", "i"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counters(path).machine
        for batch in batches:
            entries, exits, counts = [], [], []
            for before, text, entry in zip(*(batch.column(c) for c in ("before", "text", "entry")), strict=True):
                state = loaded(entry.as_py()) if entry.is_valid else machine.run(before.as_py())[0]
                end, n = machine.run(text.as_py(), state)
                entries.append(json.dumps(state))
                exits.append(json.dumps(end))
                counts.append(n)
            done = [batch.column(c) for c in ("doc_id", "n_bytes", "key", "i")]
            yield pa.RecordBatch.from_arrays([*done, pa.array(entries, pa.string()), pa.array(exits, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "key", "i", "entry", "exit", "n_tokens"])

    start = json.dumps(Transducer.START)
    maps = durable(pieces.withColumn("entry", F.when(F.col("i") == 0, start)).mapInArrow(mapped, maps_schema))
    while True:
        left = maps.select("key", (F.col("i") + 1).alias("i"), F.col("exit").alias("entry")).distinct()
        wanted = durable(left.join(maps, ["key", "i", "entry"], "left_anti").join(maps.select("key", "i").distinct(), ["key", "i"], "left_semi"))
        if wanted.isEmpty():
            break
        maps = durable(maps.unionByName(pieces.join(wanted, ["key", "i"]).mapInArrow(mapped, maps_schema)))

    def composed(maps: pa.Table) -> pa.Table:
        """The maps of consecutive chunks as one; entries without a way through are no text's."""
        rows = sorted(maps.to_pylist(), key=lambda r: r["i"])
        first, last = rows[0]["i"], rows[-1]["i"]
        ways = {r["entry"]: (r["exit"], r["n_tokens"]) for r in rows if r["i"] == first}
        for i in range(first + 1, last + 1):
            step = {r["entry"]: (r["exit"], r["n_tokens"]) for r in rows if r["i"] == i}
            ways = {a: (step[b][0], n + step[b][1]) for a, (b, n) in ways.items() if b in step}
        out = [rows[0] | {"i": first // GROUP, "entry": a, "exit": b, "n_tokens": n} for a, (b, n) in ways.items()]
        return pa.Table.from_pylist(out, maps.schema)

    while (maps.agg(F.max("i")).first()[0] or 0) > 0:
        maps = durable(maps.groupBy("key", F.floor(F.col("i") / GROUP).alias("g")).applyInArrow(composed_of(composed), maps_schema))
    return maps.where(F.col("entry") == start).select("doc_id", "n_bytes", "n_tokens")


def composed_of(f):
    """A group's function of its rows alone, its key and the grouping column left out."""
    return lambda table: f(table.select(["doc_id", "n_bytes", "key", "i", "entry", "exit", "n_tokens"]))


def loaded(state: str) -> tuple:
    return tuple((node, last, more) for node, last, more in json.loads(state))

"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It begins as one state with a loop for each byte, and
every merge (u, v) in order adds one gadget: wherever u leads to a state q from
which v leads on, an arc for the merged token goes where v went, and u now leads
to a copy of q without the arc for v. All arcs for one token lead to one state
(true at the start, and a gadget keeps it true), so a state is its parent plus
one forbidden token, and a table of (state, token) says whether an arc exists:
a token is absent where it was removed, a merged token is present where its left
half was when the merge came. The automaton accepts exactly one segmentation of
every byte string, the one that applying the merges in order gives.

A word is encoded from left to right: every prefix has one accepted segmentation,
so one state is alive at each byte, and its incoming arc is the one token that
ends there and may follow the state alive at its start. What later bytes can need
of that is a bounded window (the longest suffix that begins a token, with the
states alive in it), so the windows are the states of a second, byte-driven
automaton, whose transition table is filled as words ask for it; a word is then
one table look-up a byte. Decoding emits the arcs' labels, which are byte strings.
The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the byte-level pre-tokeniser: its pattern, and the bytes that are written as themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)]
#: White space as the pre-tokeniser has it; the regex library's own class has four control characters more or less by version.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Words kept with their ids in a worker (beyond it the words that came first stay), and windows kept (beyond it the table starts anew).
CACHED_WORDS = 250_000
KEPT_WINDOWS = 250_000
#: Tokens after which a task hands on its rows.
BATCH = 500_000


def byte_chars() -> dict[str, int]:
    """The character of each byte in the vocabulary file, to the byte."""
    shown = [b for r in SHOWN for b in r]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """The tokenization automaton of a merge list, with its table filled as arcs are asked for."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        of = byte_chars()
        self.label = {i: bytes(of[c] for c in t) for t, i in vocab.items()}
        self.token = {b: i for i, b in self.label.items()}
        self.special = special
        self.label |= {i: s.encode() for s, i in special.items()}
        self.begins = {b[:k] for b in self.token for k in range(1, len(b) + 1)}
        self.name = {i: str(i) for i in self.label}
        #: By state: its parent, the token it forbids. State 0 forbids none; the n-th merge makes state n.
        self.parent = [0] * (len(merges) + 1)
        self.removed = [-1] * (len(merges) + 1)
        self.state = dict.fromkeys(self.token.values(), 0)
        self.left: dict[int, tuple[int, int]] = {}
        self.arcs: dict[int, bool] = {}
        for n, (a, b) in enumerate(merges, 1):
            u, v = vocab[a], vocab[b]
            target, at = vocab[a + b], self.state[u]
            if target in self.left:
                continue
            self.parent[n], self.removed[n] = at, v
            self.left[target] = (u, n)
            self.state[target] = self.state[v]
            self.state[u] = n
        self.fresh()
        pattern = PATTERN.replace(r"\s\p{L}", SPACE + r"\p{L}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.split = regex.compile(pattern).findall
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in data["added_tokens"]})

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        key = state << 20 | token
        if (known := self.arcs.get(key)) is not None:
            return known
        u, n = self.left.get(token, (-1, 0))
        s, ok = state, True
        while s > n:  # what was removed after the token came
            if self.removed[s] == token:
                ok = False
                break
            s = self.parent[s]
        if ok:
            if u >= 0:
                ok = self.arc(s, u)
            else:
                while s and self.removed[s] != token:
                    s = self.parent[s]
                ok = s == 0
        self.arcs[key] = ok
        return ok

    def fresh(self) -> None:
        """An empty transition table: only the window at the start of a word."""
        self.arcs.clear()
        self.windows: list[tuple[bytes, tuple[int, ...], int]] = [(b"", (0,), -1)]
        self.numbers = {self.windows[0]: 0}
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]

    def next(self, window: int, byte: int) -> int:
        """The window after one more byte: what the transition table gets at that place."""
        suffix, alive, _ = self.windows[window]
        suffix += bytes((byte,))
        for start in range(len(suffix)):
            token = self.token.get(suffix[start:])
            if token is not None and self.arc(alive[start], token):
                break
        else:
            raise ValueError(f"no segmentation of {suffix!r}")
        alive += (self.state[token],)
        while suffix not in self.begins:
            suffix, alive = suffix[1:], alive[1:]
        new = (suffix, alive, token)
        if (number := self.numbers.get(new)) is None:
            number = self.numbers[new] = len(self.windows)
            self.windows.append(new)
            self.ends.append(token)
        self.step[window << 8 | byte] = number
        return number

    def word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        if len(self.windows) > KEPT_WINDOWS:
            self.fresh()
        step, ends, window, last = self.step, self.ends, 0, []
        for byte in word:
            at = step.get(window << 8 | byte)
            window = self.next(window, byte) if at is None else at
            last.append(ends[window])
        out, size, label = [], len(word), self.label
        while size:
            out.append(last[size - 1])
            size -= len(label[out[-1]])
        return out[::-1]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special tokens' strings; True for those."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str, known: dict[str, list[int]] | None = None) -> list[int]:
        known = {} if known is None else known
        out: list[int] = []
        for part, is_special in self.parts(text):
            if is_special:
                out.append(self.special[part])
                continue
            for w in self.split(part):
                ids = known.get(w)
                if ids is None:
                    ids = self.word(w.encode())
                    if len(known) < CACHED_WORDS and len(w) <= 40:
                        known[w] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, one after the other, as text."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, tuple[Automaton, dict[str, list[int]]]] = {}


def _automaton(path: str) -> tuple[Automaton, dict[str, list[int]]]:
    if path not in _loaded:
        _loaded[path] = (Automaton.load(path), {})
    return _loaded[path]


def encode(docs: DataFrame, path: str, digests: bool = False, decoded: bool = True) -> DataFrame:
    """Every text of ``docs`` (doc_id, text) as token ids, and the ids decoded again.

    Returns doc_id, n_tokens, ids (array of int) and, unless ``decoded`` is false, decoded;
    with ``digests`` instead of the last two ids_sha256 and decoded_sha256. Null and empty
    texts have no ids and decode to the empty text. Rows are kept as they come, repeated
    ones and null doc_id included; an empty table gives an empty result; other columns are
    not read. Texts are encoded whole, one at a time; rows are handed on whenever BATCH
    tokens are gathered, in flat buffers, so a task holds little beside its largest text.
    """
    types = dict(docs.dtypes)
    decoded = decoded or digests
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded") if decoded else ("ids",))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)

        def rows(doc_ids: pa.Array, n: list[int], flat: array, marks: list[str], texts: list[str]) -> pa.RecordBatch:
            columns = [doc_ids, pa.array(n, pa.int64())]
            if digests:
                columns.append(pa.array(marks, pa.string()))
            else:
                ends = pa.array([0, *itertools.accumulate(n)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])))
            if decoded:
                columns.append(pa.array(texts, pa.string()))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            start, held, n, flat, marks, texts = 0, 0, [], array("i"), [], []
            for k, text in enumerate(batch.column(1)):
                ids = automaton.encode(text.as_py() or "", known)
                n.append(len(ids))
                held += len(ids)
                if digests:
                    marks.append(hashlib.sha256(",".join(map(automaton.name.__getitem__, ids)).encode()).hexdigest())
                    texts.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
                else:
                    flat.extend(ids)
                    if decoded:
                        texts.append(automaton.decode(ids))
                if held >= BATCH or k == batch.num_rows - 1:
                    yield rows(batch.column(0).slice(start, len(n)), n, flat, marks, texts)
                    start, held, n, flat, marks, texts = k + 1, 0, [], array("i"), [], []

    kinds = {"ids": "array<int>", "n_tokens": "bigint", "doc_id": types["doc_id"]}
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))

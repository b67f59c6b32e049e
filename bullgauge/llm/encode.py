"""Byte-level BPE over a whole corpus by a tokenization automaton.

Method. Over the alphabet of tokens, the automaton that accepts exactly the token strings which the
merges produce is built merge by merge: it begins with one state per byte in which every byte may follow, and
the gadget of a merge (u, v) -> w takes the arc v out of the state after u, adds the arc w wherever
u is an arc, and gives w the arcs that v's state had before. A state is thus told by the last token alone,
and whether an arc is there follows from the order of the gadgets (``Gadgets.follows``). Read byte
by byte, this automaton is made deterministic with a trie of the arc labels: a deterministic state
is the last token of the (unique) accepted string for the bytes so far plus the arcs that are
partly read. Its transitions are a table that is filled when first used; the pre-split words of a
batch run through it side by side, one byte a step, and the labels are emitted from the end.

Defined results: null and empty texts have an empty list; strings that look like special tokens are
ordinary text; a text of any length is one row; no special tokens are added.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: White space as Unicode defines it; the pre-split of byte-level BPE, fixed by the tokenizer.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
LONG = 192  # bytes; longer words run alone, so one of them doesn't keep a batch waiting
MOST_STATES = 1 << 16  # 1 kB each; a table that has grown beyond is begun anew before the next words


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: bytes that print stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Gadgets:
    """The token automaton: tokens in order of birth, each with the two it was merged from."""

    def __init__(self, model: dict):
        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        n = max(self.text) + 1
        self.birth, self.left, self.right = [0] * n, [-1] * n, [-1] * n
        self.pair: dict[tuple[int, int], int] = {}
        for k, m in enumerate(model["merges"], 1):
            a, b = m if isinstance(m, list) else m.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((u, v), k)
            if not self.birth[w]:
                self.birth[w], self.left[w], self.right[w] = k, u, v
        self.memo: dict[int, bool] = {}

    def follows(self, a: int, b: int) -> bool:
        """Is there an arc b in the state after a, when all gadgets are in place?"""
        key = a << 20 | b
        known = self.memo.get(key)
        if known is None:
            known = self.memo[key] = self._arc(a, b)
        return known

    def _arc(self, a: int, b: int) -> bool:
        now = 1 << 60
        while True:
            if self.pair.get((a, b), now + 1) <= now:
                return False  # a gadget took it out
            x, y = self.birth[a], self.birth[b]
            if x == y == 0:
                return True
            if x > y:  # the state after a began as a copy of the one after its right part
                a, now = self.right[a], x - 1
            elif y > x:  # the arc b was added where its left part was an arc
                if self.left[b] == self.right[b] == a:
                    return False
                b, now = self.left[b], y - 1
            else:
                a, b, now = self.right[a], self.left[a], x - 1


class Automaton:
    """The byte-deterministic table."""

    def __init__(self, model: dict):
        self.g = Gadgets(model)
        self.child: list[dict[int, int]] = [{}]
        self.label: list[int] = [-1]
        for t, s in self.g.text.items():
            node = 0
            for b in s:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.label.append(-1)
                node = nxt
            self.label[node] = t
        self.size = np.zeros(len(self.g.birth), np.int32)
        for t, s in self.g.text.items():
            self.size[t] = len(s)
        self.begin()

    def begin(self) -> None:
        """An empty table; arcs and labels stay."""
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.table = np.full((4096, 256), -1, np.int32)
        self.last = np.full(4096, -1, np.int32)
        self.state((-1, ()))

    def state(self, key: tuple) -> int:
        k = self.states.get(key)
        if k is None:
            k = self.states[key] = len(self.keys)
            self.keys.append(key)
            if k >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
            self.last[k] = key[0]
        return k

    def step(self, state: int, byte: int) -> int:
        token, live = self.keys[state]
        end, on = -1, []
        for node, before in (*live, (0, token)):
            x = self.child[node].get(byte)
            if x is None:
                continue
            t = self.label[x]
            if t >= 0 and (before < 0 or self.g.follows(before, t)):
                end = t
            if self.child[x]:
                on.append((x, before))
        k = self.state((end, tuple(on)))
        self.table[state, byte] = k
        return k

    def _alone(self, word: bytes) -> np.ndarray:
        """Labels of one word, by plain look-ups: its states soon repeat."""
        known: dict[int, int] = {}
        path = []
        s = 0
        for b in word:
            key = s << 8 | b
            nxt = known.get(key)
            if nxt is None:
                nxt = int(self.table[s, b])
                known[key] = nxt = nxt if nxt >= 0 else self.step(s, b)
            path.append(nxt)
            s = nxt
        return self.last[path]

    def run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(labels of all words one after the other, where each word's labels begin; one more at the end)."""
        if len(self.keys) > MOST_STATES:
            self.begin()
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=start[1:])
        data = np.frombuffer(b"".join(words), np.uint8)
        label = np.empty(len(data), np.int32)
        order = np.argsort(-size, kind="stable")
        many = int(np.searchsorted(-size[order], -LONG))  # the longest come first
        for w in order[:many]:
            label[start[w] : start[w + 1]] = self._alone(words[w])
        order = order[many:]
        at, left = start[order], size[order]
        state = np.zeros(len(order), np.int32)
        for i in range(int(left[0]) if len(left) else 0):
            k = int(np.searchsorted(-left, -i))  # words longer than i
            pos = at[:k] + i
            byte = data[pos]
            now = state[:k]
            nxt = self.table[now, byte]
            lost = np.flatnonzero(nxt < 0)
            if lost.size:
                both = now[lost].astype(np.int64) << 8 | byte[lost]
                todo, back = np.unique(both, return_inverse=True)
                nxt[lost] = np.array([self.step(int(x >> 8), int(x & 255)) for x in todo], np.int32)[back]
            state[:k] = nxt
            label[pos] = self.last[nxt]
        # the labels of the accepted string, from each word's end
        mark = np.zeros(len(data), bool)
        pos, low = start[1:][size > 0] - 1, start[:-1][size > 0]
        while pos.size:
            mark[pos] = True
            pos = pos - self.size[label[pos]]
            on = pos >= low
            pos, low = pos[on], low[on]
        return label[mark], np.r_[0, np.cumsum(mark)][start]


class Encoder:
    def __init__(self, model: dict):
        self.automaton = Automaton(model)
        self.split = regex.compile(SPLIT).findall

    def words(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, the words of all texts by number, words of each text)."""
        number: dict[str, int] = {}
        flat: list[int] = []
        counts = []
        for t in texts:
            found = self.split(t) if t else []
            flat += [number.setdefault(w, len(number)) for w in found]
            counts.append(len(found))
        return list(number), np.array(flat, np.int64), np.array(counts, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin; one more at the end)."""
        words, flat, counts = self.words(texts)
        ids, start = self.automaton.run([w.encode("utf-8", "surrogatepass") for w in words])
        size = np.diff(start)[flat] if flat.size else flat
        ends = np.cumsum(size)
        out = ids[np.repeat(start[:-1][flat] - (ends - size), size) + np.arange(int(ends[-1]))] if flat.size else ids[:0]
        return out, np.r_[0, ends][np.r_[0, np.cumsum(counts)]].astype(np.int64)

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        words, flat, counts = self.words(texts)
        _, start = self.automaton.run([w.encode("utf-8", "surrogatepass") for w in words])
        sums = np.r_[0, np.cumsum(np.diff(start)[flat] if flat.size else flat)]
        return np.diff(sums[np.r_[0, np.cumsum(counts)]])

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.automaton.g.text[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str, model: bytes | None = None) -> Encoder:
    """One encoder per Python worker; its table grows with the words it meets."""
    e = _encoders.get(path)
    if e is None:
        e = _encoders[path] = Encoder(json.loads(model or open(path, "rb").read())["model"])
    return e


#: Texts per round: bounds the memory of a worker, whatever the size of an Arrow batch.
ROUND = 1_000_000


def _rounds(texts: list[str | None]) -> Iterator[slice]:
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= ROUND:
            yield slice(a, k + 1)
            a, size = k + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def _model(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast; it is a fixed file of a few MB and is checked to be one."""
    data = open(path, "rb").read()
    assert len(data) < 64 << 20, "not a tokenizer file"
    return spark.sparkContext.broadcast(data)


def ids(spark: SparkSession, docs: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """key, ids of every row."""
    model = _model(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in _rounds(texts):
                out, at = encoder(path, model.value).encode(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.int32()))
                yield pa.record_batch([b.column(0)[part.start : part.stop], lists], names=["key", "ids"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "key long, ids array<int>")


def sizes(spark: SparkSession, docs: DataFrame, keys: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """keys and n_ids of every row; no list of ids leaves the worker."""
    model = _model(spark, path)
    rows = docs.select(*keys, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields) + ", n_ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            for part in _rounds(texts):
                n = encoder(path, model.value).sizes(texts[part])
                yield pa.record_batch([*(b.column(i)[part.start : part.stop] for i in range(len(keys))), pa.array(n, pa.int64())], names=[*keys, "n_ids"])

    return rows.mapInArrow(run, schema)

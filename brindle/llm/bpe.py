"""BPE encoding by an automaton over tokens, and decoding by its arc labels.

Compilation starts from one state that loops on every byte and applies one gadget a merge (u, v) -> uv:
the state that u leads to is split into a copy without its v arc, u is led to the copy, and every state with
a u arc gets an arc uv to the state that v leads to. A path of arcs from the start is then exactly a proper
token sequence, and every text has exactly one. All arcs with one label lead to one state, so TARGET[label]
is the whole transition table; a state is its parent less one label, and ARC answers lie in a table that
fills as they are asked for. Encoding walks the vocabulary's byte trie, takes the longest arc that exists and
goes back where a path ends; a position that failed is never tried again, so a word costs at most its length
times the longest token.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import slices

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS, CACHED_ARCS = 150_000, 200_000
LONGEST_CACHED = 64


def _byte_of() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        back = _byte_of()
        raw = lambda s: bytes(back[c] for c in s)
        self.special = special or {}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.label: list[bytes] = [b""] * top
        for s, i in vocab.items():
            if s not in self.special:
                self.label[i] = raw(s)
        for s, i in self.special.items():
            self.label[i] = s.encode()
        # Gadgets. State 0 loops on every byte; state k > 0 is PARENT[k] less the label CUT[k], made at merge BORN[k].
        self.parent, self.cut, self.born = [0], [-1], [-1]
        self.left: dict[int, int] = {}
        self.rank = [-1] * top
        self.target = [0] * top
        self.arcs: dict[int, bool] = {}
        self.width = top
        for k, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            q = self.target[u]
            follows = self.target[v] if u != v else q
            if self.arc(q, v):
                self.parent.append(q)
                self.cut.append(v)
                self.born.append(k)
                self.target[u] = len(self.parent) - 1
                self.target[uv] = follows
                self.left[uv], self.rank[uv] = u, k
        # Byte trie of the labels that have arcs.
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, word in enumerate(self.label):
            if word and (len(word) == 1 or i in self.left):
                at = 0
                for c in word:
                    if (to := self.next[at].get(c)) is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.token.append(-1)
                    at = to
                self.token[at] = i
        self.words: dict[str, bytes] = {}

    def arc(self, q: int, x: int) -> bool:
        """Whether state q has an arc labelled x."""
        key = q * self.width + x
        if (known := self.arcs.get(key)) is not None:
            return known
        p, y, found = q, x, True
        while p:
            if self.born[p] <= self.rank[y]:
                y = self.left[y]
            elif self.cut[p] == y:
                found = False
                break
            else:
                p = self.parent[p]
        self.arcs[key] = found
        if len(self.arcs) > CACHED_ARCS:
            self.arcs.clear()
        return found

    def path(self, word: bytes) -> list[int]:
        """The labels of the one path that spells word."""
        n, nexts, tokens, target, arcs, width = len(word), self.next, self.token, self.target, self.arcs, self.width
        dead: set[int] = set()
        out: list[int] = []
        starts: list[int] = []
        at, limit, state = 0, n, 0
        while at < n:
            node, best, end = 0, -1, at
            for k in range(at, limit):
                node = nexts[node].get(word[k], -1)
                if node < 0:
                    break
                t = tokens[node]
                if t >= 0 and k + 1 not in dead:
                    known = arcs.get(state * width + t)
                    if known if known is not None else self.arc(state, t):
                        best, end = t, k + 1
            if best >= 0:
                out.append(best)
                starts.append(at)
                at, limit, state = end, n, target[best]
            else:  # the path ends here: go back one arc and take a shorter one
                dead.add(at)
                limit = at
                out.pop()
                at = starts.pop()
                state = target[out[-1]] if out else 0
                limit -= 1
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        words, parts = self.words, []
        pieces = [text]
        for s in self.special:
            if s in text:
                pieces = [y for x in pieces for y in (_between(x, s) if isinstance(x, str) and x not in self.special else [x])]
        for piece in pieces:
            if piece in self.special:
                parts.append(array("I", [self.special[piece]]).tobytes())
                continue
            found = _SPLIT(piece)
            try:
                parts.extend([words[w] for w in found])
                continue
            except KeyError:
                pass
            for w in found:
                ids = words.get(w)
                if ids is None:
                    ids = array("I", self.path(w.encode())).tobytes()
                    if len(w) <= LONGEST_CACHED:
                        if len(words) >= CACHED_WORDS:
                            words.clear()
                        words[w] = ids
                parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after another."""
        return b"".join(map(self.label.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_SPLIT = regex.compile(PATTERN).findall
_MADE: dict[str, Automaton] = {}


def _between(text: str, s: str) -> list[str]:
    out: list[str] = []
    for k, x in enumerate(text.split(s)):
        out += [s] * (k > 0) + [x] * bool(x)
    return out


def load(path: str) -> Automaton:
    """The automaton of a tokenizer file, compiled once a process."""
    if path not in _MADE:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        _MADE[path] = Automaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})
    return _MADE[path]


def _lists(codes: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes, without an object for each id."""
    offsets = np.cumsum([0, *(len(c) // 4 for c in codes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(codes), "<i4")))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>?, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    Null texts are empty and have no tokens. Ids of special tokens are given where their strings stand in a
    text. Rows stay rows: null and repeated ids come back as they are; other columns are not read.
    """
    schema = "doc_id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for b in slices(batches):
            ids, n, a, d = [], [], [], []
            for value in b[1]:
                code = coder.encode(value.as_py() or "")
                n.append(len(code) // 4)
                a.append(hashlib.sha256(code).hexdigest())
                d.append(hashlib.sha256(coder.decode(code).encode()).hexdigest())
                if with_ids:
                    ids.append(code)
            cols = [b[0]] + ([_lists(ids)] if with_ids else []) + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of token ids; null arrays give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for b in slices(batches):
            texts = [None if x is None else coder.decode(array("I", x).tobytes()) for x in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")

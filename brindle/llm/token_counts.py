"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens go into one trie. A trie node keeps the best forward score of its prefix and that path's
number of tokens, so a prefix that pre-tokens share is scored once; the node where a pre-token ends has its
count. Candidates for the last token are found by walking the vocabulary's trie of reversed tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bpe import PATTERN
from brindle.llm.rows import slices

NODES = 1_500_000  # of one trie; a fuller one is begun anew
_SPLIT = regex.compile(PATTERN).findall
_READ: dict[str, dict[bytes, float]] = {}


def zipf(path: str) -> dict[bytes, float]:
    """Token -> log probability by Zipf's law over the ranks of a tiktoken file."""
    if path not in _READ:
        ranks = [line.split() for line in Path(path).read_bytes().splitlines() if line]
        total = math.log(sum(1 / (k + 1) for k in range(len(ranks))))
        _READ[path] = {base64.b64decode(a): -math.log(int(b) + 1) - total for a, b in ranks}
    return _READ[path]


class Trie:
    """vocabulary: token -> log probability, every single byte among them."""

    def __init__(self, vocabulary: dict[bytes, float]):
        self.back: list[dict[int, int]] = [{}]
        self.weight: list[float | None] = [None]
        for token, w in vocabulary.items():
            at = 0
            for c in reversed(token):
                if (to := self.back[at].get(c)) is None:
                    to = self.back[at][c] = len(self.back)
                    self.back.append({})
                    self.weight.append(None)
                at = to
            self.weight[at] = w
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.count: dict[str, int] = {}  # of each pre-token that ends in the trie
        self.score: dict[str, float] = {}

    def insert(self, word: str) -> None:
        raw, child, best, tokens = word.encode(), self.child, self.best, self.tokens
        path, at = [0], 0
        for depth, c in enumerate(raw, 1):
            key = at << 8 | c
            to = child.get(key)
            if to is None:
                top, n, node = -math.inf, 0, 0
                for k in range(depth - 1, -1, -1):
                    node = self.back[node].get(raw[k], -1)
                    if node < 0:
                        break
                    if (w := self.weight[node]) is not None and ((s := best[path[k]] + w) > top or s == top and tokens[path[k]] + 1 < n):
                        top, n = s, tokens[path[k]] + 1
                to = child[key] = len(best)
                best.append(top)
                tokens.append(n)
            at = to
            path.append(at)
        self.count[word], self.score[word] = tokens[at], best[at]

    def __call__(self, text: str) -> tuple[int, int, float]:
        """Pre-tokens, tokens, and log probability of a text."""
        words = _SPLIT(text)
        count = self.count
        for _ in range(2):
            try:
                return len(words), sum(map(count.__getitem__, words)), math.fsum(map(self.score.__getitem__, words))
            except KeyError:
                if len(self.best) > NODES:
                    self.clear()
                    count = self.count
                for w in {w for w in words if w not in count}:  # a set less a view would walk the whole view
                    self.insert(w)
        raise AssertionError


_TRIES: dict[str, Trie] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of every whole text; score is the log probability.

    Null and empty texts have zeros, very long ones are counted whole. Of paths with one score the shortest counts (ties).
    Rows stay rows, with null or repeated ids too, and no rows give none; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TRIES:
            _TRIES[path] = Trie(zipf(path))
        for b in slices(batches):
            got = [_TRIES[path](t.as_py() or "") for t in b[1]]
            a, n, s = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b[0], pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")

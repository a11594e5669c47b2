"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and a scaled identity. The score is the
logistic of the difference of both log densities, from Mahalanobis distances through Cholesky factors that are
made once, and of the priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import labels as L
from brindle.llm.rows import TEXTS, slices

SAMPLE = 20_000
FOLDS, FOLD = 3, 1
_UPPER, _DIGIT, _SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"
_END, _LOUD, _SIGN = b".?", b"!", bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()")


def statistics(text: str | None) -> list[float]:
    """Logs of smoothed rates, so that heavy tails become nearly normal; an empty text has those of no words."""
    b = (text or "").encode()
    words = b.split()
    n, m = len(words), len(b)
    count = lambda chars: m - len(b.translate(None, chars))
    rate = lambda x, of, least: np.log((x + least) / (of + 20 * least))
    lines = b.split(b"\n")
    ends, distinct = count(_END), len(set(words))
    return [
        np.log1p(n),
        np.log((m + 5) / (n + 1)),
        rate(count(_UPPER), m, 0.5),
        rate(count(_DIGIT), m, 0.5),
        rate(count(_LOUD), n, 0.5),
        rate(count(_SIGN), n, 0.5),
        rate(ends, n, 0.5),
        rate(b.count(b"|"), n, 0.5),
        np.log((distinct + 1) / (n + 1)) / np.log(n + 3),
        rate(len(lines) - len(set(lines)), len(lines), 0.5),
        np.log((n + 1) / len(lines)),
        rate(m - len(b.replace(b", ", b",")), n, 0.5),
    ]


@dataclass
class Discriminant:
    mean: np.ndarray  # by class
    factor: np.ndarray  # inverse of each Cholesky factor
    offset: np.ndarray  # log prior less half the log determinant
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        d = [self.offset[k] - 0.5 * (((z - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 0.05) -> Discriminant | None:
    """None where a class has no rows."""
    if not len(y) or y.min() == y.max():
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -12, 12)
    parts = [z[y == k] for k in (0, 1)]
    means = np.stack([p.mean(0) for p in parts])
    own = [np.cov(p.T, bias=True) if len(p) > 1 else np.eye(z.shape[1]) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(z)
    p = z.shape[1]
    factors, offsets = [], []
    for part, c in zip(parts, own, strict=True):
        a = max(shrink, p / (p + len(part)))
        c = (1 - a) * c + a * pooled
        c = (1 - ridge) * c + ridge * np.trace(c) / p * np.eye(p)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(len(part) / len(z)) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.stack(factors), np.array(offsets), centre, scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Discriminant | None:
    """Fit on at most `rows` labelled documents outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b[2], pa.array([statistics(t.as_py()) for t in b[1]], pa.list_(pa.float64()))], names=["label", "x"])

    chosen = L.sample(labels, "quality", FOLDS, FOLD, rows)
    got = L.labelled(docs, chosen, id_col, text_col).mapInArrow(run, "label int, x array<double>").toArrow()
    x, y = np.array(got["x"].to_pylist(), float).reshape(got.num_rows, len(statistics(""))), got["label"].to_numpy()
    order = np.lexsort((*x.T, y))  # so that sums don't depend on partitions
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null texts score as empty ones, very long ones by the whole. Where no label of one class is at hand every score is
    0.5. Null ids and repeated rows are scored like others, ties and all. No rows give none; columns other than id and
    text are not read, whatever their names.
    """
    model = train(docs, labels, id_col, text_col, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t.as_py()) for t in b[1]], float)
            score = model.score(x) if model and b.num_rows else np.full(b.num_rows, 0.5)
            held = [L.held_out(i, FOLDS, FOLD) for i in b[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows predicted good, with all their columns; a row is scored by its own text, so ids don't matter.

    Null texts score as empty ones, very long ones by the whole; repeated rows share the verdict. Where no label of one
    class is at hand every row stays. No rows give none. Other columns may have any name.
    """
    model = train(docs, labels, id_col, text_col)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        parts = [np.ones(len(texts) if model is None else 0, bool)]
        if model is not None:
            for k in range(0, len(texts), TEXTS):
                parts.append(model.score(np.array([statistics(t.as_py()) for t in texts.slice(k, TEXTS)], float)) >= 0.5)
        return pa.array(np.concatenate(parts))

    return docs.where(good(F.col(f"`{text_col}`")))

"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel compares windows of WIDTH consecutive words (a run of spaced-out letters read as a word) by their words'
subsequences of three symbols that span at most five, decayed by gap, so an inserted or dropped character keeps most
of the similarity. The machine sees each window as its similarities to landmark windows, whitened. As the kernel has
explicit features, trained weights fold into one table over symbol triples; a word's sums over the table are kept, and
a window's margin follows from those of its words. A document's score is a logistic of its three worst windows, of how
many stand on the toxic side, and of their number.

Labels are of documents, of whose windows few are toxic. Those of toxic documents that hold a marked word train as
toxic, marked being words that stand in toxic documents far more often than chance has it, and words with a symbol run
that does and that clean documents lack; windows of clean documents train as clean, at first some of each document, then
those that the machine takes for toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import labels as L
from brindle.llm.rows import slices
from brindle.session import scope, stash

#: Bounds of the training, which is all on a bounded sample; scoring has none.
SAMPLE = 12_000  # labelled documents that training reads
MARKS, MARKED = 400, 3_000  # symbol runs and words that mark toxic documents
POSITIVE, NEGATIVE, LANDMARKS = 3_000, 9_000, 480  # windows to train on (as many hard ones as NEGATIVE beside), and landmarks
EACH = 3  # windows of one clean document, or of one toxic document and marked word, that training takes
FOLDS, FOLD = 5, 0
WIDTH = 2  # words of a window
SURE = 13.0  # least -log chance that a run marks toxic documents by accident
CACHED = 300_000  # words whose sums a task keeps
_STEPS = [(1, 2, 1.0), (1, 3, 0.6), (2, 3, 0.6), (1, 4, 0.36), (2, 4, 0.36), (3, 4, 0.36)]
_LEET = str.maketrans("013457@$", "oieastas")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_EDGES = re.compile(r"[\W_]+")
_OWN = 64**3  # codes of triples of a to z; as many hold the others by hash


def fragments(text: str | None) -> list[str]:
    """Words in lower case, and each run of three or more single characters as one word."""
    low = (text or "").lower()
    return low.split() + [x.replace(" ", "").replace("\t", "") for x in _SPACED.findall(low)]


def plain(word: str) -> str:
    """The word as the kernel reads it: digits that stand for letters as those, other signs left out."""
    return _EDGES.sub("", word.translate(_LEET) if not word.isdigit() else word)


def windows(text: str | None) -> list[str]:
    """Each run of WIDTH plain words, space-joined; a shorter text is one. Single letters have no triple and count as none."""
    words = [p for w in fragments(text) if len(p := plain(w)) > 1]
    return [" ".join(words[k : k + WIDTH]) for k in range(max(1, len(words) - WIDTH + 1))] if words else []


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the symbol triples within the words of space-joined units, their weights, and the unit of each."""
    split = [u.split(" ") for u in units]
    words = [w for u in split for w in u]
    text = "".join(f"\0{w}\0\0\0\0" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) + 5 for w in words])
    owner = np.repeat(np.arange(len(units)), [len(u) for u in split])[word] if words else word
    plain_letter = (points >= 97) & (points <= 122)
    points[np.r_[0, np.flatnonzero(np.diff(word)) + 1][: len(words)]] = 96  # a word's begin
    plain_letter |= points == 96
    n = len(points)
    codes, weights, of = [], [], []
    for i, j, w in _STEPS:
        a, b, c = points[: n - j], points[i : n - j + i], points[j:]
        full = (a > 0) & (b > 0) & (c > 0) & (word[: n - j] == word[j:])
        a, b, c = a[full], b[full], c[full]
        own = (plain_letter[: n - j] & plain_letter[i : n - j + i] & plain_letter[j:])[full]
        spread = ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) >> 7) % _OWN
        codes.append(np.where(own, ((a - 95) * 64 + (b - 95)) * 64 + (c - 95), _OWN + spread))
        weights.append(np.full(len(a), w))
        of.append(owner[: n - j][full])
    return np.concatenate(codes), np.concatenate(weights), np.concatenate(of)


def _norms(n: int, weights: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.sqrt(np.bincount(of, weights**2, n)) + 1e-9


def kernel(units: list[str], marks: list[str]) -> np.ndarray:
    """Similarities of each unit to each landmark: about 1 for equal ones (more where a triple repeats), 0 without a common triple."""
    code, weight, of = _codes(marks)
    known = np.unique(code)
    table = np.zeros((len(known), len(marks)), np.float32)
    np.add.at(table, (np.searchsorted(known, code), of), weight / _norms(len(marks), weight, of)[of])
    out = np.zeros((len(units), len(marks)), np.float32)
    step = 400  # units whose features are held at a time
    for low in range(0, len(units), step):
        part = units[low : low + step]
        code, weight, of = _codes(part)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[at] == code
        order = np.argsort(of[hit], kind="stable")
        of_hit = of[hit][order]
        if not len(of_hit):
            continue
        rows = table[at[hit][order]] * (weight / _norms(len(part), weight, of)[of])[hit][order].astype(np.float32)[:, None]
        first = np.flatnonzero(np.r_[True, of_hit[1:] != of_hit[:-1]])
        out[low + of_hit[first]] = np.add.reduceat(rows, first, axis=0)
    return out


@dataclass
class Machine:
    table: np.ndarray  # weight of each symbol triple
    bias: float
    weights: np.ndarray | None = None  # of evidence(), the last one of the constant
    range: tuple[np.ndarray, np.ndarray] | None = None  # of evidence() in training; nothing is carried on beyond

    def sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the weighted sum over the table and the squared norm."""
        code, weight, of = _codes(words)
        return np.bincount(of, self.table[code] * weight, len(words)), np.bincount(of, weight**2, len(words))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        seen = np.clip(evidence, *self.range)
        return 1 / (1 + np.exp(-np.clip(np.c_[seen, np.ones(len(seen))] @ self.weights, -500, 500)))


class Scorer:
    """Margins of documents' windows; the sums of CACHED words are kept at most."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.plain: list[str] = []
        self.sum, self.norm = np.zeros(0), np.zeros(0)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.clear()
            new = list(words)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            read = [plain(w) for w in part]
            s, q = self.machine.sums(read)
            self.known.update(zip(part, range(len(self.plain), len(self.plain) + len(part)), strict=True))
            self.plain += read
            self.sum, self.norm = np.r_[self.sum, s], np.r_[self.norm, q]

    def margins(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each window of the fragments of a text, and the numbers of its words; the words are known."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = at[self.norm[at] > 0]
        s, q, n = self.sum[at], self.norm[at], min(WIDTH, len(at))
        if not n:
            return np.zeros(0), at
        m = len(at) - n + 1
        return sum(s[k : k + m] for k in range(n)) / np.sqrt(sum(q[k : k + m] for k in range(n))) + self.machine.bias, at

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Evidence of each text, and its worst window."""
        parts = [fragments(t) for t in texts]
        self.learn({w for p in parts for w in p})
        out, worst = [], []
        for p in parts:
            m, at = self.margins(p)
            out.append(evidence(m, self.machine.bias))
            w = int(m.argmax()) if len(m) else 0
            worst.append(" ".join(self.plain[k] for k in at[w : w + WIDTH]))
        return np.array(out).reshape(len(parts), 5), worst


def evidence(margins: np.ndarray, least: float) -> list[float]:
    """The three largest margins, the logs of the number of toxic windows and of all."""
    top = np.sort(np.r_[np.partition(margins, -3)[-3:] if len(margins) > 3 else margins, [least] * 3])[::-1][:3]
    return [*np.clip(top, -5, 5), np.log1p((margins > 0).sum()), np.log1p(len(margins))]


def train_machine(bad: list[str], good: list[str], rounds: int = 30, c: float = 10.0) -> Machine:
    """A linear machine with squared hinge loss over whitened similarities to landmarks, by Newton steps.

    bad, good: windows; the landmarks are the first of each. Both classes weigh the same.
    """
    marks = list(dict.fromkeys(bad[: LANDMARKS // 2] + good[: LANDMARKS // 2]))
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(float))
    whiten = vector / np.sqrt(np.maximum(value, 1e-3))
    x = np.c_[kernel([*bad, *good], marks) @ whiten, np.ones(len(bad) + len(good))]
    y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
    cost = c * len(y) / 2 * np.r_[np.full(len(bad), 1 / len(bad)), np.full(len(good), 1 / len(good))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    beta = whiten @ w[:-1]
    code, weight, of = _codes(marks)
    table = np.zeros(2 * _OWN)
    np.add.at(table, code, weight / _norms(len(marks), weight, of)[of] * beta[of])
    return Machine(table.astype(np.float32), float(w[-1]))


def _calibrate(machine: Machine, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic regression by Newton steps over the evidence, with a small ridge."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z, w = np.c_[(x - centre) / scale, np.ones(len(y))], np.zeros(x.shape[1] + 1)
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, z.T @ (q - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    machine.range = x.min(0), x.max(0)
    slope = w[:-1] / scale
    machine.weights = np.r_[slope, w[-1] - slope @ centre]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the least hash of its runs of three words."""
    for b in batches:
        least = []
        for text in b[1]:
            words = text.as_py().lower().encode().split()
            runs = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
            least.append(min(xxhash.xxh64_intdigest(b" ".join(r)) for r in runs) >> 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "label", "sketch"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, is_run, in toxic, in clean) a batch; a run is of four or five symbols, counted once a document."""
    for b in batches:
        count: tuple[Counter, Counter] = Counter(), Counter()
        runs: tuple[Counter, Counter] = Counter(), Counter()
        for text, label in zip(b[1], b[2].to_pylist(), strict=True):
            words = {p for w in set(fragments(text.as_py())) if (p := plain(w))}
            count[label].update(words)
            runs[label].update({s[k : k + m] for w in words for s in (f"^{w}$",) for m in (4, 5) for k in range(len(s) - m + 1)})
        for kind, (clean, toxic) in ((False, count), (True, runs)):
            units = list(clean.keys() | toxic.keys())
            for k in range(0, len(units), 100_000):
                part = units[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([kind] * len(part), pa.bool_()), pa.array([toxic[u] for u in part], pa.int64()), pa.array([clean[u] for u in part], pa.int64())],
                    names=["unit", "is_run", "toxic", "clean"])


def _training_windows(marked: dict[str, int]):
    """(label, word, window, h): EACH windows of least hash of a toxic document and marked word, and of a clean document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, str, str, int]] = []
            for text, label in zip(b[1].to_pylist(), b[2].to_pylist(), strict=True):
                by: dict[str, set[str]] = {}
                for u in windows(text):
                    for w in (set(u.split(" ")) & marked.keys()) if label else ("",):
                        by.setdefault(w, set()).add(u)
                for w, found in by.items():
                    rows += sorted(((label, w, u, xxhash.xxh64_intdigest(u) >> 1) for u in found), key=lambda r: r[3:])[:EACH]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["label", "word", "window", "h"])

    return run


def _first(df: DataFrame, n: int, *order) -> list:
    """The first n rows by an order without ties; they are put together by a task, so the driver gets n rows at most."""
    return stash(df.orderBy(*order).limit(n)).orderBy(*order).collect()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Machine | None:
    """Train on at most `rows` labelled documents outside the held-out fold; None if nothing marks either class."""
    chosen = L.sample(labels, "toxic", FOLDS, FOLD, rows)
    texts = stash(L.labelled(docs, chosen, id_col, text_col))
    # Near copies would make their every word a mark: of documents with one sketch that with the smallest id counts.
    sketched = texts.mapInArrow(_sketches, "doc_id long, text string, label int, sketch long")
    distinct = stash(sketched.groupBy("label", "sketch").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "d.text", "label"))
    count = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    nt, nc = count.get(1, 0), count.get(0, 0)
    if not nt or not nc:
        return None
    units = distinct.mapInArrow(_units, "unit string, is_run boolean, toxic long, clean long").groupBy("unit", "is_run").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    base = math.log((nt + nc) / nt)
    # A run marks toxic documents if nearly all that hold it are toxic, and chance would hardly have it so.
    chance = F.col("toxic") * base - F.col("clean") * F.log1p(F.col("toxic") / (F.col("clean") + 1))
    marks = _first(units.where("is_run AND toxic >= 4 AND toxic >= 20 * clean").where(chance >= SURE), MARKS, F.desc(chance), "unit")
    words = units.where("NOT is_run")
    often = _first(words.where("toxic >= 4 AND toxic >= 8 * clean").where(chance >= SURE), MARKED, F.desc(chance), "unit")
    marked = {r["unit"]: r["toxic"] for r in often}
    if marks:
        any_mark = "|".join(re.escape(m["unit"].replace("^", "\1").replace("$", "\2")).replace("\1", "^").replace("\2", "$") for m in marks)
        more = _first(words.where("clean = 0 AND toxic > 0").where(F.col("unit").rlike(any_mark)), MARKED, F.desc("toxic"), "unit")
        marked |= {r["unit"]: r["toxic"] for r in more}
    units.unpersist()
    found = stash(distinct.mapInArrow(_training_windows(marked), "label int, word string, window string, h long").distinct())
    turn = F.row_number().over(Window.partitionBy("word").orderBy("h", "window"))
    # Each marked word in turn, so that the first windows, the landmarks, show them all.
    bad = list(dict.fromkeys(r["window"] for r in _first(found.where("label = 1").withColumn("turn", turn), POSITIVE, "turn", "word")))
    good = [r["window"] for r in _first(found.where("label = 0"), NEGATIVE, "h", "window")]
    good = [u for u in good if not marked.keys() & set(u.split(" "))]
    if not bad or not good:
        return None
    machine = train_machine(bad, good)
    for last in (False, True):  # clean documents of the sample show which of their windows still look bad
        scored = texts.mapInArrow(_worst(machine), "doc_id long, label int, x array<double>, window string").toArrow().sort_by([("doc_id", "ascending"), ("window", "ascending")])
        y, x = scored["label"].to_numpy(), np.array(scored["x"].to_pylist(), float).reshape(-1, 5)
        hard = Counter(u for u, v, t in zip(scored["window"].to_pylist(), x[:, 0], y, strict=True) if t == 0 and v > -0.5 and u)
        if not hard or last:
            break
        machine = train_machine(bad, list(dict.fromkeys([u for u, _ in hard.most_common(NEGATIVE)] + good)))
    _calibrate(machine, x, y)
    return machine


def _worst(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(machine)
        for b in batches:
            x, worst = score(b[1].to_pylist())
            yield pa.RecordBatch.from_arrays([b[0], b[2], pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(worst, pa.string())], names=["doc_id", "label", "x", "window"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null texts score as empty ones: as a document without a window; very long ones are read whole. Where training
    finds no toxic or no clean window every score is 0. Null ids and repeated rows are scored like others, ties and
    all: a score depends on the text and the training sample alone. No rows give none; columns other than id and text
    are not read, whatever their names.
    """
    with scope(docs.sparkSession):
        machine = train(docs, labels, id_col, text_col, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(machine) if machine else None
        for b in slices(batches):
            s = np.concatenate([machine.probability(score(b[1][k : k + 200].to_pylist())[0]) if machine else np.zeros(len(b[1][k : k + 200])) for k in range(0, b.num_rows, 200)] or [np.zeros(0)])
            held = [L.held_out(i, FOLDS, FOLD) for i in b[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

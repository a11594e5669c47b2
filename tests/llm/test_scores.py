"""Toxicity and quality against plain computations, on rows with nulls, repeats, very long texts and clashing names."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from brindle.llm import quality, toxicity

WORDS = [f"{a}{b}" for a in ("lor", "dem", "tin", "quas", "vel") for b in ("ent", "ium", "or", "amus", "it", "es")]
STEPS = [(1, 2, 1.0), (1, 3, 0.6), (2, 3, 0.6), (1, 4, 0.36), (2, 4, 0.36), (3, 4, 0.36)]


def features(unit):
    """Triples of three symbols that span at most five, in each word with its begin, with their weights."""
    out = []
    for word in unit.split(" "):
        s = "^" + word
        out += [(s[k], s[k + i], s[k + j], w) for i, j, w in STEPS for k in range(len(s) - j)]
    return out


def similarity(a, b):
    fa, fb = features(a), features(b)
    va, vb = Counter(), Counter()
    for v, f in ((va, fa), (vb, fb)):
        for *t, w in f:
            v[tuple(t)] += w
    norm = lambda f: math.sqrt(sum(w * w for *_, w in f)) + 1e-9
    return sum(va[t] * vb[t] for t in va) / norm(fa) / norm(fb)


def test_kernel_against_all_subsequences():
    r = random.Random(1)
    units = [" ".join("".join(r.choice("abcdexyz") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 3))) for _ in range(40)]
    k = toxicity.kernel(units, units[:15])
    assert np.allclose(k, [[similarity(a, b) for b in units[:15]] for a in units], atol=1e-4)


def test_margins_against_the_kernel_expansion(monkeypatch):
    r = random.Random(2)
    bad = [f"{r.choice(WORDS)} zorkwit" for _ in range(20)] + [f"grumpflot {r.choice(WORDS)}" for _ in range(20)]
    good = [f"{r.choice(WORDS)} {r.choice(WORDS)}" for _ in range(80)]
    machine = toxicity.train_machine(bad, good)
    text = "Lorent, tinium ZORK-wit! velit . z o r k w i t quases  deminum 123 ö東"
    score = toxicity.Scorer(machine)
    found, worst = score([text, None, "", "..", "velit"])
    units = toxicity.windows(text)
    code = lambda t: toxicity._codes([t])
    brute = []
    for u in units:
        c, w, _ = code(u)
        brute.append(float((machine.table[c] * w).sum() / math.sqrt((w * w).sum()) + machine.bias))
    top = sorted(brute)[::-1][:3]
    assert np.allclose(found[0], [*np.clip(top, -5, 5), math.log1p(sum(m > 0 for m in brute)), math.log1p(len(brute))], atol=1e-6)
    assert worst[0] == units[int(np.argmax(brute))] and "zork" in worst[0]
    least = [max(-5, machine.bias)] * 3 + [0, 0]
    assert np.allclose(found[1:4], [least] * 3) and worst[1:4] == ["", "", ""] and worst[4] == "velit"
    assert max(brute) > 0 > min(brute)


def tables(spark, parts=3):
    r = random.Random(5)
    say = lambda n: [r.choice(WORDS) for _ in range(n)]
    data = []
    for k in range(240):
        w = say(r.randint(12, 40))
        if k % 3 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["zorkwit", "zork.wit", "zoorkwit", "grumpflot", "gr-umpflot"]))
        data.append((k, " ".join(w), int(k % 3 == 0)))
    extra = [(None, data[0][1]), (None, None), (9000, None), (9001, ""), (9002, " ".join(say(60_000))), (9003, data[3][1]), (9003, data[3][1]), (4, data[3][1])]
    docs = spark.createDataFrame([(i, t, 1.0, 1, True) for i, t, _ in data] + [(i, t, None, None, None) for i, t in extra], "doc_id long, text string, score double, label int, held_out boolean").repartition(parts)
    labels = spark.createDataFrame([(i, y, y, "x") for i, _, y in data] + [(i, y, y, "y") for i, _, y in data[:9]] + [(None, 1, 1, "z"), (9001, None, None, None), (8, 5, 5, None)], "doc_id long, toxic int, quality int, text string")
    return docs, labels, data


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_edges_and_reproducible_scores(spark, score):
    runs = []
    for parts in (3, 7):
        docs, labels, data = tables(spark, parts)
        rows = score(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        runs.append(sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9), r.held_out) for r in rows))
    assert [x[:2] + x[3:] for x in runs[0]] == [x[:2] + x[3:] for x in runs[1]]
    assert np.allclose([x[2] for x in runs[0]], [x[2] for x in runs[1]], atol=1e-6)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[9003][0] == by[9003][1] and by[3][0] == by[9003][0] and sorted(by[4])[0] != sorted(by[4])[1]
    assert by[9000] == by[9001]
    if score is toxicity.toxicity_scores:
        assert sum((by[i][0] >= 0.5) == bool(y) for i, _, y in data) > 0.97 * len(data) and by[9002][0] < 0.5
    assert score(docs.limit(0), labels).count() == 0 and len({r.score for r in score(docs, labels.limit(0)).collect()}) == 1


def test_discriminant_against_densities():
    r = np.random.default_rng(3)
    x = np.r_[r.normal(0, 1, (60, 12)), r.normal(1, 2, (40, 12))]
    y = np.r_[np.zeros(60, int), np.ones(40, int)]
    model = quality.fit(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -12, 12)
    parts = [z[y == k] for k in (0, 1)]
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = (60 * own[0] + 40 * own[1]) / 100
    logs = []
    for p, c in zip(parts, own):
        a = max(0.1, 12 / (12 + len(p)))
        c = (1 - a) * c + a * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / 12 * np.eye(12)
        d = z - p.mean(0)
        logs.append(math.log(len(p) / 100) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)
    assert quality.fit(x[:60], y[:60]) is None and quality.fit(x[:0], y[:0]) is None


def test_statistics_by_counting():
    text = "Ab c, d! 12|x\nAb c, d! 12|x\n\nend."
    b = text.encode()
    words, m = b.split(), len(b)
    rate = lambda x, of: math.log((x + 0.5) / (of + 10))
    s = quality.statistics(text)
    assert np.allclose([s[0], s[2], s[3], s[4], s[6], s[7]], [math.log1p(len(words)), rate(2, m), rate(4, m), rate(2, len(words)), rate(1, len(words)), rate(2, len(words))])
    assert quality.statistics(None) == quality.statistics("") and len(quality.statistics("x")) == len(s)

"""Line dedup against an alignment of all pairs, written anew."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from brindle.llm import line_dedup


def longest(a, b):
    """One of the longest common subsequences, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def patience(a, b, i=0, j=0):
    """Recursive patience diff: ends, then the longest increasing run of unique common lines."""
    out = []
    while a and b and a[0] == b[0]:
        out.append((i, j))
        a, b, i, j = a[1:], b[1:], i + 1, j + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
        out.append((i + len(a), j + len(b)))
    ca, cb = Counter(a), Counter(b)
    unique = [(k, b.index(x)) for k, x in enumerate(a) if ca[x] == 1 and cb[x] == 1]
    if not unique:
        if set(a) & set(b):
            out += [(i + x, j + y) for x, y in line_dedup.lcs(a, b)]
        return sorted(out)
    chains = []
    for k, y in unique:
        before = [c for c in chains if c[-1][1] < y]
        chains.append(max(before, key=len, default=[]) + [(k, y)])
    size = max(map(len, chains))
    p = q = 0
    for x, y in [c for c in chains if len(c) == size][0] + [(len(a), len(b))]:
        out += patience(a[p:x], b[q:y], i + p, j + q)
        if x < len(a):
            out.append((i + x, j + y))
        p, q = x + 1, y + 1
    return sorted(out)


def brute(items, rare, align):
    """Of each row (id, text): lines, lines removed, digest of what is left."""
    split = [None if t is None else [x.strip(" \t\n\r\x0b\x0c") for x in t.split("\n")] for _, t in items]
    holders = defaultdict(list)
    for k, w in enumerate(split):
        if w is not None and items[k][0] is not None:
            for x in set(w) - {""}:
                holders[x].append(k)
    gone = defaultdict(set)
    for x, ks in holders.items():
        if len(ks) > rare:
            for k in ks:
                if items[k][0] > min(items[o][0] for o in ks):
                    gone[k] |= {p for p, y in enumerate(split[k]) if y == x}
    few = {x for x, ks in holders.items() if 1 < len(ks) <= rare}
    for k, w in enumerate(split):
        for o, v in enumerate(split):
            if w is None or v is None or None in (items[k][0], items[o][0]) or items[o][0] >= items[k][0]:
                continue
            both = few & set(w) & set(v)
            if both:
                p, q = [n for n, x in enumerate(w) if x in both], [n for n, x in enumerate(v) if x in both]
                gone[k] |= {p[x] for x, _ in align([w[n] for n in p], [v[n] for n in q])}
    out = []
    for k, (i, t) in enumerate(items):
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) if t is not None else ""
        out.append((i, 0 if t is None else len(split[k]), len(gone[k]), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, items, rare):
    docs = spark.createDataFrame([(i, t, k, [k]) for k, (i, t) in enumerate(items)], "doc_id long, text string, gone int, at array<int>").repartition(3)
    return sorted((tuple(r) for r in line_dedup.line_dedup(docs, rare=rare).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    lines = [f"line {k}" for k in range(34)]
    items = [(k, "\n".join(r.choice(["", " \t", "\r", *lines[k % 9 * 3 : k % 9 * 3 + 7], *lines[:2]]) + r.choice(["", "\r", " "]) for _ in range(r.randint(0, 14)))) for k in range(36)]
    items += [(None, items[3][1]), (4, items[4][1]), (4, items[5][1]), (40, None), (41, ""), (42, "\n" * 3)]
    ties = []

    def align(a, b):
        """Both ways; patience may choose among longest chains, so only equal lengths are asked for there."""
        mine, own = patience(a, b), line_dedup.patience(a, b)
        ties.append((len(mine), len(own), mine == own))
        assert all(a[x] == b[y] for x, y in own) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(own, own[1:]))
        return own

    assert run(spark, items, 5) == brute(items, 5, align)
    assert sum(same for *_, same in ties) > 0.8 * len(ties) and len(ties) > 60


def test_lines_of_crlf_texts_and_further_holders(spark):
    items = [(1, "a\r\n\r\nb\r\n"), (2, "c three\r\n\r\nd four"), (3, "y\nx"), (4, "x\ny"), (5, "x\ny"), (6, "\t\nq\n\t"), (7, "q2\n\t\nq")]
    got = {i: (n, g) for i, n, g, _ in run(spark, items, 16)}
    assert got == {1: (4, 0), 2: (3, 0), 3: (2, 0), 4: (2, 1), 5: (2, 2), 6: (3, 0), 7: (3, 1)}


def test_common_lines_stay_with_their_smallest_holder(spark):
    items = [(k, f"own {k}\ncommon\nown too {k}\ncommon") for k in range(40)]
    got = {i: g for i, _, g, _ in run(spark, items, 16)}
    assert got == {k: 2 if k else 0 for k in range(40)}


def test_a_very_long_text(spark):
    long = "\n".join(f"line {k}" for k in range(30_000))
    got = run(spark, [(1, long), (2, "x\n" + long), (3, None)], 16)
    assert [(i, n, g) for i, n, g, _ in got] == [(1, 30_000, 0), (2, 30_001, 30_000), (3, 0, 0)]


def test_lcs_is_longest():
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.randrange(1, 5) for _ in range(r.randrange(14))] for _ in range(2))
        p = line_dedup.lcs(a, b)
        assert len(p) == longest(a, b) and all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))

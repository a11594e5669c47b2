"""Whole results where the operators once did less: stages and operators against brute force."""

import random
import re

from pyspark.sql import functions as F

from brindle.llm import decontaminate, licenses, line_dedup, simhash

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 7))) for _ in range(60)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_one(items, least=0.8):
    """Row numbers that stay: one of each component, that with the smallest id, null last."""
    sets = [shingle_set(t) for _, t in items]
    root = list(range(len(items)))
    near = lambda a, b: a == b or len(a & b) >= least * len(a | b)
    links = [[b for b in root if near(sets[a], sets[b])] for a in root]
    for _ in items:
        root = [min(root[b] for b in links[a]) for a in range(len(items))]
    best = {}
    for k, (i, _) in enumerate(items):
        key = (i is None, i or 0)
        if root[k] not in best or key < best[root[k]][0]:
            best[root[k]] = (key, k)
    return sorted(k for _, k in best.values())


def near_texts(r):
    texts = []
    for _ in range(12):
        base = prose(r.randint(4, 160), r).split()
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            texts.append(" ".join(w))
    line = prose(12, r)
    texts += [f"{line} {prose(r.randint(2, 60), r)}" for _ in range(40)] + [None, "", "  \n", "Ab c", "aB  C"]
    r.shuffle(texts)
    return texts


def test_keep_one_against_brute_force(spark):
    texts = near_texts(random.Random(11))
    items = [(None if k % 17 == 3 else k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(items)], "doc_id long, text string, n int").repartition(3)
    want = kept_one(items)
    # Of rows without an id the one with the smallest text hash stays, so only their number is compared.
    got = sorted(r.n for r in simhash.keep_one(docs).collect())
    assert [n for n in got if items[n][0] is not None] == [n for n in want if items[n][0] is not None] and len(got) == len(want)
    assert len(want) < len(items) - 10 and simhash.keep_one(docs.limit(0)).count() == 0


def test_decontamination_in_any_case(spark):
    item = "A train leaves Boston at 40 km per hour and another leaves Denver at 60 km per hour; when do they meet?"
    title = "Der Alte Mann Und Das Meer Von Ernest Hemingway 1952"
    bench = spark.createDataFrame([(1, item), (2, title), (3, "Zwölf Meilen weit"), (4, None), (5, " ...")], "item_id long, text string")
    texts = [f"{prose(20)} {item.upper()} {prose(9)}", item.lower(), item.title(), f"{prose(9)} {title}", title.lower(), "so ZWÖLF MEILEN WEIT weg", "zwölf weit meilen", prose(60), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.containment, r.same_values) for r in decontaminate.benchmark_leaks(docs, bench).collect()}
    assert got == {k: (1.0, True) for k in [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [6, 7, 8]


def test_line_dedup_with_further_holders(spark):
    texts = ["a\nb\nc", "c\na\nx", "d\na\nb\na\nb", "b\nc\na\nown\na\nb", "p\ns\ns\nq", "r\ns\ns\nt", "x\nd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(docs, with_text=True).collect()}
    assert got[3] == "own" and got[5] == "r\nt" and got[6] == "" and got[0] == texts[0] and got[4] == texts[4]


def test_patience_without_unique_lines():
    assert line_dedup.patience([1, 5, 5, 2], [3, 5, 5, 4]) == [(1, 1), (2, 2)]
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.randrange(1, 5) for _ in range(r.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        p = line_dedup.lcs(a, b)
        assert len(p) == best[-1][-1] and all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))


def test_licenses_exactly(spark):
    text = [("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("Licensed under the GNU Lesser General Public License, version 3.", "lgpl-3"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
            ("Released under the BSD License.", ""), ("Licensed under CC BY 4.0.", ""), ("Released under the MIT License.", "mit"), (f"licensed {prose(40)} under the {prose(40)} gnu general public license version 3", ""),
            ("x\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction,\nincluding", "mit")]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(text)] + [(99, "🙂🙂🙂🙂🙂🙂 x under the mit license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert [got[k].labels for k in range(len(text))] == [label for _, label in text]
    assert got[99].first_word == 1 + len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "🙂🙂🙂🙂🙂🙂"))


def test_near_dedup_by_simhash_tries(spark, monkeypatch):
    """The stage's candidates come from SimHashes in tries: each pair in budget, and all that are in budget hang together."""
    r = random.Random(21)
    flip = lambda x, n: x ^ sum(1 << k for k in r.sample(range(64), n))
    sims = [flip(x, r.randint(0, 9)) for x in [r.getrandbits(64) for _ in range(8)] for _ in range(25)]
    sims += sims[:5]  # sets of one SimHash
    sets = spark.createDataFrame([(k, x - (x >> 63 << 64)) for k, x in enumerate(sims)], "fp long, sim long").repartition(3)
    monkeypatch.setattr(simhash, "WALK", 50)
    found = [(x.u, x.v) for x in simhash.near_pairs(sets).collect()]
    assert found and all(u < v and (sims[u] ^ sims[v]).bit_count() <= 7 for u, v in found)

    def classes(links):
        root = list(range(len(sims)))
        for _ in sims:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    near = [(a, b) for a in range(len(sims)) for b in range(a) if (sims[a] ^ sims[b]).bit_count() <= 7]
    assert classes(found) == classes(near) and simhash.near_pairs(sets.limit(0)).count() == 0

    asked = []
    monkeypatch.setattr(simhash, "near_pairs", lambda sets: asked.append(sets) or sets.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0))
    base = prose(80, r)
    docs = spark.createDataFrame([(1, base), (2, base + " end"), (3, prose(80, r))], "doc_id long, text string")
    # Without any candidate from the tries the join by prefixes still links what is similar.
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == [1, 3] and asked[0].columns == ["fp", "sim"]


def test_stages_give_heap_back(spark):
    """The heap that garbage grew before a stage isn't held while the stage's Python workers want memory."""
    import gc

    import corpus_pipeline

    jvm, docs = spark.sparkContext._jvm, spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    held = [spark.sparkContext._gateway.new_array(jvm.long, 40_000_000) for _ in range(4)]
    before = jvm.java.lang.Runtime.getRuntime().totalMemory()
    assert before > 1_200_000_000
    del held
    gc.collect()
    assert [x.n_tokens for x in corpus_pipeline.encode(spark, docs, "").collect()] == [3]
    assert jvm.java.lang.Runtime.getRuntime().totalMemory() < before - 500_000_000

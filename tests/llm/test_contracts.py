"""Decontamination, token counts and the pipeline against plain computations; the pipeline on dirty and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import decontaminate, queries, simhash, token_counts
from brindle.session import shared_dir

WORDS = ["red", "train", "km", "Paris", "Rome", "apples", "has", "gives", "each", "seven", "a", "box", "hour", "and", "how", "many"]


def template(words):
    out = []
    for k, w in enumerate(words):
        if re.match(r"\d", w):
            out.append("0")
        elif w[0].isupper():
            out.append("N")
        elif k and w in decontaminate.UNITS and re.match(r"\d", words[k - 1]):
            out.append("U")
        else:
            out.append(w)
    return out


def brute_leaks(docs, bench, share=0.8):
    out = {}
    split = lambda t: re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", t or "")
    for i, text in docs:
        d = split(text)
        dt, low = template(d), [w.lower() for w in d]
        for j, item in bench:
            w = split(item)
            if not w:
                continue
            width = min(5, len(w))
            own = [tuple(x.lower() for x in w[k : k + width]) for k in range(len(w) - width + 1)]
            have = {tuple(low[k : k + width]) for k in range(len(low) - width + 1)}
            found = sum(x in have for x in own) / len(own)
            best = (found, found == 1) if found >= share else None
            wt = template(w)
            at = [k for k in range(len(wt) - 4) if sum(x not in ("0", "N", "U") for x in wt[k : k + 5]) >= 3]
            hits = [(k, p) for k in at for p in range(len(dt) - 4) if dt[p : p + 5] == wt[k : k + 5]]
            if at and len({k for k, _ in hits}) >= share * len(at):
                good, same = set(), False
                for off in {p - k for k, p in hits}:
                    mine = [(k, p) for k, p in hits if p - k == off]
                    slots = {(wt[k + x], w[k + x], d[p + x]) for k, p in mine for x in range(5) if wt[k + x] in ("0", "N", "U")}
                    if len(slots) == len({s[:2] for s in slots}):
                        good |= {k for k, _ in mine}
                        same |= all(a == b for _, a, b in slots)
                if good and len(good) / len(at) >= share:
                    best = max(best or (0, False), (len(good) / len(at), same)) if not best else (max(best[0], len(good) / len(at)), best[1] or same)
            if best:
                key = (i, j)
                out[key] = (max(out[key][0], best[0]), out[key][1] or best[1]) if key in out else best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_against_brute_force(spark, seed):
    r = random.Random(seed)
    say = lambda n: [r.choice([*WORDS, str(r.randint(1, 30))]) for _ in range(n)]
    bench = [(k, " ".join(say(r.choice([2, 4, 6, 9, 14])))) for k in range(14)] + [(14, None), (15, "..."), (3, " ".join(say(8)))]
    docs = []
    for k in range(60):
        w = say(r.randint(0, 12))
        for _ in range(r.randint(0, 2)):
            item = (r.choice(bench)[1] or "").split()
            for x in range(len(item)):
                if r.random() < 0.1:
                    item[x] = r.choice([str(r.randint(1, 30)), "Oslo", item[x].upper()])
            w += item + say(r.randint(0, 4))
        docs.append((k % 50, " ".join(w)))
    docs += [(None, bench[5][1]), (None, None), (70, ""), (71, " ".join(say(20_000)) + " " + bench[4][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, h string").repartition(3)
    b = spark.createDataFrame([(i, t, 5) for i, t in bench], "item_id long, text string, doc_id int")
    # Repeated item ids are one item of the windows of both texts, so only single ones are compared.
    got = {(x.doc_id, x.item_id): (round(x.containment, 9), x.same_values) for x in decontaminate.benchmark_leaks(df, b).collect() if x.item_id != 3}
    want = {k: (round(v[0], 9), v[1]) for k, v in brute_leaks(docs, [x for x in bench if x[0] != 3]).items()}
    assert got == want and len(want) > 20


def test_token_count_scores_against_dynamic_programming(spark):
    path = queries.tokenizer(queries.BYTE_RANKS)
    vocabulary = token_counts.zipf(path)
    r = random.Random(5)
    texts = [None, "", "   ", "naïve 東京 🙂🙂", "a" * 300, " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12))) for _ in range(20_000))] + [" ".join("".join(r.choice("etaoin'S 7.é") for _ in range(9)) for _ in range(5)) for _ in range(40)]
    df = spark.createDataFrame([(k if k % 9 else None, t, 1.0) for k, t in enumerate([*texts, texts[3], texts[3]])], "doc_id long, text string, score double").repartition(3)
    got = sorted(((x.doc_id, x.n_pretokens, x.n_tokens, round(x.score, 6)) for x in token_counts.token_counts(df, path).collect()), key=repr)
    known, want = {}, []
    for i, text in ((x.doc_id, x.text) for x in df.collect()):
        found = token_counts._SPLIT(text or "")
        for w in found:
            if w not in known:
                raw, best = w.encode(), [(0.0, 0)]
                for end in range(1, len(raw) + 1):
                    best.append(max((best[a][0] + vocabulary[raw[a:end]], best[a][1] - 1) for a in range(end) if raw[a:end] in vocabulary))
                known[w] = (best[-1][0], -best[-1][1])
        want.append((i, len(found), sum(known[w][1] for w in found), round(sum(known[w][0] for w in found), 6)))
    want = sorted(want, key=repr)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-9)


def dirty(r):
    """Good prose with exact and near copies, leaks, repeats, ids that are null or shared, and junk."""
    say = lambda n: ". ".join(" ".join(r.choice(["model", "river", "stone", "light", "small", "under", "never", "garden", "window", "paper"]) + r.choice("abcdefgh") for _ in range(9)).capitalize() for _ in range(n)) + "."
    base = [say(r.randint(5, 12)) for _ in range(60)]
    items = [" ".join(say(3).split()[:14]) for _ in range(4)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k].replace(" ", "  ")) for k in range(0, 30, 2)]
    rows += [(200 + k, " ".join([*base[k].split()[:-1], "otherword."])) for k in range(1, 30, 2)]
    rows += [(300 + k, f"{say(4)} {items[k % 4]} {say(3)}") for k in range(8)]
    rows += [(None, base[5]), (None, say(6)), (None, f"{say(3)} {items[0]} {say(3)}"), (7, say(7)), (7, base[8]), (8, base[8]), (400, say(900))]
    junk = [(500 + k, "BUY!!! $$$ " * (4 + k % 15)) for k in range(60)]
    return rows, junk, items


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, labels, items):
        at = str(tmp_path / "in")
        spark.createDataFrame([(i, t, "en", f"s{k}", k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, gone int").repartition(3).write.mode("overwrite").parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
        return at

    return write


def test_pipeline_against_brute_force(spark, folder):
    from tests.llm.test_whole import kept_one

    rows, junk, items = dirty(random.Random(4))
    labels = [(i, 1, 0) for i, _ in rows if i is not None and i < 60] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (3, None, None)]
    at = folder([*rows, *junk, (600, None), (601, "")], labels, items)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    now, steps = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, at).cache()
        assert now.columns == docs.columns
        steps.append(sorted((x.n_chars, x.doc_id, x.text) for x in now.collect()))
    assert {x[0] for x in steps[0]} >= set(range(len(rows))) and not {x[0] for x in steps[0]} & set(range(len(rows), len(rows) + len(junk)))
    key = lambda i: (i is None, i or 0)
    kept = {}
    for n, i, t in steps[0]:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if norm not in kept or key(i) < key(kept[norm][1]):
            kept[norm] = (n, i)
    assert [x[0] for x in steps[1]] == sorted(n for n, _ in kept.values())
    assert [x[0] for x in steps[2]] == [steps[1][k][0] for k in kept_one([(i, t) for _, i, t in steps[1]])] and len(steps[2]) < len(steps[1])
    leaks = brute_leaks([(n, t) for n, _, t in steps[2]], list(enumerate(items)))
    assert [x[0] for x in steps[3]] == [n for n, _, _ in steps[2] if n not in {a for a, _ in leaks}] and len(steps[3]) < len(steps[2])

    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer())
    coder.no_truncation()
    coder.no_padding()
    want = sorted(((i, hashlib.sha256(np.array(coder.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for _, i, t in steps[3]), key=repr)
    assert sorted(((x.doc_id, x.ids_sha256) for x in corpus_pipeline.run(spark, at).collect()), key=repr) == want


def test_pipeline_on_empty_tables(spark, folder):
    rows, junk, items = dirty(random.Random(6))
    assert corpus_pipeline.run(spark, folder([], [], [])).count() == 0
    assert corpus_pipeline.run(spark, folder([], [(1, 1, 0)], items)).count() == 0
    some = [(1, "one text of its own"), (2, None), (None, None)]
    got = corpus_pipeline.run(spark, folder(some, [], []))  # no labels: every document is good enough
    assert sorted(x.doc_id for x in got.select("doc_id").collect()) == [1, 2]


def test_what_a_run_leaves_in_the_shared_folder(spark, folder):
    import os

    rows, junk, items = dirty(random.Random(8))
    at = folder([*rows, *junk], [(i, 1, 0) for i, _ in rows if i is not None and i < 60] + [(i, 0, 0) for i, _ in junk], items)
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    corpus_pipeline.run(spark, at).count()
    assert len(set(os.listdir(shared)) - before) <= 1


def test_trie_walk_and_links_of_hot_fingerprints(spark):
    """A third of the rows have one fingerprint; classes are those of a plain walk."""
    r = random.Random(9)
    say = lambda: " ".join(r.choice(["oak", "elm", "fir", "ash", "yew", "bay"]) + str(r.randint(0, 40)) for _ in range(30))
    texts = [None if k % 3 == 0 else say() for k in range(300)]
    texts += [t + " more" for t in texts[1:60:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(5):
        for a in range(len(texts)):
            root[a] = min(root[b] for b in range(len(texts)) if (fps[a] ^ fps[b]).bit_count() <= 4)
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.near_duplicates(df).collect()}
    assert got == {k: (fps[k], root[k]) for k in range(len(texts))}
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0

"""The ten operators against brute force, on small tables with nulls, repeats, ties, empty and long texts."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, exact_dedup, licenses, line_dedup, quality, queries, simhash, substring_dedup, token_counts, toxicity

R = random.Random(3)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 7))) for _ in range(60)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


BASE = prose(300)
TEXTS = [
    None, "", " \t\n ", "a", BASE, BASE, BASE.replace(" ", "  ", 3), prose(20) + " " + " ".join(BASE.split()[40:130]) + " " + prose(15), " ".join(BASE.split()[80:140]), prose(5000), "Ünï çødé 東京 🙂 x y",
    "<|endoftext|> it's\r\n\r\n  12345 don't!!", BASE + " tail", "A b C d", "a  B c D",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None), (3, "a", "x", "y", 0), (3, "other words", "x", "y", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id string, fp int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    t.no_truncation()
    t.no_padding()
    want = []
    for i, text in pairs(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert rows(bpe.bpe_encode(docs, queries.tokenizer(), with_ids=False), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, queries.tokenizer()), queries.tokenizer())
    assert rows(back, "doc_id", "text") == sorted([(i, x or "") for i, x in pairs(docs)], key=repr)
    assert bpe.bpe_encode(empty, queries.tokenizer()).count() == 0


def test_bpe_on_random_words():
    from tokenizers import Tokenizer

    t, coder = Tokenizer.from_file(queries.tokenizer()), bpe.load(queries.tokenizer())
    r = random.Random(8)
    for _ in range(400):
        text = "".join(r.choice("aeinorst THE ing0129.,'\n éß東🙂_-") for _ in range(r.randint(0, 60)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def brute_windows(items, size=50):
    first = {}
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in items}
    for (i, _), w in split.items():
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for (i, k0), w in split.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, k0)] = (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return list(out.values())


def test_substring_dedup(docs, empty):
    known = docs.where("doc_id IS NOT NULL")
    want = brute_windows([((i, k), t) for k, (i, t) in enumerate(pairs(known))])
    assert rows(substring_dedup.substring_dedup(known), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(docs).where("doc_id IS NULL AND n_removed = 0").count() == 1
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("seed, bits", [(0, 64), (1, 64), (2, 64), (3, 5), (4, 3)])
def test_substring_dedup_with_branches(spark, seed, bits):
    """With few bits hashes of word runs collide, and paths fail their verification."""
    r = random.Random(seed)
    parts = [prose(r.randint(30, 90), r) for _ in range(8)] + ["x " * 120]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(40)]
    want = brute_windows([((i, 0), t) for i, t in enumerate(texts)])
    got = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bits=bits)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_substring_dedup_of_passages_about_a_window_long(spark):
    """Passages of 40 to 60 words between words of each document's own, so most shared runs are too short."""
    r = random.Random(21)
    parts = [prose(r.randint(40, 60), r) for _ in range(30)]
    own = lambda i, k: " ".join(f"{r.choice(VOCAB)}{i}x{k}" for _ in range(r.randint(3, 30)))
    texts = [" ".join(f"{own(i, k)} {r.choice(parts)}" for k in range(12)) + " " + own(i, 99) for i in range(60)]
    want = brute_windows([((i, 0), t) for i, t in enumerate(texts)])
    got = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_substring_dedup_where_a_window_at_a_branch_is_met_by_another_edge(spark):
    """A passage goes on, or begins, in one document otherwise than in two that share a longer run; the window at its edge is the first one's too."""
    r = random.Random(5)
    own = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]

    def vertices(words):
        _, anchor, places = substring_dedup._anchors(substring_dedup._word_hashes([w.encode() for w in words]), 64)
        return anchor, places.tolist()

    texts, kinds = [], set()
    while len(texts) < 18 or kinds != {True, False}:
        part, last = own(60), r.random() < 0.5
        one, more = (part + own(60), part + own(60)) if last else (own(60) + part, own(60) + part)
        at = 10 if last else 60  # the shared window at the passage's edge, and its anchor where that is the edge's vertex
        edge = 10 if last else 84
        met = [vertices(x) for x in (one, more)]
        beside = [p[p.index(edge) + (1 if last else -1)] if a[at] == edge and 0 < p.index(edge) < len(p) - 1 else None for a, p in met]
        if None not in beside and beside[0] != beside[1]:
            kinds.add(last)
            texts += [" ".join(x) for x in (one, own(3) + more + own(3), own(3) + more + own(3))]
    want = brute_windows([((i, 0), t) for i, t in enumerate(texts)])
    got = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_exact_dedup(docs, empty):
    items = pairs(docs)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in items]
    want = []
    for (i, _), n in zip(items, norm):
        ids = [j for (j, _), m in zip(items, norm) if m == n]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_first(docs).columns == docs.columns


def test_cuckoo_index():
    index, held, r = exact_dedup.CuckooIndex(4), {}, random.Random(1)
    keys = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(3000)]
    for _ in range(12_000):
        k = r.choice(keys)
        if r.random() < 0.6:
            assert index.put(k, _) == (k not in held)
            held[k] = _
        else:
            assert index.delete(k) == (held.pop(k, None) is not None)
    assert all(index.get(k) == held.get(k) for k in keys) and index.size == len(held) and dict(index.items()) == held


def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(docs, empty, spark):
    items = [(i, t) for i, t in pairs(docs) if i is not None and i != 3] + [(100 + k, " ".join(BASE.split()[:k] + BASE.split()[k + 1 :])) for k in range(8)]
    fps = [simhash_of(t) for _, t in items]
    root = [i for i, _ in items]
    for _ in items:
        for a in range(len(items)):
            root[a] = min(root[b] for b in range(len(items)) if (fps[a] ^ fps[b]).bit_count() <= 4)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(items, fps, root)), key=repr)
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert rows(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(docs).count() == docs.count()
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(root))


def test_trie_links():
    r = np.random.default_rng(2)
    fps = np.unique(np.concatenate([r.integers(0, 2**64, 150, np.uint64), np.uint64(7) ^ (np.uint64(1) << r.integers(0, 64, 60, np.uint64))]))
    got = {(min(a, b), max(a, b)) for i, j in simhash.trie_links(np.zeros(len(fps), np.uint64), fps, 4) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    assert got == want and want


ITEM = "A train leaves Boston at 40 km per hour and another leaves Denver at 60 km per hour; when do they meet after driving toward each other all day long?"


def test_decontamination(spark):
    other = ITEM.replace("Boston", "Paris").replace("Denver", "Lyon").replace("40", "55").replace("60", "75")
    mixed = ITEM.replace("and another leaves Denver at 60 km", "and another leaves Boston at 60 km")
    texts = [prose(30) + " " + ITEM + " " + prose(9), prose(10) + " " + other, prose(200), None, "", ITEM[:40], other + " " + other, prose(5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, ITEM, "x", 1)], "doc_id long, text string, item_id string, n int")
    bench = spark.createDataFrame([(1, ITEM), (2, "what is it"), (3, None), (4, prose(40, random.Random(77)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.same_values for r in decontaminate.benchmark_leaks(docs, bench).collect()}
    assert got == {(0, 1): True, (1, 1): False, (6, 1): False, (None, 1): True}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs.where("doc_id IS NOT NULL"), bench).collect()) == [2, 3, 4, 5, 7] and decontaminate.benchmark_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.benchmark_leaks(docs, bench.limit(0)).count() == 0
    assert mixed != ITEM


def test_line_dedup(spark):
    shared = [f"shared line number {k}" for k in range(6)]
    texts = ["\n".join(["own a", *shared, "own b"]), "\n".join(["own c", *shared[:3], "own d", *shared[3:], ""]), "solo\n\n\nsolo", None, "", shared[2], "\n".join(shared[::-1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, shared[0], 1)], "doc_id long, text string, gone int")
    got = {(r.doc_id, r.n_lines): (r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs, with_text=True).collect()}
    assert got[(0, 8)] == (0, texts[0]) and got[(1, 9)] == (6, "own c\nown d\n") and got[(2, 4)] == (0, texts[2]) and got[(3, 0)] == (0, "") and got[(4, 1)] == (0, "") and got[(5, 1)] == (1, "") and got[(None, 1)] == (0, shared[0])
    assert got[(6, 6)][0] >= 1 and line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_patience():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(15))] for _ in range(2))
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert line_dedup.patience([1, 2, 3], [1, 9, 2, 3]) == [(0, 0), (1, 2), (2, 3)]


def test_licenses(spark):
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    texts = ["Released Under the MIT-License. under THE mit license!", "Apache License, Version 2.0; CC BY NC", "under the mité license", None, "", prose(3000) + " cc-by-nc 4.0", "é" * 50 + " apache license version 2", "licensed under the gnu general public license, version 3",
             "apache license version 20", "Redistribution and use in source and binary forms with or without modification are permitted provided the following conditions are met"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(None, texts[0], "q")], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, n) for n, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        want = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({n for _, n in at})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, i
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert "gpl-3" in got[7].labels and "bsd-3" in got[9].labels and licenses.license_scan(docs.limit(0)).count() == 0


def test_token_counts(docs, empty):
    path = queries.tokenizer(queries.BYTE_RANKS)
    vocabulary = token_counts.zipf(path)
    want = []
    for i, text in pairs(docs):
        n = k = 0
        for w in token_counts._SPLIT(text or ""):
            raw, best = w.encode(), [(0.0, 0)]
            for end in range(1, len(raw) + 1):
                best.append(max(((best[a][0] + vocabulary[raw[a:end]], -(best[a][1] + 1)) for a in range(end) if raw[a:end] in vocabulary), default=(-1e99, 0)))
                best[-1] = (best[-1][0], -best[-1][1])
            n, k = n + best[-1][1], k + 1
        want.append((i, k, n))
    assert rows(token_counts.token_counts(docs, path), "doc_id", "n_pretokens", "n_tokens") == sorted(want, key=repr)
    assert token_counts.token_counts(empty, path).count() == 0


def labelled(spark, good, bad, n=240):
    r = random.Random(12)
    data = [(i, good(r) if i % 2 else bad(r), i % 2) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(9001, None, "x"), (9002, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in data] + [(None, 1, 0), (9003, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = labelled(spark, lambda r: ". ".join(prose(r.randint(8, 15), r).capitalize() for _ in range(r.randint(3, 9))) + ".", lambda r: " ".join(r.choice(["BUY!!!", "$$$", "win | now", "99"]) for _ in range(r.randint(5, 60))))
    out = quality.quality_scores(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.predicted == r.quality for r in out if r.held_out and r.quality is not None)
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, labels.limit(0)).collect()) and quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_toxicity(spark):
    insult = lambda r: r.choice(["zorkwit", "grumpflot", "zorkwits", "grumpflots"])
    mangle = lambda w, r: r.choice([w, w, w, " ".join(w), w[:3] + "-" + w[3:], w[:4] + w[3] + w[4:]])

    def bad(r):
        words = prose(r.randint(10, 40), r).split()
        for _ in range(3):
            words.insert(r.randrange(len(words)), mangle(insult(r), r))
        return " ".join(words)

    docs, labels = labelled(spark, lambda r: prose(r.randint(10, 40), r), bad, 300)
    out = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in out if r.held_out and r.toxic is not None]
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score <> 0").count() == 0 and toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_kernel_tolerates_gaps():
    k = toxicity.kernel(["worthless", "worthles", "wor_thless".replace("_", "x"), "wxoxrxtxh", "banana"], ["worthless"])[:, 0]
    assert 1 <= k[0] < 1.3 and k[1] > 0.7 and k[2] > 0.6 and k[4] < 0.2


def test_pipeline(spark):
    import corpus_pipeline as p

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "bpe encoding"]
    now, held = docs, {r.doc_id for r in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, at).cache()
        after = [r.doc_id for r in now.collect()]
        assert now.columns == docs.columns and set(after) <= held and len(after) == len(set(after))
        held = set(after)
    assert {r.doc_id for r in p.run(spark, at).select("doc_id").collect()} == held and len(held) > 100
    assert docs.where(F.col("doc_id").isin(list(held))).count() == len(held)

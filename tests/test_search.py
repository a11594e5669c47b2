import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import analyzer, types
from brindle.functions.analyzer import Params, stem, tokenize
from brindle.functions.udf import batch_udf
from brindle.operators import fts, sample, shard, vector
from brindle.operators.graph import connected_components
from brindle.operators.scan import Scan
from brindle.sources import ingest
from brindle.sources.catalog import Catalog, connect, literal
from brindle.sources.table import Table
from brindle.streaming import adapters

rng = np.random.default_rng(5)
X = rng.normal(size=(300, 8)) * 2 + 0.5


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, i % 7, None if i % 97 == 5 else X[i].tolist()) for i in range(300)]
    return spark.createDataFrame(rows, "id long, g long, vec array<float>").repartition(3).cache()


def brute(q, metric, k, keep=lambda i: True):
    x = X.astype(np.float32).astype(np.float64)
    q = np.asarray(q)
    d = {"l2": ((x - q) ** 2).sum(1), "dot": 1 - x @ q, "cosine": 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)}[metric]
    order = sorted((i for i in range(300) if i % 97 != 5 and keep(i)), key=lambda i: (d[i], i))
    return order[:k]


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_nearest(vectors, metric):
    q = X[11].tolist()
    how = {"nearest": {"column": "vec", "q": q, "k": 9, "metric": metric}, "row_key": "id"}
    assert [r.id for r in Scan(vectors, **how).to_df().collect()] == brute(q, metric, 9)
    assert [r.id for r in Scan(vectors, **how, filter="g = 3", prefilter=True).to_df().collect()] == brute(q, metric, 9, lambda i: i % 7 == 3)
    assert [r.id for r in Scan(vectors, **how, filter="g = 3").to_df().collect()] == [i for i in brute(q, metric, 9) if i % 7 == 3]


def test_batch_and_range(vectors):
    got = vector.nearest(vectors, {"column": "vec", "q": X[:3].tolist(), "k": 4}, "id").orderBy("query_index", "_distance", "id").collect()
    assert [[r.id for r in got if r.query_index == j] for j in range(3)] == [brute(X[j], "l2", 4) for j in range(3)]
    near = vector.nearest(vectors, {"column": "vec", "q": X[0].tolist(), "k": 300, "distance_range": (5.0, 20.0)}, "id").collect()
    assert near and all(5 <= r._distance < 20 for r in near)
    rows = vector.nearest_rows(vectors, vectors.where("id % 100 = 0"), "vec", "id", 3, block=2).collect()
    assert {(r["query"], r["rank"]): r["id"] for r in rows} == {(q, k + 1): i for q in (0, 100, 200) for k, i in enumerate(brute(X[q].astype(np.float32), "l2", 3))}


def test_bad_searches(vectors):
    for bad in ({"k": 0}, {"metric": "hamming"}, {"metric": "nope"}, {"nprobes": 0}):
        with pytest.raises(ValueError):
            vector.nearest(vectors, {"column": "vec", "q": [0.0] * 8} | bad, "id")
    with pytest.raises(TypeError):
        vector.nearest(vectors, {"column": "vec", "q": [0.0] * 8, "zz": 1}, "id")


def test_nan_last_and_ties(spark):
    rows = [(i, [float("nan") if i == 2 else 1.0, 0.0]) for i in range(6)]
    got = vector.nearest(spark.createDataFrame(rows, "id long, v array<float>"), {"column": "v", "q": [1.0, 0.0], "k": 6}, "id").orderBy(F.col("_distance").asc_nulls_last(), "id").collect()
    assert [r.id for r in got] == [0, 1, 3, 4, 5, 2]


def test_multivector_and_bytes(spark):
    rows = [(0, [[0.0, 0.0], [1.0, 1.0]]), (1, [[5.0, 5.0]]), (2, []), (3, None)]
    got = vector.nearest(spark.createDataFrame(rows, "id long, v array<array<float>>"), {"column": "v", "q": [[0.0, 0.0], [1.0, 1.0]], "k": 9}, "id").orderBy("_distance").collect()
    assert [(r.id, r._distance) for r in got] == [(0, 0.0), (1, 82.0)]
    b = spark.createDataFrame([(0, bytearray([255, 0])), (1, bytearray([1, 1])), (2, None)], "id long, v binary")
    assert [(r.id, r._distance) for r in vector.nearest(b, {"column": "v", "q": [255, 1], "k": 5}, "id").orderBy("id").collect()] == [(0, 1.0), (1, 7.0)]


def test_ivf(spark, vectors, root):
    t = Table.write(vectors.where("id < 250").coalesce(2), root)
    index = vector.IvfIndex.build(t, "vec", partitions=6)
    t.append(vectors.where("id >= 250"))
    q = X[42].tolist()
    assert [r.id for r in index.search({"q": q, "k": 8, "nprobes": 6}).orderBy("_distance", "id").collect()] == brute(q, "l2", 8)
    assert all(r.id < 250 for r in index.search({"q": q, "k": 8, "nprobes": 6}, fast=True).collect())
    assert vector.recall(t.to_df(system=True), index, X[:4], 5, nprobes=5) >= 0.9
    assert sum(r["count"] for r in index.partition_sizes().collect()) == sum(1 for i in range(250) if i % 97 != 5)


def test_hamming_components(spark):
    r = random.Random(4)
    bits = [r.getrandbits(64) for _ in range(40)]
    bits += [bits[k] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for k in range(0, 30, 2)] + bits[:5]
    rows = [(i, b - 2**64 if b >= 2**63 else b) for i, b in enumerate(bits)]
    got = {x.id: x.component for x in vector.hamming_components(spark.createDataFrame(rows, "id long, b long"), "id", "b", 3).collect()}
    root = list(range(len(bits)))
    for _ in bits:
        for i in range(len(bits)):
            for j in range(len(bits)):
                if (bits[i] ^ bits[j]).bit_count() <= 3:
                    root[i] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


WORDS = {"running": "run", "ponies": "poni", "generously": "generous", "caresses": "caress", "hopping": "hop", "hoping": "hope", "national": "nation", "relational": "relat", "skies": "sky", "dying": "die", "happiness": "happi", "agreed": "agre", "sensational": "sensat",
         "licenses": "licens", "consistency": "consist", "knightly": "knight", "by": "by", "cries": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi", "succeed": "succeed", "communication": "communic"}


@pytest.mark.parametrize("word", WORDS)
def test_stem(word):
    assert stem(word) == WORDS[word]


def test_analyzer():
    assert tokenize("The Licenses, of Müller's café!") == [("licens", 1), ("muller", 3), ("cafe", 5)]
    assert tokenize("a bb", analyzer.PLAIN) == [("a", 0), ("bb", 1)] and tokenize(None) == [] and tokenize("x" * 40, analyzer.PLAIN) == []
    code = Params("code", stem=False, remove_stop_words=False, split_identifiers=True, preserve_original=True, index_operators=True)
    assert tokenize("fooBar->x_y == 1", code) == [("foobar", 0), ("foo", 0), ("bar", 1), ("->", 2), ("x_y", 3), ("x", 3), ("y", 4), ("==", 5), ("1", 6)]
    grams = Params("ngram", stem=False, remove_stop_words=False, min_ngram_length=2, max_ngram_length=3)
    assert [t for t, _ in tokenize("abc", grams)] == ["ab", "abc", "bc"]
    assert tokenize("Été", Params(stem=False, ascii_folding_keep_original=True)) == [("été", 0), ("ete", 0)]


TEXTS = ["foo bar foo", "bar baz", None, "", "foo", "the quick foo bar", "bar foo", "food fob foo"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").cache()


def bm25(words, docs):
    n, total = len(docs), sum(map(len, docs.values()))
    out = {}
    for i, d in docs.items():
        s = 0.0
        for w in words:
            df = sum(w in x for x in docs.values())
            f = d.count(w)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.2 * f / (f + 1.2 * (0.25 + 0.75 * len(d) / (total / n)))
        if any(w in d for w in words):
            out[i] = s
    return out


DOCS = {i: t.split() for i, t in enumerate(TEXTS) if t is not None}


def scores(df):
    return {r.id: r._score for r in df.collect()}


def test_queries(texts):
    M = fts.MatchQuery
    for words in (["foo"], ["foo", "bar"], ["foo", "foo"], ["nothing"]):
        assert scores(fts.search(texts, M(" ".join(words), "t"))) == pytest.approx(bm25(words, DOCS))
    both = {i: s for i, s in bm25(["foo", "bar"], DOCS).items() if {"foo", "bar"} <= set(DOCS[i])}
    assert scores(fts.search(texts, M("foo bar", "t", operator="AND"))) == pytest.approx(both)
    assert set(scores(fts.search(texts, fts.PhraseQuery("foo bar", "t")))) == {0, 5} and set(scores(fts.search(texts, fts.PhraseQuery("the foo", "t", slop=1)))) == {5}
    foo, bar = bm25(["foo"], DOCS), bm25(["bar"], DOCS)
    assert scores(fts.search(texts, fts.BoostQuery(M("foo", "t"), M("bar", "t"), 0.5))) == pytest.approx({i: s - 0.5 * bar.get(i, 0) for i, s in foo.items()})
    assert scores(fts.search(texts, fts.BooleanQuery([("MUST", M("foo", "t")), ("SHOULD", M("bar", "t")), ("MUST_NOT", M("quick", "t"))]))) == pytest.approx({i: s + bar.get(i, 0) for i, s in foo.items() if i != 5})
    assert set(scores(fts.search(texts, M("baz", "t") | M("quick", "t")))) == {1, 5} and set(scores(fts.search(texts, M("foo", "t") & M("bar", "t")))) == {0, 5, 6}
    assert set(scores(fts.search(texts, M("foob", "t", fuzziness=1)))) == {0, 4, 5, 6, 7} and set(scores(fts.search(texts, M("fob", "t", fuzziness=1, max_expansions=1)))) == {7}
    assert [r.id for r in Scan(texts, full_text_query="foo", limit=2, row_key="id").to_df().collect()] == sorted(foo, key=lambda i: (-foo[i], i))[:2]
    assert scores(fts.search(texts, {"multi_match": {"match_queries": [{"column": "t", "terms": "foo", "boost": 2.0}]}})) == pytest.approx({i: 2 * s for i, s in foo.items()})
    with pytest.raises(ValueError):
        fts.BooleanQuery([("must_not", M("a", "t"))])


def test_text_index(spark, texts, root):
    t = Table.write(texts.where("id < 5").coalesce(1), root)
    index = fts.TextIndex.build(t, "t", with_position=True, stem=False, remove_stop_words=False)
    t.append(texts.where("id >= 5"))
    index = fts.TextIndex(t, index.entry)
    assert scores(index.search("foo")) == pytest.approx(bm25(["foo"], DOCS)) and set(scores(index.search("foo", fast=True))) == {0, 4}
    assert index.postings().where("term = 'foo'").count() == 2
    plain = fts.TextIndex.build(t, "t", "other")
    with pytest.raises(ValueError, match="position"):
        plain.search(fts.PhraseQuery("foo bar", "t"))


def test_connection(spark, tmp_path):
    db = connect(spark, str(tmp_path))
    h = db.create_table("items", [{"id": i, "vector": [float(i), 1.0], "t": f"word{i} foo"} for i in range(8)])
    assert h.table.schema["vector"].metadata == {"dim": 2} and db.table_names() == ["items"]
    assert [r["id"] for r in h.search([3.2, 1.0]).limit(2).to_list()] == [3, 4]
    assert [r["id"] for r in h.search([3.2, 1.0]).where("id > 5").limit(1).select(["id"]).to_list()] == [6]
    assert [r["id"] for r in h.search("word5").to_list()] == [5] and len(h.search().where("id < 3").to_list()) == 3
    h.update("id = 1", values={"t": "it's"})
    h.add([{"id": 100, "vector": [0.0, 0.0], "t": None}])
    assert h.count_rows("t = 'it''s'") == 1 and h.count_rows() == 9 and h.delete("id = 100")["num_deleted_rows"] == 1
    with pytest.raises(ValueError):
        h.update("id = 1")
    with pytest.raises(ValueError):
        h.add([{"id": 5, "vector": [float("nan"), 0.0], "t": ""}, {"id": 6, "vector": [1.0, 0.0], "t": ""}])
    h.optimize()
    db.drop_table("items")
    assert db.table_names() == []
    c = Catalog(spark, str(tmp_path))
    c.create_namespace("a.b")
    c.create_table("a.b.t", pa.table({"x": [1, 2]}))
    assert c.list_tables("a.b") == ["t"] and c.list_namespaces("a") == ["b"] and c.describe("a.b.t")["num_rows"] == 2
    c.register("alias", c.location("a.b.t"))
    assert c.open("alias").count_rows() == 2
    with pytest.raises(ValueError):
        c.drop_namespace("a")
    assert [literal(v) for v in (None, True, 1.5, "a'b", b"\x01", [1, "x"])] == ["NULL", "TRUE", "1.5", "'a''b'", "X'01'", "[1, 'x']"]


def test_bad_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, [1.0]), (3, None), (4, [2.0, 3.0])], "id long, v array<float>")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(ingest.clean_vectors(df, "v", "drop")) == [0, 3, 4]
    assert ids(ingest.clean_vectors(df, "v", "null").where("v IS NULL")) == [1, 2, 3]
    assert {r.id: r.v for r in ingest.clean_vectors(df, "v", "fill", 9.0).collect()}[2] == [1.0, 9.0]
    with pytest.raises(ValueError):
        ingest.clean_vectors(df, "v")


def test_ndjson(spark, root):
    lines = ['{"a": 1, "b": "x"}', '{"b": "y", "a": 2}', '{"k": [1]}', "oops", "[1]", "", '{"a": "no number", "b": "z"}']
    catalog = ingest.route_ndjson(spark.createDataFrame([(x,) for x in lines], "value string"), root)
    assert sorted((r.route, r.rows) for r in catalog.collect()) == [("a,b", 3), ("k", 1)] or sorted((r.route, r.rows) for r in catalog.collect()) == [("a,b", 2), ("k", 1)]
    assert {"oops", "[1]"} <= {r.line for r in Table(spark, f"{root}/_rejects").to_df().collect()}


def test_streams(spark, root, tmp_path):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("g"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    adapters.append_stream(stream(), root, str(tmp_path / "c1")).awaitTermination()
    t = Table(spark, root)
    assert t.count_rows() == 30
    adapters.append_stream(stream(), root, str(tmp_path / "c1")).awaitTermination()
    assert Table(spark, root).count_rows() == 30  # nothing comes twice
    adapters.merge_stream(stream().withColumn("id", F.col("id") % 10), root + "m", str(tmp_path / "c2"), "id").awaitTermination()
    assert sorted(r.id for r in Table(spark, root + "m").to_df().collect()) == list(range(10))
    assert adapters.changes(spark, root, 0).count() == 30


def test_udf_with_checkpoint(spark, root, tmp_path):
    t = Table.write(spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, x double").coalesce(1), root, rows_per_file=4)

    @batch_udf("y double", checkpoint=str(tmp_path / "c"))
    def double(batch):
        return batch.to_pandas().assign(y=lambda d: d.x * 2)[["y"]]

    double.add_to(t, ["x"])
    assert {r.id: r.y for r in t.to_df().collect()} == {i: 2.0 * i for i in range(10)}


def murmur(data: bytes) -> int:
    """Murmur3 x86 32 with seed 0, tail bytes mixed one by one."""
    m = 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> 32 - r) & m
    h = 0
    mix = lambda k: rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    whole = len(data) // 4 * 4
    parts = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [(b if b < 128 else b - 256) & m for b in data[whole:]]
    for k in parts:
        h = (rot(h ^ mix(k), 13) * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def test_shards_and_samples(spark):
    words = ["", "a", "abcd", "héllo wörld", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, w string")
    got = shard.shard(df, [shard.ShardField("b", "bucket", "w", 10), shard.ShardField("n", "bucket", "id", 7), shard.ShardField("u", "unsharded")]).orderBy("id").collect()
    assert [r.b for r in got] == [0 if w is None else (murmur(w.encode()) & 0x7FFFFFFF) % 10 for w in words]
    assert [r.n for r in got] == [(murmur(i.to_bytes(8, "little")) & 0x7FFFFFFF) % 7 for i in range(5)]
    rows = spark.range(1000)
    assert sample.sample(rows, 50, ["id"], 1).count() == 50 and sample.sample(rows, 50, ["id"], 1).collect() == sample.sample(rows.repartition(5), 50, ["id"], 1).collect()
    parts = [sample.shard_batches(rows, "id", 64, k, 3, seed=2) for k in range(3)]
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(1000))
    assert sample.chunked(rows, "id", 100, 10, 3).count() == 100 and sample.reservoir(rows, 7).count() == 7
    assert sample.shard_fragments(list(range(7)), 1, 3) == [1, 4] and [len(b) for b in sample.batches(rows, "id", 400)] == [400, 400, 200]


def test_types():
    schema = pa.schema([("a", pa.uint64()), ("v", pa.list_(pa.float32(), 3)), ("d", pa.dictionary(pa.int8(), pa.string())), ("t", pa.time64("us")), ("x", pa.decimal256(50, 2)), ("s", pa.struct([("q", pa.int8())])), ("z", pa.timestamp("ns", "Europe/Paris"))])
    got = types.schema_to_spark(schema)
    assert got["a"].dataType == T.DecimalType(20, 0) and got["v"].metadata == {"dim": 3} and got["d"].dataType == T.StringType() and got["x"].dataType == T.StringType()
    with pytest.raises(TypeError):
        types.to_spark(pa.timestamp("us", "+02:00"))

    class Row:
        id: int
        name: str | None
        tags: list[str]

    assert types.from_pydantic(Row).simpleString() == "struct<id:bigint,name:string,tags:array<string>>"


def test_blobs(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(b"0123456789")
    df = spark.createDataFrame([(str(tmp_path / "b.bin"), 2, 3), (None, 0, 1)], "uri string, position long, size long")
    assert {bytes(r.content) if r.content else None for r in ingest.fetch_blobs(df).collect()} == {b"234", None}


def test_fts_postings_writes_its_table_in_many_tasks(spark):
    """Not by one task over half of the documents; row ids still follow doc_id, as ties are decided by them."""
    from brindle.plans import catalogue

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept, catalogue._MADE = catalogue._MADE, {}
    try:
        catalogue.QUERIES["fts_postings"](spark, sf)
        (index,) = catalogue._MADE.values()
        assert len(index.table.manifest.fragments) > 4
        got = [r["doc_id"] for r in index.table.to_df(system=True).orderBy("_rowid").collect()]
        assert got == sorted(got) and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    finally:
        catalogue._MADE = kept
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("how", [{}, {"stem": False, "remove_stop_words": False, "ascii_folding": False}])
def test_postings_are_made_of_each_document_by_itself(spark, root, monkeypatch, how):
    """Tokens aren't shuffled to group them, and of documents that the index doesn't cover only the query's terms are kept."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    dealt, kept, deal, put = [], [], Classic.repartitionByRange, fts.stash
    monkeypatch.setattr(Classic, "repartitionByRange", lambda df, *a: (dealt.append(df._jdf.queryExecution().executedPlan().toString()), deal(df, *a))[1])
    monkeypatch.setattr(fts, "stash", lambda df: (kept.append(put(df)), kept[-1])[1])
    texts = ["the cat sat, the cat ran", "", None, "Dogs and CATS", "a dog " * 50, "b" * 60, "ünï dog"]
    t = Table.write(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), root)
    index = fts.TextIndex.build(t, "text", with_position=True, **how)
    assert len(dealt) == 1 and "Exchange" not in dealt[0] and "Aggregate" not in dealt[0]
    want = Counter()
    for k, x in enumerate(texts):
        tokens = analyzer.tokenize(x, index.params)
        for w in {w for w, _ in tokens}:
            want[w, k, tuple(p for v, p in tokens if v == w), len(tokens)] += 1
    assert Counter((r.term, r._rowaddr, tuple(r.positions), r.dl) for r in index.postings().collect()) == want
    index = fts.TextIndex(t.append(spark.createDataFrame([(10, "dog eats dog"), (11, "nothing here"), (12, None)], "id long, text string")), index.entry)
    kept.clear()
    got = {r["id"] for r in index.search(fts.MatchQuery("dog", "text")).collect()}
    assert got == {r["id"] for r in fts.search(t.to_df(), fts.MatchQuery("dog", "text"), params=index.params).collect()}
    fresh = [r for df in kept if "dl" in df.columns for r in df.collect()]
    assert {x["t"] for r in fresh for x in r["terms"]} == {"dog"} and sum(r["dl"] > 0 for r in fresh) >= 2


def test_batch_searches_hold_few_distances(spark, monkeypatch):
    """A batch's distances to all queries never stand in memory together."""
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(300, 8)))]
    df = spark.createDataFrame(data, "id long, v array<float>").coalesce(1)
    q = r.normal(size=(500, 8))
    monkeypatch.setattr(vector, "CANDIDATES", 8 * 300 * 4)
    made: list = []
    rows = vector.nearest(df, {"column": "v", "q": q, "k": 3}, "id").collect()
    x = np.array([v for _, v in data], np.float32).astype(np.float64)
    want = {(j, i) for j in range(500) for i in np.argsort(((x - q[j]) ** 2).sum(1), kind="stable")[:3]}
    assert {(row["query_index"], row["id"]) for row in rows} == want
    # The step that the executors run, here, with its memory.
    class Given:
        def __init__(self, inner):
            self.inner = inner

        def mapInArrow(self, run, schema):
            made.append(run)
            return self.inner.mapInArrow(run, schema)

    select = type(df).select
    monkeypatch.setattr(type(df), "select", lambda d, *c: Given(select(d, *c)) if d is df else select(d, *c))
    vector.nearest(df, {"column": "v", "q": np.tile(q, (20, 1)), "k": 3}, "id")
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "v"])
    tracemalloc.start()
    assert sum(b.num_rows for b in made[0](iter([batch]))) == 30_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10_000 * 300 * 8 / 2  # bytes of half of the distances


def test_json_is_parsed_once_and_folders_are_listed_whole(spark, root, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from brindle.functions import json_path
    from brindle.plans import indexes

    for name in ("json_get_string", "json_get_int", "json_get_float", "json_get_bool"):
        assert json_path.sql(name, ["props", "'k'"], ["k"]).count("parse_json(") == 1
    df = spark.range(200).selectExpr("id", "concat('{\"k\": ', id % 20, '}') AS props").coalesce(1)
    t = Table.write(df, root, rows_per_file=5)
    indexes.create(t, "props", "JSON", path="$.k")
    paths, read, made = [], DataFrameReader.parquet, []
    monkeypatch.setattr(DataFrameReader, "parquet", lambda r, *p, **o: (paths.append(len(p)), read(r, *p, **o))[1])
    put = getattr(indexes, "stash", None)
    if put:
        monkeypatch.setattr(indexes, "stash", lambda d: (made.append(1), put(d))[1])
    monkeypatch.setattr(indexes, "INLINE", 5)
    got = {r["id"] for r in Scan(t, columns=["id"], filter="json_get_int(props, 'k') = 7 OR json_get_int(props, 'k') BETWEEN 1 AND 18").to_df().collect()}
    assert got == {i for i in range(200) if 1 <= i % 20 <= 18}
    assert made == [1] and max(paths) == 1
    assert t.to_df(fragments=[f.id for f in t.manifest.fragments][:35]).count() == 175
    assert max(paths) == 35

"""Searches and scans read only what their indexes leave: fragments, parts, postings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import fts
from brindle.operators.scan import Scan
from brindle.operators.vector import IvfIndex, Quantizer, nearest, recall
from brindle.plans import indexes
from brindle.sources.table import Table


def data(spark, n=4000):
    return spark.range(n).select(
        "id", (F.col("id") * 7919 % 50).cast("int").alias("x"), F.when(F.col("id") % 13 != 0, F.concat(F.lit("k"), F.col("id") * 31 % 9)).alias("s"),
        F.array((F.col("id") % 5).cast("string"), F.lit("t")).alias("tags"), (F.col("id") / 3).alias("f"),
        F.concat(F.lit('{"k": '), F.col("id") % 40, F.lit(', "a": {"b": "v'), F.col("id") % 10, F.lit('"}}')).alias("j")).repartitionByRange(4, "id")


@pytest.fixture
def table(spark, root):
    return Table.write(data(spark), root, rows_per_file=500)


def files(df):
    return len([f for f in df.inputFiles() if "/data/" in f])


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("kind, column, text, few", [
    ("BTREE", "id", "id = 17", 1), ("BTREE", "id", "id BETWEEN 990 AND 1010", 2), ("ZONEMAP", "id", "id < 400", 1), ("BLOOMFILTER", "id", "id IN (3, 3999)", 2), ("BTREE", "id", "id = -5", 0), ("BTREE", "id", "id = 17 AND x > -1", 1)])
def test_scans_read_the_candidates_fragments(table, kind, column, text, few):
    before = ids(Scan(table, filter=text).to_df())
    every = len(table.manifest.fragments)
    assert files(Scan(table, filter=text).to_df()) == every >= 8
    indexes.create(table, column, kind)
    df = Scan(table, filter=text).to_df()
    assert ids(df) == before and files(df) <= few and files(Scan(table, filter=text, use_scalar_index=False).to_df()) == every


def test_uncovered_fragments_are_read(table, spark):
    indexes.create(table, "id", "BTREE")
    table.append(data(spark).limit(40).withColumn("id", F.lit(17).cast("long")))
    assert len(ids(Scan(table, filter="id = 17").to_df())) == 41 and len(ids(Scan(table, filter="id = 17", fast_search=True).to_df())) == 1
    table.delete("id = 17 AND x = 0")
    assert ids(Scan(table, filter="id = 17").to_df()) == ids(Scan(table, filter="id = 17", use_scalar_index=False).to_df())


@pytest.mark.parametrize("text", ["json_get_int(j, 'k') = 3", "json_get_int(j, 'k') > 37", "3 = json_get_int(j, 'k')", "json_get_string(j, 'k') IN ('4', '5')", "json_get_int(j, 'k') BETWEEN 5 AND 6"])
def test_json_index_answers_accessors(table, text):
    before = ids(Scan(table, filter=text).to_df())
    indexes.create(table, "j", "JSON", path="$.k")
    assert indexes.explain(table, text)["answered"] and ids(Scan(table, filter=text).to_df()) == before and before


def test_json_index_of_a_path(table):
    text = "json_extract(j, '$.a.b') = '\"v3\"'"
    before = ids(Scan(table, filter=text).to_df())
    indexes.create(table, "j", "JSON", path="$.a.b")
    assert indexes.explain(table, text)["answered"] and not indexes.explain(table, "json_get_int(j, 'k') = 3")["answered"]
    assert ids(Scan(table, filter=text).to_df()) == before and len(before) == 400


@pytest.mark.parametrize("kind, column, text, exact", [
    ("BTREE", "x", "x = 7", True), ("BITMAP", "s", "s IN ('k1', 'k2')", True), ("BITMAP", "s", "s IS NULL", True), ("BTREE", "x", "x < 10 OR x = 40", True), ("LABEL_LIST", "tags", "array_has(tags, '3')", False),
    ("BTREE", "f", "f < 100", False), ("BTREE", "x", "x < 10 AND id > 100", False), ("ZONEMAP", "x", "x = 7", False)])
def test_counts_from_indexes(table, kind, column, text, exact):
    indexes.create(table, column, kind)
    table.delete("id % 7 = 3")
    assert (indexes.count(table, text) is not None) == exact
    assert Scan(table, filter=text).count_rows() == Scan(table, filter=text, use_scalar_index=False).count_rows()


def test_a_limit_takes_the_first_fragments(table):
    df = Scan(table, limit=5, offset=510).to_df()
    assert files(df) == 2 and len(ids(df)) == 5
    table.delete("id < 498")
    assert files(Scan(table, limit=5).to_df()) == 2
    assert Scan(table, columns=["id"]).head(3).num_rows == 3 and Scan(table, columns=["id"], limit=2).head(9).num_rows == 2
    assert "Scan" in Scan(table, filter="x = 3").analyze() and "numOutputRows" in Scan(table, filter="x = 3").analyze()


def test_batches(table):
    got = list(Scan(table, columns=["id", "tags"], batch_size=300).to_batches())
    assert all(b.num_rows <= 300 for b in got) and sum(b.num_rows for b in got) == 4000 and got[0].schema.names == ["id", "tags"]


# -- vectors ---------------------------------------------------------------------------------------------------


@pytest.fixture
def vectors(spark, root):
    r = np.random.default_rng(4)
    centre = r.normal(0, 4, (20, 16))
    x = (centre[r.integers(0, 20, 3000)] + r.normal(0, 1, (3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, i % 7, None if i % 97 == 5 else v.tolist()) for i, v in enumerate(x)], "id long, g long, vec array<float>")
    return Table.write(df.repartitionByRange(3, "id"), root, rows_per_file=700), x


@pytest.mark.parametrize("kind, refine, least", [("IVF_FLAT", None, 0.95), ("IVF_SQ", None, 0.9), ("IVF_PQ", 10, 0.9), ("IVF_HNSW_SQ", 4, 0.95)])
def test_ivf_recall_at_real_probes(vectors, kind, refine, least):
    table, x = vectors
    index = IvfIndex.build(table, "vec", partitions=16, kind=kind)
    more = {"refine_factor": refine} if refine else {}
    assert recall(table.to_df(system=True), index, x[[3, 500, 999, 1500, 2100, 2900]] + 0.05, 10, nprobes=4, **more) >= least
    got = index.search({"q": x[42].tolist(), "k": 5, "nprobes": 2, **more})
    assert [f for f in got.inputFiles() if "/parts/" in f] == []  # the probed parts are done with; the table's fragments are read
    assert got.count() == 5 and {"id", "g", "vec", "_distance"} <= set(got.columns)
    if refine or kind == "IVF_FLAT":
        assert got.orderBy("_distance").first().id == 42 and got.orderBy("_distance").first()._distance < 1e-5


def test_ivf_filters_deletions_and_new_rows(vectors, spark):
    table, x = vectors
    for kind in ("IVF_FLAT", "IVF_SQ"):
        index = IvfIndex.build(table, "vec", "v", partitions=16, kind=kind)
        got = index.search({"q": x[42].tolist(), "k": 8, "nprobes": 16, "refine_factor": 4}, filter="g = 3")
        want = nearest(table.to_df(system=True).where("g = 3"), {"column": "vec", "q": x[42].tolist(), "k": 8}, "_rowid")
        assert ids(got) == ids(want)
    index = IvfIndex.build(table, "vec", "v", partitions=16)
    table.delete("id = 42")
    table.append(spark.createDataFrame([(9000, 1, x[42].tolist())], "id long, g long, vec array<float>"))
    index = IvfIndex(table, table.manifest.indexes[-1])
    got = index.search({"q": x[42].tolist(), "k": 3, "nprobes": 4})
    assert 9000 in ids(got) and 42 not in ids(got) and 9000 not in ids(index.search({"q": x[42].tolist(), "k": 3, "nprobes": 4}, fast=True))
    # Too few rows in the first part: more parts are probed until k are found.
    assert index.search({"q": x[42].tolist(), "k": 900, "minimum_nprobes": 1}).count() == 900
    assert index.search({"q": x[42].tolist(), "k": 900, "minimum_nprobes": 1, "maximum_nprobes": 2}).count() <= 900


def test_quantizers():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (2000, 16))
    for kind, most in (("SQ", 0.001), ("PQ", 0.5)):
        q = Quantizer.train(x, kind)
        codes = q.encode(x)
        assert codes.dtype == np.uint8 and ((q.decode(codes) - x) ** 2).mean() < most * x.var()
    with pytest.raises(ValueError):
        Quantizer.train(x, "PQ", 5)


# -- text ------------------------------------------------------------------------------------------------------


def test_text_index_equals_a_search_of_the_rows(spark, root):
    r = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "alphas", "betas", "zeta"]
    rows = [(i, None if i % 97 == 3 else " ".join(r.choice(words, r.integers(1, 20)))) for i in range(600)]
    table = Table.write(spark.createDataFrame(rows, "id long, text string").repartitionByRange(3, "id"), root, rows_per_file=150)
    index = fts.TextIndex.build(table, "text", with_position=True)
    table.append(spark.createDataFrame([(9001, "alpha beta alpha"), (9002, None)], "id long, text string"))
    table.delete("id % 11 = 4")
    index = fts.TextIndex(table, table.manifest.indexes[-1])
    M, P = (lambda t, **k: fts.MatchQuery(t, "text", **k)), (lambda t, **k: fts.PhraseQuery(t, "text", **k))
    asked = [M("alpha"), M("alpha zeta", operator="and"), P("alpha beta"), P("gamma delta", slop=1), M("alphe", fuzziness=1), fts.BooleanQuery([("must", M("alpha")), ("must_not", M("beta")), ("should", M("omega"))]),
             fts.BoostQuery(M("alpha"), M("zeta")), M("nothing")]
    every = table.to_df(system=True)
    for q in asked:
        want = sorted((r.id, round(r._score, 9)) for r in fts.search(every, q, params=index.params).collect())
        assert sorted((r.id, round(r._score, 9)) for r in index.search(q).collect()) == want, q
        best = [(r.id, round(r._score, 9)) for r in fts.search(every, q, 10, "_rowid", params=index.params).collect()]
        assert [(r.id, round(r._score, 9)) for r in index.search(q, 10).collect()] == best, q
    one = index.search(M("alpha beta alpha"), 1)
    assert files(one) == 1 and index.postings().where("term = 'alpha'").count() > 0
    assert 9001 not in ids(index.search(M("alpha"), fast=True))

"""Fragments and later commits, blobs, bitmaps, model builders, as-of joins, command line, pyarrow filters, asyncio."""

import asyncio
import io
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from brindle.__main__ import main
from brindle.functions.bitmap import Bitmap, remap
from brindle.operators import joins, sample
from brindle.operators.builder import IndicesBuilder
from brindle.operators.scan import Scan, from_pyarrow
from brindle.plans import indexes
from brindle.sources import aio, blob, fragments
from brindle.sources.manifest import CommitConflict, RetryableConflict
from brindle.sources.table import Table
from brindle.streaming import adapters


@pytest.fixture
def table(spark, root):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.concat(F.lit("s"), "id").alias("s")).repartitionByRange(1, "id")
    return Table.write(df, root, rows_per_file=250)


def test_fragments(table):
    assert [h.id for h in fragments.handles(table)] == [0, 1, 2, 3]
    h = fragments.Handle(table, 2)
    assert h.count_rows() == 250 and h.count_rows("g = 3") == sum(k % 7 == 3 for k in range(500, 750)) and [r.id for r in h.head(3).collect()] == [500, 501, 502]
    assert [r.id for r in h.take([9, 0, 9]).collect()] == [509, 500, 509] and h.to_df().count() == 250
    with pytest.raises(IndexError):
        h.take([250])
    with pytest.raises(ValueError):
        fragments.Handle(table, 9)
    assert h.delete("id < 505")["num_deleted_rows"] == 5 and table.count_rows() == 995
    h = fragments.Handle(table, 2)
    assert [r.id for r in h.take([0]).collect()] == [505]
    h.merge_columns({"twice": "id * 2"})
    got = {r.id: r.twice for r in table.to_df().collect()}
    assert got[600] == 1200 and got[100] is None


def test_files_committed_later(table, spark, root):
    more = spark.createDataFrame([(5000, 1, "x"), (5001, 2, "y")], "id long, g long, s string")
    a, b = fragments.write_fragments(more, root, table), fragments.write_fragments(more.withColumn("id", F.col("id") + 10), root, table)
    assert Table(spark, root).count_rows() == 1000
    t = fragments.commit_batch(spark, root, [a, b])
    assert t.version == 2 and t.count_rows() == 1004 and t.to_df().where("id >= 5000").count() == 4
    with pytest.raises(ValueError):
        fragments.commit(spark, root, [{**a[0], "fields": ["id"]}])
    fresh = fragments.write_fragments(more.select("id"), root)
    t = fragments.commit(spark, root, fresh, "overwrite")
    assert t.schema.fieldNames() == ["id"] and t.count_rows() == 2 and Table(spark, root, 2).count_rows() == 1004
    with pytest.raises((CommitConflict, RetryableConflict)):
        fragments.commit(spark, root, a, read_version=2)


def test_blobs(spark, root):
    data = [bytes([k]) * (k * 100) for k in range(20)]
    table = Table.write(spark.createDataFrame([(k, bytearray(d) if k != 7 else None) for k, d in enumerate(data)], "id long, b binary").coalesce(1), root, rows_per_file=6)
    blob.flag(table, "b")
    table.delete("id = 3")
    files = blob.take_blobs(table, "b", positions=[0, 4, 18, 6])
    assert [f and f.size() for f in files] == [0, 500, 1900, None]
    f = files[2]
    assert f.read(10) == data[19][:10] and f.tell() == 10 and f.seek(-5, io.SEEK_END) == 1895 and f.read() == data[19][-5:] and f.read() == b""
    assert io.BufferedReader(files[1]).read() == data[5]
    with pytest.raises(IndexError):
        blob.take_blobs(table, "b", positions=[19])
    told = Scan(table, columns=["id", "b"], blob_handling="blobs_descriptions").to_df().where("id = 9").first()
    assert told.b.size == 900 and blob.take_blobs(table, "b", addresses=[told.b.position])[0].read(3) == data[9][:3]
    assert Scan(table, columns=["b"]).to_df().schema["b"].dataType.simpleString() == "binary"
    wanted = table.to_df(system=True).where("id IN (5, 9)").select("_rowaddr", "id", F.lit(2).alias("position"), F.lit(4).alias("size"))
    assert {r.id: bytes(r.content) for r in blob.read_ranges(table, "b", wanted).collect()} == {5: data[5][2:6], 9: data[9][2:6]}
    with pytest.raises(ValueError):
        Scan(table, blob_handling="some")


def test_bitmaps():
    r = random.Random(4)
    a, b = {r.randrange(1 << 20) for _ in range(9000)} | set(range(70_000, 90_000)), {r.randrange(1 << 34) for _ in range(3000)} | set(range(80_000, 100_000))
    x, y = Bitmap(a), Bitmap(b)
    for got, want in ((x | y, a | b), (x & y, a & b), (x - y, a - b), (x ^ y, a ^ b)):
        assert list(got) == sorted(want) and len(got) == len(want) and Bitmap.loads(got.dumps()) == got
    assert all((v in x) == (v in a) for v in range(0, 1 << 20, 97)) and Bitmap.of_range(5, 9) == Bitmap([5, 6, 7, 8]) and list(Bitmap()) == []
    x.discard(75_000)
    x.add(1 << 33)
    assert 75_000 not in x and (1 << 33) in x and Bitmap([1, 2 << 32]).fragments() == {0, 2}
    assert list(remap(Bitmap([1, 2, 3]), {2: 9, 3: None})) == [1, 9]
    with pytest.raises(ValueError):
        Bitmap([-1])


def test_bitmap_as_a_mask(table, spark):
    mask = Bitmap([3, (1 << 32) + 5])
    assert sorted(r.id for r in Scan(table, row_addr_allowlist=mask.to_df(spark)).to_df().collect()) == [3, 255]


def test_indices_builder(spark, tmp_path):
    x = np.random.default_rng(2).normal(0, 1, (400, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "_rowaddr long, v array<float>")
    b = IndicesBuilder(df, "v")
    with pytest.raises(ValueError):
        b.assign()
    assert b.train_ivf(4).shape == (4, 8)
    b.train_pq(2)
    b.save(spark, f"{tmp_path}/model.json")
    again = IndicesBuilder.load(df, f"{tmp_path}/model.json")
    assert np.allclose(again.centroids, b.centroids) and again.transform().count() == 400
    parts = {r["_rowaddr"]: r["_part"] for r in again.assign().collect()}
    assert all(parts[k] == ((b.centroids - x[k].astype(np.float32)) ** 2).sum(1).argmin() for k in range(0, 400, 17))
    assert b.train_sq().kind == "SQ"


def test_asof_against_brute_force(spark):
    r = random.Random(3)
    left = [(k, r.choice([1, 2, 3, None]), r.choice([None, *range(40)])) for k in range(200)]
    right = [(r.choice([1, 2, None]), r.choice([None, *range(0, 40, 3)]), k) for k in range(60)]
    l, q = spark.createDataFrame(left, "k long, g long, t long"), spark.createDataFrame(right, "g long, t long, v long")
    for direction in ("backward", "forward"):
        for tolerance in (None, 4):
            got = {x.k: x.v for x in joins.join_asof(l, q, "t", ["g"], ["v"], tolerance, direction, ties="v").collect()}
            for k, g, t in left:
                fit = [(x[1], x[2]) for x in right if g is not None and t is not None and x[0] == g and x[1] is not None and (x[1] <= t if direction == "backward" else x[1] >= t)]
                best = (max(fit) if direction == "backward" else min(fit)) if fit else None
                want = best[1] if best and (tolerance is None or abs(best[0] - t) <= tolerance) else None
                assert got[k] == want, (direction, tolerance, k)
    assert joins.join_asof(l.limit(0), q, "t", ["g"], ["v"]).count() == 0 and joins.join_asof(l, q.limit(0), "t", ["g"], ["v"]).where("v IS NOT NULL").count() == 0


def test_neighbours(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9), (None, 5), (1, None)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (None,), (1,)], "node long")
    assert [sorted(r.node for r in joins.neighbours(seeds, edges, hops=h).collect()) for h in (1, 2, 3)] == [[2], [2, 3], [2, 3, 4]]


def test_command_line(spark, tmp_path, root):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    df.coalesce(1).write.parquet(f"{tmp_path}/p.parquet")
    assert main(["convert", f"{tmp_path}/p.parquet", root], spark).startswith("2 rows")
    assert '"num_rows": 2' in main(["inspect", root], spark) and '"s": "a"' in main(["head", root, "1"], spark) and "1" in main(["versions", root], spark)
    with pa.OSFile(f"{tmp_path}/x.arrow", "wb") as f, pa.ipc.new_file(f, pa.schema([("id", pa.int64())])) as w:
        w.write_batch(pa.record_batch([pa.array([1, 2, 3])], names=["id"]))
    assert main(["convert", f"{tmp_path}/x.arrow", root + "2"], spark).startswith("3 rows")
    with pytest.raises(SystemExit):
        main(["what"], spark)


def test_pyarrow_filters(table):
    f = pc.field
    for e, text in [((f("id") > 3) & (f("g") == 2), "id > 3 AND g = 2"), (f("s") == "s'1\"", "s = 's''1\"'"), (f("id").isin([3, 5]), "id IN (3, 5)"), (~(f("g") < 6), "NOT g < 6"),
                    (f("s").isin(["s1", "s77"]) | f("g").is_null(), "s IN ('s1', 's77') OR g IS NULL"), (f("g").is_valid() & (f("id") < 9), "g IS NOT NULL AND id < 9")]:
        assert Scan(table, filter=e).count_rows() == Scan(table, filter=text).count_rows(), from_pyarrow(e)


def test_asyncio(spark, root):
    async def go():
        db = await aio.connect(spark, root)
        t = await db.create_table("t", [{"a": 1}, {"a": 2}])
        await t.add([{"a": 3}])
        return await db.table_names(), await t.count_rows()

    assert asyncio.run(go()) == (["t"], 3)


def test_merge_conditions_on_columns_named_like_the_sides(spark, root):
    table = Table.write(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, source string, target string"), root)
    new = spark.createDataFrame([(1, "z", "q"), (2, "w", "r")], "id long, source string, target string")
    table.merge_insert("id").when_matched_update_all("source.source = 'z' AND target.target = 'x'").execute(new)
    assert sorted(tuple(r) for r in table.to_df().collect()) == [(1, "z", "q"), (2, "b", "y")]


def test_a_micro_batch_is_one_version(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "id long, v long")
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
    root = f"{tmp_path}/t"
    for _ in range(2):
        adapters.append_stream(stream(), root, f"{tmp_path}/c").awaitTermination()
        spark.createDataFrame([(2, 3)], "id long, v long").write.mode("append").parquet(f"{tmp_path}/in")
    assert Table(spark, root).version == 2 and Table(spark, root).count_rows() == 2
    for k in range(2):
        adapters.merge_stream(stream(), root, f"{tmp_path}/m", "id").awaitTermination()
    assert Table(spark, root).version == 3


def test_incremental_index(table, spark):
    indexes.create(table, "id", "BTREE")
    first = table.manifest.indexes[0]
    table.append(spark.createDataFrame([(5000, 1, "x")], "id long, g long, s string"))
    indexes.optimize(table)
    entry = table.manifest.indexes[0]
    assert entry["path"] == first["path"] and len(entry["parts"]) == 2 and indexes.describe(table)[0]["uncovered_rows"] == 0
    assert indexes.count(table, "id >= 999") == 2
    indexes.create(table, "g", "BITMAP", fragments=[0, 1])
    assert Scan(table, filter="g = 3").count_rows() == sum(k % 7 == 3 for k in range(1000)) and indexes.count(table, "g = 3") is None
    table.overlay(table.to_df(system=True).where("id = 10").select("_rowid", F.lit(7777).cast("long").alias("id")))
    assert Scan(table, filter="id = 7777").count_rows() == 1
    indexes.optimize(table)
    assert indexes.count(table, "id = 7777") in (1, None) and Scan(table, filter="id = 7777").count_rows() == 1


def test_random_batches(spark):
    got = sample.rand_batches(spark.range(1000), "id", 64, 3, ["id"], seed=5)
    per = {r["_batch"]: r["count"] for r in got.groupBy("_batch").count().collect()}
    assert len(per) == 3 and all(n == 64 or b == 15 and n == 40 for b, n in per.items())


def test_deletions_of_one_fragment_merge(spark, root):
    spark.range(100).coalesce(1).write.parquet(f"{root}-src")
    Table.write(spark.read.parquet(f"{root}-src"), root)
    a, b, c = (Table(spark, root) for _ in range(3))
    assert a.delete("id < 10")["num_deleted_rows"] == 10 and b.delete("id BETWEEN 5 AND 19")["num_deleted_rows"] == 10
    assert Table(spark, root).count_rows() == 80 == Table(spark, root).to_df().count() and b.version == 3
    assert c.delete("id < 3")["num_deleted_rows"] == 0 and Table(spark, root).version == 3
    d, e = Table(spark, root), Table(spark, root)
    d.update({"id": "id + 1000"}, "id = 50")
    with pytest.raises(RetryableConflict):
        e.delete("id = 51")

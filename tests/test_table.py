import json
import random

import pytest
from pyspark.sql import types as T

from brindle.operators import compact
from brindle.operators.scan import Ordering, Scan, slice_rows, take, take_rows
from brindle.plans import indexes
from brindle.plans.sql import run as select
from brindle.sources.manifest import CommitConflict, RetryableConflict, verdict
from brindle.sources.table import Table, stitch


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def numbers(spark, n, start=0):
    return spark.createDataFrame([(i, i * 10) for i in range(start, start + n)], "id long, v long").coalesce(1)


def test_changes_one_after_another(spark, root):
    t = Table.write(numbers(spark, 20), root, stable_row_ids=True, rows_per_file=7)
    assert len(t.fragments()) == 3 and t.count_rows() == 20
    t.append(spark.createDataFrame([(50,)], "id long"))
    assert t.delete("id BETWEEN 3 AND 5") == {"num_deleted_rows": 3} and t.delete("id = 999")["num_deleted_rows"] == 0
    assert t.update({"v": "v + 1"}, "id < 3")["num_updated_rows"] == 3
    source = spark.createDataFrame([(2, -2), (7, -7), (50, 500), (51, 510), (None, 1)], "id long, v long")
    done = t.merge_insert("id").when_matched_update_all().when_not_matched_insert_all().execute(source)
    assert done == {"num_inserted_rows": 2, "num_updated_rows": 3, "num_deleted_rows": 0}
    want = {i: i * 10 for i in range(20) if not 3 <= i <= 5} | {0: 1, 1: 11, 2: -2, 7: -7, 50: 500, 51: 510, None: 1}
    assert got(t.to_df()) == sorted(want.items(), key=repr)
    d = t.delta(2)
    assert {r.id for r in d.inserted().collect()} == {51, None}
    assert {r.id for r in d.updated().collect()} == {0, 1, 2, 7, 50}
    assert {r[0] for r in d.deleted_row_ids().collect()} == {3, 4, 5}
    before = got(t.to_df(system=True).select("id", "v", "_rowid", "_row_created_at_version", "_row_last_updated_at_version"))
    t.compact()
    assert len(t.fragments()) == 1 and not t.manifest.deletions
    assert got(t.to_df(system=True).select("id", "v", "_rowid", "_row_created_at_version", "_row_last_updated_at_version")) == before
    assert t.validate() == [] and [v["operation"] for v in t.versions()][:3] == ["Overwrite", "Append", "Delete"]
    assert got(t.checkout(1).to_df()) == got(numbers(spark, 20))


def test_merge_rules(spark, root):
    target = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4)], "k long, s string, n int").coalesce(1)
    t = Table.write(target, root)
    with pytest.raises(ValueError):
        t.merge_insert("k").execute(target)
    with pytest.raises(ValueError):
        t.merge_insert("k").when_matched_fail().execute(spark.createDataFrame([(2, "x", 0)], "k long, s string, n int"))
    assert t.merge_insert("k").when_matched_update_all().execute(spark.createDataFrame([(1, "z", 9)], "k long, s string, n int"))["num_updated_rows"] == 1
    assert got(t.to_df()) == sorted([(1, "a", 1), (1, "z", 9), (2, "c", 3), (None, "d", 4)], key=repr)  # only the last of the target's
    t.merge_insert("k").when_matched_update_all().when_not_matched_insert_all().execute(spark.createDataFrame([(2, 7), (5, 8)], "k long, n int"))
    assert (2, "c", 7) in got(t.to_df()) and (5, None, 8) in got(t.to_df())
    with pytest.raises(ValueError):
        t.merge_insert("k").when_matched_update_all().execute(spark.createDataFrame([(2, 7), (2, 8)], "k long, n int"))
    assert t.merge_insert("k").when_matched_delete().execute(spark.createDataFrame([(2, 7)], "k long, n int"))["num_deleted_rows"] == 1
    with pytest.raises(ValueError):
        t.merge_insert("k").when_matched_update_all().rewrite_columns().execute(target)
    t.merge_insert("k").when_matched_update_all().rewrite_columns().execute(spark.createDataFrame([(5, 80)], "k long, n int"))
    assert (5, None, 80) in got(t.to_df())
    done = t.merge_insert("k").when_matched_update_all("source.n > target.n").when_not_matched_by_source_delete("n < 5").execute(spark.createDataFrame([(5, "q", 1)], "k long, s string, n int"))
    assert done["num_updated_rows"] == 0 and all(r[0] == 5 or r[2] >= 5 for r in got(t.to_df()))


def test_columns(spark, root):
    t = Table.write(numbers(spark, 6), root)
    t.add_columns({"w": "v * 2", "neg": "-id"})
    t.add_columns(T.StructType([T.StructField("z", T.StringType())]))
    t.add_columns(spark.createDataFrame([(0, "first")], "_rowid long, tag string"))
    assert [r for r in got(t.to_df()) if r[0] == 0] == [(0, 0, 0, 0, None, "first")] and [r for r in got(t.to_df()) if r[0] == 1] == [(1, 10, 20, -1, None, None)]
    with pytest.raises(ValueError):
        t.add_columns({"w": "1"})
    t.overlay(spark.createDataFrame([(1, "q"), (2, None)], "id long, z string"), on="id")
    t.overlay(spark.createDataFrame([(1, None)], "id long, z string"), on="id")
    assert {r.id: r.z for r in t.to_df().collect()}[1] is None
    t.alter_columns({"path": "w", "name": "ww"}, {"path": "id", "data_type": "int"})
    with pytest.raises(ValueError):
        t.alter_columns({"path": "ww", "data_type": "string"})
    with pytest.raises(ValueError):
        t.alter_columns({"path": "z", "nullable": False})
    t.drop_columns(["v", "neg"])
    t.add_columns({"v": "ww + 1"})  # a dropped name comes back with other values
    assert t.schema.simpleString() == "struct<id:int,ww:bigint,z:string,tag:string,v:bigint>" and {r.id: r.v for r in t.to_df().collect()}[3] == 61
    t.append(spark.createDataFrame([(9, 5)], "id int, v long"))
    assert {r.id: (r.v, r.ww) for r in t.to_df().collect()}[9] == (5, None)
    t.compact()
    assert not t.manifest.patches and {r.id: r.v for r in t.to_df().collect()} == {i: i * 20 + 1 for i in range(6)} | {9: 5}


def test_nested_drop_and_merge(spark, root):
    t = Table.write(spark.createDataFrame([(1, (2, "x"))], "id long, s struct<a:int,b:string>"), root)
    t.drop_columns(["s.b"])
    assert got(t.to_df().select("id", "s.*")) == [(1, 2)]
    right = spark.createDataFrame([(1, "old"), (1, "new"), (None, "no")], "k long, r string").coalesce(1)
    assert got(t.merge(right, "id", "k").to_df().select("id", "r")) == [(1, "new")]


def test_refs(spark, root, tmp_path):
    t = Table.write(numbers(spark, 5), root)
    t.tag("one")
    t.delete("id > 2")
    assert t.checkout("one").count_rows() == 5 and t.tags()["one"]["version"] == 1
    with pytest.raises(ValueError):
        t.tag("one")
    b = t.create_branch("b")
    b.append(numbers(spark, 1, 77))
    assert (b.count_rows(), t.count_rows(), t.branches()) == (4, 3, ["b"])
    for deep in (False, True):
        c = t.clone(str(tmp_path / f"clone{deep}"), deep)
        assert got(c.to_df()) == got(t.to_df())
    old = t.checkout(1)
    old.restore()
    assert old.version == 3 and old.count_rows() == 5
    assert Table(spark, root, asof=old.manifest.timestamp + 1).version == 3
    with pytest.raises(ValueError):
        Table(spark, root, asof=1.0)
    assert old.cleanup(0, 1)["old_versions"] == 1  # the tagged and the newest stay
    assert old.checkout("one").count_rows() == 5 and old.validate() == []
    t.delete_branch("b")
    assert t.branches() == []


def test_conflicts(spark, root):
    t = Table.write(numbers(spark, 10), root)
    a, b, c = Table(spark, root), Table(spark, root), Table(spark, root)
    a.append(numbers(spark, 2, 100))
    b.append(numbers(spark, 2, 200))  # appends go together
    assert b.count_rows() == 14
    a.checkout()
    with pytest.raises(RetryableConflict):
        c.delete("id = 1")
        t.delete("id = 2")  # the same fragment
    d = Table(spark, root)
    Table.write(numbers(spark, 1), root, "overwrite")
    with pytest.raises(CommitConflict):
        d.append(numbers(spark, 1))
    assert verdict({"operation": "Merge"}, {"operation": "Append"}) == "R" and verdict({"operation": "Append"}, {"operation": "Restore"}) == "I"
    assert verdict({"operation": "Delete", "fragments": [1]}, {"operation": "Update", "fragments": [2]}) == "C"


def test_scan(spark, root):
    t = Table.write(numbers(spark, 100).repartitionByRange(3, "id").sortWithinPartitions("id"), root)
    t.delete("id % 10 = 0")
    live = [i for i in range(100) if i % 10]
    assert [r.id for r in take(t, [3, 0, 3, 89], ["id"]).collect()] == [live[3], live[0], live[3], live[89]]
    assert sorted(r.id for r in slice_rows(t, 20, 50, ["id"]).collect()) == live[20:50]
    with pytest.raises(IndexError):
        take(t, [90])
    ids = [r[0] for r in t.to_df(system=True).where("id IN (55, 12)").orderBy("id").select("_rowid").collect()]
    assert [r.id for r in take_rows(t, ids[::-1], ["id"]).collect()] == [55, 12]
    assert [r.id for r in Scan(t, columns=["id"], limit=3, offset=2, filter="id > 10").to_df().collect()] == [13, 14, 15]
    assert [r.id for r in Scan(t, columns=["id"], order_by=[Ordering("id", False)], limit=2).to_df().collect()] == [99, 98]
    assert Scan(t, columns={"twice": "v * 2"}, filter="id = 3").to_df().collect()[0].twice == 60
    rows = Scan(t, columns=["id", "_rowoffset"], filter="id < 5").to_df().collect()
    assert sorted((r.id, r._rowoffset) for r in rows) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert Scan(t, filter="id < 0").count_rows() == 0 and Scan(t).count_rows() == 90
    assert Scan(t, include_deleted_rows=True, with_row_id=True).to_df().where("_rowid IS NULL").count() == 10
    assert sum(b.num_rows for b in Scan(t, batch_size=7).to_batches()) == 90
    for bad in ({"nope": 1}, {"limit": -1}, {"batch_size": 0}, {"include_deleted_rows": True}, {"order_by": ["id"], "columns": {"a": "id"}}):
        with pytest.raises((TypeError, ValueError)):
            Scan(t, **bad)


@pytest.mark.parametrize("seed", range(6))
def test_order_by(spark, seed):
    rng = random.Random(seed)
    pool = [None, float("nan"), -0.0, 0.0, 1.5, -2.25, float("inf"), float("-inf")]
    rows = [(i, rng.choice([None, *range(5)]), rng.choice(pool)) for i in range(120)]
    asc, first = rng.random() < 0.5, rng.random() < 0.5
    out = Scan(spark.createDataFrame(rows, "id long, i long, f double"), order_by=[Ordering("f", asc, first), Ordering("i", not asc, not first)], row_key="id").to_df().collect()
    total = lambda x: (2, 0) if x != x else (1, x, str(x) != "-0.0")

    def key(r, col, up, nulls_first):
        return (0 if nulls_first else 2, ()) if r[col] is None else (1, total(r[col]))

    import functools

    def compare(a, b):
        for col, up, nf in ((2, asc, first), (1, not asc, not first)):
            x, y = key(a, col, up, nf), key(b, col, up, nf)
            if x[0] != y[0]:
                return -1 if x[0] < y[0] else 1
            if x[1] != y[1]:
                return (-1 if x[1] < y[1] else 1) * (1 if up else -1)
        return a[0] - b[0]

    assert [r[0] for r in out] == [r[0] for r in sorted(rows, key=functools.cmp_to_key(compare))]


def test_sql(spark, root):
    rows = [(i, float(i) / 3, None if i % 4 == 3 else f"b{i % 3}", i % 2 == 0, (i, i > 5)) for i in range(10)]
    t = Table.write(spark.createDataFrame(rows, "a int, d double, b string, flag boolean, s struct<x:long,y:boolean>").coalesce(1), root)
    q = lambda text, **how: [tuple(r) for r in t.sql(text, **how).collect()]
    assert len(q("SELECT * FROM dataset")) == 10 and len(q("select * from DataSet where A > 3 and flag")) == 3
    assert q("SELECT count(*) AS n FROM dataset WHERE flag") == [(5,)] and t.sql("SELECT count(*) FROM dataset").columns == ["count(*)"]
    assert q("SELECT a*2 AS twice, 'it''s' x, s.x FROM dataset WHERE a = 4") == [(8, "it's", 4)]
    assert [r[0] for r in q("SELECT a FROM dataset ORDER BY b, a")][:3] == [0, 6, 9] and [r[0] for r in q("SELECT a FROM dataset ORDER BY b DESC, a LIMIT 2")] == [3, 7]
    assert [r[0] for r in q("SELECT a FROM dataset ORDER BY b ASC NULLS FIRST, a LIMIT 3 OFFSET 1")] == [7, 0, 6] and len(q("SELECT a FROM dataset OFFSET 7")) == 3
    assert q("SELECT a FROM dataset LIMIT 0") == [] and len(q("SELECT *, a + 1 AS more FROM dataset", with_row_id=True)[0]) == 7
    assert t.sql("SELECT *, a + 1 AS more FROM dataset", with_row_id=True).columns[-2:] == ["_rowid", "more"]
    for bad in ("SELECT zz FROM dataset", "SELECT a FROM dataset WHERE zz = 1", "SELECT a FROM dataset ORDER BY zz", "SELECT a FROM other", "SELECT a, a FROM dataset", "SELECT a FROM dataset WHERE a = 'x'", "SELECT a FROM dataset WHERE", "", "SELECT a FROM dataset LIMIT x"):
        with pytest.raises(ValueError):
            q(bad)
    for word, text in {"GROUP BY": "SELECT a FROM dataset GROUP BY a", "sum": "SELECT sum(a) FROM dataset", "JOIN": "SELECT a FROM dataset JOIN b", "DISTINCT": "SELECT DISTINCT a FROM dataset", "UNION": "SELECT a FROM dataset UNION SELECT 1",
                       "position": "SELECT a FROM dataset ORDER BY 1", "expression": "SELECT a FROM dataset ORDER BY a + 1", "count": "SELECT count(a) FROM dataset", "aliases": "SELECT a FROM dataset t", "subqueries": "SELECT a FROM (SELECT 1)",
                       "LIMIT": "SELECT count(*) FROM dataset LIMIT 1", "stands alone": "SELECT a, count(*) FROM dataset", "window": "SELECT row_number() OVER () FROM dataset", "tables": "SELECT a FROM dataset, b"}.items():
        with pytest.raises(NotImplementedError, match=word):
            q(text)
    assert select("SELECT a FROM t ORDER BY a LIMIT 1", spark.createDataFrame([(2,), (1,)], "a int"), "t").first()[0] == 1


FILTERS = ["x = 7", "x > 40", "x <= 3 AND s = 'k1'", "x IN (1, 2, 99)", "x BETWEEN 10 AND 12", "x IS NULL", "s = 'k3' OR x = 4", "s IS NULL OR x < 2", "NOT x = 7", "array_has(tags, 'a')", "array_has_any(tags, ['b', 'zz'])",
           "array_has_all(tags, ['a', 'b'])", "tags IS NULL", "contains(s, 'k1')", "x = 7 AND f > 0.5", "5 > x", "x <> 3", "d = DATE '2000-01-05'", "x = -1"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    cols = ["id", "if(id % 10 = 0, null, id * 7919 % 50) AS x", "if(id % 13 = 0, null, concat('k', id * 31 % 9)) AS s", "if(id % 17 = 0, null, if(id % 5 = 0, array(), array('a', if(id % 2 = 0, 'b', null)))) AS tags", "id / 3000 AS f", "date_add(DATE '2000-01-01', cast(id % 80 AS int)) AS d"]
    df = spark.range(3000).selectExpr(*cols)
    t = Table.write(df.where("id < 2500").coalesce(1), str(tmp_path_factory.mktemp("i") / "t"), rows_per_file=900)
    for column, kind in (("x", "BTREE"), ("s", "BITMAP"), ("tags", "LABEL_LIST"), ("d", "ZONEMAP")):
        indexes.create(t, column, kind)
    indexes.create(t, "s", "NGRAM", "grams")
    t.delete("id % 11 = 0")
    t.update({"x": "7"}, "id % 100 = 1")
    t.append(df.where("id >= 2500"))
    return t


@pytest.mark.parametrize("text", FILTERS)
def test_index_is_scan(indexed, text):
    with_index, without = (got(Scan(indexed, columns=["id"], filter=text, use_scalar_index=on).to_df()) for on in (True, False))
    assert with_index == without


def test_index_plans(indexed):
    assert indexes.explain(indexed, "x = 7 AND f > 0.5")["answered"] and not indexes.explain(indexed, "f > 0.5")["answered"]
    assert not indexes.explain(indexed, "x = 7 OR f > 0.5")["answered"] and not indexes.explain(indexed, "NOT x = 7")["answered"]
    assert any(i["uncovered_rows"] for i in indexes.describe(indexed))


def test_overlay_outdates_an_index(spark, root):
    t = Table.write(numbers(spark, 50), root)
    indexes.create(t, "v", "BTREE")
    t.overlay(spark.createDataFrame([(3, 777)], "id long, v long"), on="id")
    assert got(Scan(t, filter="v = 777").to_df()) == [(3, 777)] and got(Scan(t, filter="v = 30").to_df()) == []


def test_stitch_and_distributed_compaction(spark, root, tmp_path):
    a, b = Table.write(numbers(spark, 5), str(tmp_path / "a")), Table.write(numbers(spark, 5, 5), str(tmp_path / "b"))
    t = stitch(spark, [a.root, b.root], root)
    assert got(t.to_df()) == got(numbers(spark, 10))
    tasks = compact.plan(t, 100)
    done = [compact.execute(Table(spark, root), x) for x in tasks]
    assert compact.commit(t, done)["fragments_removed"] == 2 and got(t.to_df()) == got(numbers(spark, 10))


def test_settings(spark, root):
    t = Table.write(numbers(spark, 2), root)
    t.config({"primary_key": "id"}).config({"note": "x"}, "metadata").field_metadata("v", {"unit": "m"})
    assert t.schema["v"].metadata == {"unit": "m"} and t.manifest.metadata == {"note": "x"}
    t.merge_insert().when_matched_update_all().execute(numbers(spark, 1))
    assert json.loads(t.manifest.dumps())["config"] == {"primary_key": "id"} and {r["field"] for r in t.data_stats()} == {"id", "v"}
    with pytest.raises(FileExistsError):
        Table.write(numbers(spark, 1), root)

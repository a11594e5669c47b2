"""Stages drop rows, not ids; hot keys are split; the edges: nulls, repeats, ties, clashing names, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import decontaminate, exact_dedup, quality, rows, simhash

WORDS = [f"w{k}" for k in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


A, B, C = prose(60, 1), prose(60, 2), prose(40, 3)
SCHEMA = "doc_id long, text string, __drop int, keep_id string, tkey int, gone boolean, m map<string,int>"


def table(spark, items):
    return spark.createDataFrame([(i, t, k, "k", 7, True, {"a": k}) for k, (i, t) in enumerate(items)], SCHEMA).repartition(3)


def left(df):
    return sorted(r["__drop"] for r in df.collect())


@pytest.mark.parametrize("stage", [exact_dedup.keep_first, simhash.keep_one])
def test_stages_drop_rows_not_ids(spark, stage):
    items = [(1, A), (2, A), (2, B), (None, A), (None, C), (None, C), (3, C.upper() if stage is simhash.keep_one else C), (4, None), (5, ""), (6, prose(50, 9)), (6, prose(50, 9)), (None, prose(30, 8)), (7, prose(30_000, 4))]
    out = stage(table(spark, items))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    kept = left(out)
    assert [k for k in kept if k not in (9, 10)] == [0, 2, 6, 7, 11, 12] and len([k for k in kept if k in (9, 10)]) == 1
    assert stage(out.limit(0)).count() == 0


def test_rows_without_an_id_alone(spark):
    items = [(None, A), (None, A), (None, A)]
    assert len(left(exact_dedup.keep_first(table(spark, items)))) == 1 and len(left(simhash.keep_one(table(spark, items)))) == 1
    both = [(5, None), (5, ""), (5, None)]
    assert len(left(exact_dedup.keep_first(table(spark, both)))) == 1 and len(left(simhash.keep_one(table(spark, both)))) == 1


def test_drop_leaks_drops_rows(spark):
    item = "a train leaves Boston at 40 km per hour and meets another one from Denver after three long hours of driving"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    items = [(1, A), (1, f"{B} {item}"), (None, item), (None, C), (2, item.upper()), (2, item.upper()), (3, None), (4, "")]
    out = decontaminate.drop_leaks(table(spark, items), bench)
    assert left(out) == [0, 3, 6, 7]
    assert left(decontaminate.drop_leaks(table(spark, items), bench.limit(0))) == list(range(8)) and decontaminate.drop_leaks(out.limit(0), bench).count() == 0


def test_keep_good_keeps_columns_and_rows(spark):
    good = [(k, ". ".join(prose(9, k + j).capitalize() for j in range(6)) + ".") for k in range(150)]
    bad = [(1000 + k, "BUY!!! $$$ " * (3 + k % 20)) for k in range(150)]
    items = good + bad + [(None, good[0][1]), (0, bad[0][1]), (5000, None), (5001, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, items)
    # Id 0 stands for two texts: training may see both, the verdict is each row's own.
    kept = left(quality.keep_good(docs, labels))
    assert set(kept) >= set(range(150)) | {300} and not set(kept) & (set(range(150, 300)) | {301})
    assert quality.keep_good(docs.limit(0), labels).count() == 0 and len(left(quality.keep_good(docs, labels.limit(0)))) == len(items)


def test_join_counted_splits_hot_keys(spark):
    few = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    right = few.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("k % 5 <> 2").withColumn("v", F.col("k") * 10)
    got = {(r.n, r.k, r.v) for r in rows.join_counted(few, right, ["k"], "size", F.col("n")).collect()}
    assert got == {(r.n, r.k, r.v) for r in few.join(right, "k", "left").collect()} and len(got) == 3000
    inner = rows.join_counted(few, right, ["k"], "size", F.col("n"), "inner")
    assert inner.columns == ["n", "k", "v"] and inner.count() == few.join(right, "k").count()
    assert rows.join_counted(few.limit(0), right, ["k"], "size", F.col("n")).count() == 0

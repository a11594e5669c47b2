import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["scan_filter_topk", "filter_three_valued", "sql_select", "knn_l2", "near_dup_clusters", "fts_boolean", "merge_upsert", "index_and_or", "asof_join", "ndjson_routes"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "saved"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.QUERIES) > 80


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_is_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert mine == sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())

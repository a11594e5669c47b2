"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from brindle.functions import analyzer
from brindle.operators import fts, joins, sample, shard, vector
from brindle.operators.scan import Ordering, Scan, slice_rows, take
from brindle.plans import indexes
from brindle.plans import sql as select
from brindle.session import shared_dir
from brindle.sources import ingest
from brindle.sources.table import Table, stitch
from brindle.streaming import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned(name: str, table: str, sql: str, **how) -> None:
    """A query that is one scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Scan(load(spark, sf_dir, table), **how).to_df()

    QUERIES[name], ORACLE[name] = run, sql


def versioned(df: DataFrame, **how) -> Table:
    """A versioned table of df in the shared folder."""
    return Table.write(df, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}", **how)


_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable):
    """What make() gives, made once a session: the set-up of queries that only read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


# -- projection, filters, expressions -------------------------------------------------------------------------

scanned(
    "scan_filter_topk", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS saved FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 "
    "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 1000",
    columns={"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "saved": "l_extendedprice * l_discount"},
    filter="l_shipdate >= DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", limit=1000, row_key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
scanned("scan_project_rename", "customer", "SELECT c_custkey AS id, c_name AS \"Name\", c_acctbal * 2 AS twice, c_acctbal > 0 AS pos FROM customer",
        columns={"id": "C_CUSTKEY", "Name": "c_name", "twice": "c_acctbal * 2", "pos": "c_acctbal > 0"})
scanned("filter_compare", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' OR o_orderkey <= 10",
        columns=["o_orderkey", "o_totalprice"], filter="o_totalprice > 100000 AND o_orderstatus != 'F' OR o_orderkey <= 10")
scanned("filter_between", "part", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT p_retailprice BETWEEN 1000 AND 1200",
        columns=["p_partkey", "p_size"], filter="p_size BETWEEN 10 AND 20 AND NOT p_retailprice BETWEEN 1000 AND 1200")
scanned("filter_like", "part", r"SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%_E%' AND p_name NOT LIKE '%q' ", columns=["p_partkey", "p_type"], filter="p_type LIKE '%_E%' AND p_name NOT LIKE '%q'")
scanned("filter_ilike", "documents", "SELECT doc_id FROM documents WHERE text ILIKE '%LICENSE%'", columns=["doc_id"], filter="text ILIKE '%LICENSE%'")
scanned("filter_regexp", "documents", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ [0-9]{2,}')", columns=["doc_id", "lang"], filter="regexp_like(text, '[A-Z][a-z]+ [0-9]{2,}')")
scanned("filter_in", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F')", columns=["o_orderkey"],
        filter="o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F')")
scanned("filter_temporal", "orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-07-01'", columns=["o_orderkey", "o_orderdate"],
        filter="o_orderdate >= '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-07-01'")
scanned("expr_arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_orderkey * 3 - l_linenumber AS n, -l_quantity AS q FROM lineitem",
        columns={"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "n": "l_orderkey * 3 - l_linenumber", "q": "-l_quantity"})
scanned("expr_int_div_mod", "orders", "SELECT o_orderkey, (o_orderkey - 500) // 7 AS d, (o_orderkey - 500) % 7 AS m FROM orders", columns={"o_orderkey": "o_orderkey", "d": "(o_orderkey - 500) / 7", "m": "(o_orderkey - 500) % 7"})
ORACLE["expr_int_div_mod"] = "SELECT o_orderkey, CAST(trunc((o_orderkey - 500) / 7) AS BIGINT) AS d, (o_orderkey - 500) % 7 AS m FROM orders"
scanned("expr_float_division", "customer", "SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN CASE WHEN c_acctbal > 0 THEN 'Infinity' WHEN c_acctbal < 0 THEN '-Infinity' ELSE 'NaN' END ELSE 'finite' END AS kind FROM customer",
        columns={"c_custkey": "c_custkey", "r": "c_acctbal / (c_nationkey % 5)"})
_divided = QUERIES["expr_float_division"]
QUERIES["expr_float_division"] = lambda spark, sf_dir: _divided(spark, sf_dir).select("c_custkey", F.when(F.col("r").isin(float("inf"), float("-inf")) | F.isnan("r"), F.col("r").cast("string")).otherwise("finite").alias("kind"))
scanned("expr_cast", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_orderkey AS VARCHAR) AS s, CAST(l_linenumber AS DOUBLE) AS f, l_linenumber <> 0 AS b FROM lineitem",
        columns={"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "whole": "CAST(l_extendedprice AS BIGINT)", "s": "l_orderkey::varchar", "f": "arrow_cast(l_linenumber, 'Float64')", "b": "cast(l_linenumber as boolean)"})
scanned("expr_concat", "customer", "SELECT c_custkey, c_name || '/' || c_mktsegment || '/' || c_custkey AS label FROM customer", columns={"c_custkey": "c_custkey", "label": "c_name || '/' || c_mktsegment || '/' || c_custkey"})
scanned("expr_coalesce_abs", "customer", "SELECT c_custkey, abs(c_acctbal) AS a, coalesce(NULL, c_mktsegment, 'none') AS seg FROM customer", columns={"c_custkey": "c_custkey", "a": "abs(c_acctbal)", "seg": "coalesce(NULL, c_mktsegment, 'none')"})
scanned("expr_string_fns", "documents", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, upper(lang) AS u, lower(source) AS l, starts_with(text, 'T') AS s, ends_with(text, '.') AS e, contains(text, 'the') AS c FROM documents",
        columns={"doc_id": "doc_id", "n": "length(text)", "u": "upper(lang)", "l": "lower(source)", "s": "starts_with(text, 'T')", "e": "ends_with(text, '.')", "c": "contains(text, 'the')"})
scanned("expr_temporal_diff", "orders", "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders",
        columns={"o_orderkey": "o_orderkey", "days": "CAST(o_orderdate AS DATE) - DATE '1995-01-01'"})
scanned("json_get_int", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50", columns={"event_id": "event_id", "k": "json_get_int(props, 'k')"}, filter="json_get_int(props, 'k') > 50")
scanned("json_extract", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS t FROM events", columns={"event_id": "event_id", "t": "json_extract(props, '$.k')"})
scanned("json_exists", "events", "SELECT event_id, json_exists(props, '$.k') AS has, json_exists(props, '$.zz') AS none FROM events", columns={"event_id": "event_id", "has": "json_exists(props, '$.k')", "none": "json_exists(props, '$.zz')"})


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("kind"), F.expr("if(event_id % 7 = 0, null, value)").alias("x"), F.expr("if(event_id % 3 = 0, null, event_id % 2 = 0)").alias("flag"))


_NULLS = "(SELECT event_id, nullif(event_type, 'view') AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS flag FROM events)"


@query(f"SELECT event_id FROM {_NULLS} WHERE NOT (kind = 'click' AND x > 50) OR flag")
def filter_three_valued(spark, sf_dir):
    return Scan(_with_nulls(spark, sf_dir), columns=["event_id"], filter="NOT (kind = 'click' AND x > 50) OR flag").to_df()


@query(f"SELECT event_id, kind IN ('click', 'error', NULL) AS a, kind NOT IN ('click') AS b FROM {_NULLS}")
def filter_in_null(spark, sf_dir):
    return Scan(_with_nulls(spark, sf_dir), columns={"event_id": "event_id", "a": "kind IN ('click', 'error', NULL)", "b": "kind NOT IN ('click')"}).to_df()


@query(f"SELECT event_id, flag IS TRUE AS t, flag IS NOT FALSE AS nf, flag IS NULL AS n, kind IS NOT NULL AS k FROM {_NULLS} WHERE flag IS NOT TRUE")
def filter_is_true(spark, sf_dir):
    return Scan(_with_nulls(spark, sf_dir), columns={"event_id": "event_id", "t": "flag IS TRUE", "nf": "flag IS NOT FALSE", "n": "is_null(flag)", "k": "is_valid(kind)"}, filter="flag IS NOT TRUE").to_df()


@query(f"SELECT event_id, CASE WHEN event_id IS NULL OR x IS NULL THEN NULL ELSE 50 BETWEEN event_id AND x END AS b FROM {_NULLS}")
def between_null_bound(spark, sf_dir):
    return Scan(_with_nulls(spark, sf_dir), columns={"event_id": "event_id", "b": "50 BETWEEN event_id AND x"}).to_df()


def _with_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))


_LISTS = "(SELECT p_partkey, string_split(p_name, ' ') AS tags FROM part)"
for _name, _text, _sql in (
    ("list_has", "array_has(tags, 'red')", "list_contains(tags, 'red')"),
    ("list_has_any", "list_has_any(tags, ['bolt', 'gear'])", "list_has_any(tags, ['bolt', 'gear'])"),
    ("list_has_all", "array_has_all(tags, ['bolt', 'blue'])", "list_has_all(tags, ['bolt', 'blue'])"),
    ("list_index", "tags[1] || tags[-1] = 'redgear' OR tags[9] IS NOT NULL", "tags[1] || tags[-1] = 'redgear' OR tags[9] IS NOT NULL"),
):
    QUERIES[_name] = lambda spark, sf_dir, t=_text: Scan(_with_lists(spark, sf_dir), columns={"p_partkey": "p_partkey", "hit": t}).to_df()
    ORACLE[_name] = f"SELECT p_partkey, {_sql} AS hit FROM {_LISTS}"


# -- order, ranges, counts, SELECT ----------------------------------------------------------------------------


@query(f"SELECT event_id, kind, x FROM {_NULLS} ORDER BY kind DESC NULLS LAST, x ASC NULLS FIRST, event_id LIMIT 200 OFFSET 1500")
def orderby_nulls_limit_offset(spark, sf_dir):
    return Scan(_with_nulls(spark, sf_dir), columns=["event_id", "kind", "x"], order_by=[Ordering("kind", False), Ordering("x", True, True)], limit=200, offset=1500, row_key="event_id").to_df()


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_partkey, l_linenumber LIMIT 50")
def topk_stable(spark, sf_dir):
    return Scan(load(spark, sf_dir, "lineitem"), columns=["l_orderkey", "l_partkey", "l_quantity"], order_by=[Ordering("l_quantity", False)], limit=50, row_key=["l_orderkey", "l_partkey", "l_linenumber"]).to_df()


@query("SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'")
def count_star_filter(spark, sf_dir):
    return select.run("SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'", load(spark, sf_dir, "lineitem"), "lineitem")


@query("SELECT o_orderkey AS id, o_totalprice / 2 AS half, upper(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 50000 AND 150000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 20")
def sql_select(spark, sf_dir):
    text = "select o_orderkey AS id, o_totalprice / 2 AS half, UPPER(o_orderpriority) p FROM Orders WHERE O_ORDERSTATUS = 'O' AND o_totalprice BETWEEN 50000 AND 150000 ORDER BY o_totalprice DESC, id LIMIT 100 OFFSET 20;"
    return select.run(text, load(spark, sf_dir, "orders"), "orders", row_key="o_orderkey")


@query("SELECT *, c_acctbal + 1 AS more FROM customer WHERE c_acctbal < 0")
def sql_star(spark, sf_dir):
    return select.run("SELECT *, c_acctbal + 1 AS more FROM customer WHERE c_acctbal < 0", load(spark, sf_dir, "customer"), "customer")


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """One file after another in key order, so that row addresses follow the keys."""
    return df.repartitionByRange(4, *keys).sortWithinPartitions(*keys)


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), a AS (SELECT unnest([0, 17, 99, 17, 100, 149]) AS p) SELECT o_orderkey, o_totalprice FROM a JOIN o ON r = p")
def take_positions(spark, sf_dir):
    return take(versioned(_in_order(load(spark, sf_dir, "orders"), "o_orderkey")), [0, 17, 99, 17, 100, 149], ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 ORDER BY o_orderkey LIMIT 300 OFFSET 100")
def row_range_slice(spark, sf_dir):
    t = versioned(_in_order(load(spark, sf_dir, "orders"), "o_orderkey"))
    t.delete("o_orderkey % 5 = 0")
    return slice_rows(t, 100, 400, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS gone FROM orders WHERE o_orderkey % 3 = 0")
def include_deleted_rows(spark, sf_dir):
    t = versioned(load(spark, sf_dir, "orders"))
    t.delete("o_orderkey % 5 = 0")
    return Scan(t, columns=["o_orderkey"], filter="o_orderkey % 3 = 0", include_deleted_rows=True, with_row_id=True).to_df().select("o_orderkey", F.col("_rowid").isNull().alias("gone"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS \"_rowoffset\" FROM orders WHERE o_orderkey % 4 <> 0")
def system_columns(spark, sf_dir):
    t = versioned(_in_order(load(spark, sf_dir, "orders"), "o_orderkey"))
    t.delete("o_orderkey % 4 = 0")
    return Scan(t, columns=["o_orderkey", "_rowoffset"]).to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000")
def row_address_mask(spark, sf_dir):
    t = versioned(load(spark, sf_dir, "orders"))
    allowed = t.to_df(system=True).where("o_orderpriority = '1-URGENT'").select("_rowaddr")
    return Scan(t, columns=["o_orderkey"], filter="o_totalprice > 1000", row_addr_allowlist=allowed).to_df()


@query("SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || '|' || l_linenumber || '|7'), l_orderkey, l_linenumber) <= 40")
def sample_per_group(spark, sf_dir):
    """40 rows of each group."""
    return sample.per_group(load(spark, sf_dir, "lineitem"), "l_returnflag", 40, ["l_orderkey", "l_linenumber"], seed=7).select("l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT * FROM orders ORDER BY md5(o_orderkey || '|3'), o_orderkey LIMIT 100")
def sample_rows(spark, sf_dir):
    return sample.sample(load(spark, sf_dir, "orders"), 100, ["o_orderkey"], seed=3)


@query("SELECT o_orderkey, CAST(floor(o_orderkey / 64) AS BIGINT) AS \"_batch\" FROM orders WHERE CAST(floor(o_orderkey / 64) AS BIGINT) % 4 = 1")
def sample_sharded_batches(spark, sf_dir):
    return sample.shard_batches(load(spark, sf_dir, "orders"), "o_orderkey", 64, 1, 4).select("o_orderkey", "_batch")


# -- vectors --------------------------------------------------------------------------------------------------

_Q = [round(0.1 * ((k * 7) % 13) - 0.6, 3) for k in range(64)]
_QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"
_E = "embedding::DOUBLE[]"
_DIST = {
    "l2": f"list_sum(list_transform(list_zip({_E}, {_QSQL}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))",
    "cosine": f"1 - list_dot_product({_E}, {_QSQL}) / sqrt(list_dot_product({_E}, {_E})) / sqrt(list_dot_product({_QSQL}, {_QSQL}))",
    "dot": f"1 - list_dot_product({_E}, {_QSQL})",
}


def _knn(metric: str, **more):
    how = {"columns": ["vec_id", "label"], "row_key": "vec_id", "prefilter": True} | {k: v for k, v in more.items() if k in ("filter", "prefilter", "limit", "offset")}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = {"column": "embedding", "q": _Q, "k": more.get("k", 20), "metric": metric} | ({"distance_range": more["range"]} if "range" in more else {})
        return Scan(load(spark, sf_dir, "embeddings"), nearest=spec, **how).to_df().withColumn("_distance", F.round("_distance", 6))

    return run


for _m, _d in _DIST.items():
    QUERIES[f"knn_{_m}"] = _knn(_m)
    ORACLE[f"knn_{_m}"] = f"SELECT vec_id, label, round(d, 6) AS \"_distance\" FROM (SELECT *, {_d} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 20"
QUERIES["knn_prefilter"] = _knn("l2", filter="label IN (1, 3)")
ORACLE["knn_prefilter"] = f"SELECT vec_id, label, round(d, 6) AS \"_distance\" FROM (SELECT *, {_DIST['l2']} AS d FROM embeddings) WHERE label IN (1, 3) ORDER BY d, vec_id LIMIT 20"
QUERIES["knn_postfilter"] = _knn("l2", filter="label IN (1, 3)", prefilter=False, k=100)
ORACLE["knn_postfilter"] = f"SELECT vec_id, label, round(d, 6) AS \"_distance\" FROM (SELECT *, {_DIST['l2']} AS d FROM embeddings ORDER BY d, vec_id LIMIT 100) WHERE label IN (1, 3)"
QUERIES["knn_distance_range"] = _knn("cosine", k=100, range=(0.9, 1.0))
ORACLE["knn_distance_range"] = f"SELECT vec_id, label, round(d, 6) AS \"_distance\" FROM (SELECT *, {_DIST['cosine']} AS d FROM embeddings) WHERE d >= 0.9 AND d < 1.0 ORDER BY d, vec_id LIMIT 100"


@query("WITH p AS (SELECT q.vec_id AS query, e.vec_id, list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d "
       "FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM p) "
       "SELECT query, vec_id, round(d, 6) AS \"_distance\", rank::INTEGER AS rank FROM r WHERE rank <= 10")
def knn_batch(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings")
    got = vector.nearest_rows(df, df.where("vec_id % 100 = 0"), "embedding", "vec_id")
    return got.withColumn("_distance", F.round("_distance", 6))


@query(f"WITH v AS (SELECT label, vec_id // 4 AS g, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT g, q.i, min(list_sum(list_transform(list_zip(e, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS m "
       f"FROM v, (SELECT 0 AS i, {_QSQL} AS v UNION ALL SELECT 1, list_reverse({_QSQL})) q GROUP BY g, q.i) SELECT CAST(g AS BIGINT) AS g, round(sum(m), 6) AS \"_distance\" FROM d GROUP BY g ORDER BY sum(m), g LIMIT 15")
def knn_multivector(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("g")).agg(F.collect_list("embedding").alias("vs"))
    got = vector.nearest(rows, {"column": "vs", "q": [_Q, _Q[::-1]], "k": 15}, "g")
    return got.select("g", F.round("_distance", 6).alias("_distance"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", vector.sign_bits("embedding").alias("bits"))


_BITS = "(SELECT vec_id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS bits FROM embeddings)"


@query(f"WITH b AS {_BITS}, q AS (SELECT bits AS z FROM b ORDER BY vec_id LIMIT 1) SELECT vec_id, bit_count(xor(bits, z))::DOUBLE AS \"_distance\" FROM b, q ORDER BY 2, 1 LIMIT 25")
def hamming_topk(spark, sf_dir):
    rows = _bits(spark, sf_dir).select("vec_id", F.unhex(F.lpad(F.hex("bits"), 16, "0")).alias("b"))
    q = list(rows.orderBy("vec_id").first()["b"])
    return vector.nearest(rows, {"column": "b", "q": q, "k": 25}, "vec_id").select("vec_id", "_distance")


@query(f"WITH RECURSIVE b AS {_BITS}, e AS (SELECT x.vec_id AS u, y.vec_id AS v FROM b x JOIN b y ON bit_count(xor(x.bits, y.bits)) <= 3), "
       "r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS vec_id, min(v) AS component FROM r GROUP BY u")
def near_dup_clusters(spark, sf_dir):
    return vector.hamming_components(_bits(spark, sf_dir), "vec_id", "bits", 3)


@query()
def ivf_search(spark, sf_dir):
    """Every part probed, so the answer is the exact one."""
    index = once(spark, sf_dir, "ivf_search", lambda: vector.IvfIndex.build(versioned(load(spark, sf_dir, "embeddings")), "embedding", partitions=8))
    return index.search({"q": _Q, "k": 20, "nprobes": 8}).select("vec_id", F.round("_distance", 6).alias("_distance"))


ORACLE["ivf_search"] = f"SELECT vec_id, round(d, 6) AS \"_distance\" FROM (SELECT *, {_DIST['l2']} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 20"


@query(f"SELECT vec_id, round(d, 6) AS \"_distance\" FROM (SELECT *, {_DIST['l2']} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 20")
def ivf_sq_refined(spark, sf_dir):
    """Bytes for vectors in every part, and the best 20 of 200 candidates by their own vectors."""
    index = once(spark, sf_dir, "ivf_sq_refined", lambda: vector.IvfIndex.build(versioned(load(spark, sf_dir, "embeddings")), "embedding", partitions=8, kind="IVF_SQ"))
    return index.search({"q": _Q, "k": 20, "nprobes": 8, "refine_factor": 10}).select("vec_id", F.round("_distance", 6).alias("_distance"))


# -- full text ------------------------------------------------------------------------------------------------

_TERMS = {"a": "license", "b": "data", "c": "version"}


def _postings(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    words = f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{Nl}}\\p{{N}}]+'), lambda w: strlen(w) < 40)"
    return f"d AS (SELECT {key} AS id, {words} AS w FROM {table}), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d)"


def _bm25(term: str) -> str:
    f = f"len(list_filter(w, lambda x: x = '{term}'))"
    df = f"(SELECT count(*) FROM d WHERE list_contains(w, '{term}'))"
    return f"(CASE WHEN {f} > 0 THEN ln((n - {df} + 0.5) / ({df} + 0.5) + 1) * 2.2 * {f} / ({f} + 1.2 * (0.25 + 0.75 * len(w) / a)) ELSE 0 END)"


_HAS = lambda t: f"list_contains(w, '{t}')"


def _fts(name: str, q: fts.Query, where: str, score: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fts.search(load(spark, sf_dir, "documents"), q, key="doc_id").select("doc_id", F.round("_score", 6).alias("_score"))

    QUERIES[name] = run
    ORACLE[name] = f"WITH {_postings()} SELECT id AS doc_id, round({score}, 6) AS \"_score\" FROM d, s WHERE {where}"


_M = fts.MatchQuery
_fts("fts_match_or", _M("license data", "text"), f"{_HAS('license')} OR {_HAS('data')}", f"{_bm25('license')} + {_bm25('data')}")
_fts("fts_match_and", _M("License version", "text", operator="and", boost=2.0), f"{_HAS('license')} AND {_HAS('version')}", f"({_bm25('license')} + {_bm25('version')}) * 2")
_PHRASE = "len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license')) > 0"
_fts("fts_phrase", fts.PhraseQuery("mit license", "text"), f"len(w) > 1 AND {_PHRASE}", f"{_bm25('mit')} + {_bm25('license')}")
_fts("fts_boolean", fts.BooleanQuery([("must", _M("license", "text")), ("should", _M("version", "text")), ("must_not", _M("mit", "text"))]), f"{_HAS('license')} AND NOT {_HAS('mit')}", f"{_bm25('license')} + {_bm25('version')}")
_fts("fts_boost", fts.BoostQuery(_M("license", "text"), _M("version", "text"), 0.25), _HAS("license"), f"{_bm25('license')} - 0.25 * {_bm25('version')}")


@query(f"WITH {_postings()}, r AS (SELECT id AS doc_id, {_bm25('license')} AS x FROM d, s WHERE {_HAS('license')}) SELECT doc_id, round(x, 6) AS \"_score\" FROM r ORDER BY x DESC, doc_id LIMIT 10")
def fts_topk(spark, sf_dir):
    return Scan(load(spark, sf_dir, "documents"), columns=["doc_id"], full_text_query=_M("license", "text"), limit=10, row_key="doc_id").to_df().select("doc_id", F.round("_score", 6).alias("_score"))


@query(f"WITH {_postings('pages', 'page_id', 'url')}, t AS (SELECT page_id, lower(html) AS html FROM pages), h AS ({'SELECT page_id AS id, list_filter(regexp_extract_all(lower(html), ' + chr(39) + '[\\p{L}\\p{M}\\p{Nl}\\p{N}]+' + chr(39) + '), lambda w: strlen(w) < 40) AS w FROM pages'}), "
       "g AS (SELECT count(*) AS n, avg(len(w)) AS a FROM h), u AS (SELECT id, CASE WHEN list_contains(w, 'com') THEN ln((n - (SELECT count(*) FROM d WHERE list_contains(w, 'com')) + 0.5) / ((SELECT count(*) FROM d WHERE list_contains(w, 'com')) + 0.5) + 1) * 2.2 * len(list_filter(w, lambda x: x = 'com')) / (len(list_filter(w, lambda x: x = 'com')) + 1.2 * (0.25 + 0.75 * len(w) / a)) END AS x FROM d, s), "
       "v AS (SELECT id, CASE WHEN list_contains(w, 'com') THEN ln((n - (SELECT count(*) FROM h WHERE list_contains(w, 'com')) + 0.5) / ((SELECT count(*) FROM h WHERE list_contains(w, 'com')) + 0.5) + 1) * 2.2 * len(list_filter(w, lambda x: x = 'com')) / (len(list_filter(w, lambda x: x = 'com')) + 1.2 * (0.25 + 0.75 * len(w) / a)) END AS x FROM h, g) "
       "SELECT id AS page_id, round(greatest(u.x, 2 * v.x), 6) AS \"_score\" FROM u JOIN v USING (id) WHERE u.x IS NOT NULL OR v.x IS NOT NULL")
def fts_multimatch(spark, sf_dir):
    q = fts.MultiMatchQuery("com", ["url", "html"], [1.0, 2.0])
    return fts.search(load(spark, sf_dir, "pages"), q).select("page_id", F.round("_score", 6).alias("_score"))


_FUZZY = "ln((n - k.df + 0.5) / (k.df + 0.5) + 1) * 2.2 * f / (f + 1.2 * (0.25 + 0.75 * l / a))"


@query(f"WITH {_postings()}, p AS (SELECT id, x, count(*) AS f, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS x FROM d) GROUP BY id, x), "
       "k AS (SELECT x, count(*) AS df FROM p WHERE levenshtein(x, 'licence') <= 1 AND starts_with(x, 'lic') GROUP BY x ORDER BY x LIMIT 50) "
       f"SELECT id AS doc_id, round(sum({_FUZZY}), 6) AS \"_score\" FROM p JOIN k USING (x), s GROUP BY id")
def fts_fuzzy(spark, sf_dir):
    return fts.search(load(spark, sf_dir, "documents"), _M("licence", "text", fuzziness=1, prefix_length=3)).select("doc_id", F.round("_score", 6).alias("_score"))


@query(f"WITH {_postings()}, r AS (SELECT id AS doc_id, {_bm25('license')} + {_bm25('data')} AS x FROM d, s WHERE {_HAS('license')} OR {_HAS('data')}) SELECT doc_id, round(x, 6) AS \"_score\" FROM r ORDER BY x DESC, doc_id LIMIT 25")
def fts_postings(spark, sf_dir):
    """The best 25 by an index of postings over half of the documents and a scan of the other half, appended later."""
    def make() -> fts.TextIndex:
        docs = load(spark, sf_dir, "documents").select("doc_id", "text")
        half = docs.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0]
        df = docs.orderBy("doc_id")  # files are numbered in this order, so row ids are too
        t = versioned(df.where(F.col("doc_id") <= half))
        index = fts.TextIndex.build(t, "text", **{k: v for k, v in analyzer.PLAIN.__dict__.items()})
        return fts.TextIndex(t.append(df.where(F.col("doc_id") > half)), index.entry)

    return once(spark, sf_dir, "fts_postings", make).search(_M("license data", "text"), 25).select("doc_id", F.round("_score", 6).alias("_score"))


@query()
def fts_index(spark, sf_dir):
    """An index with stemming, stop words and folding; documents appended after it are found too."""
    df = load(spark, sf_dir, "documents")
    t = versioned(df.where("doc_id % 2 = 0"))
    index = fts.TextIndex.build(t, "text", with_position=True)
    t.append(df.where("doc_id % 2 = 1"))
    return fts.TextIndex(t, index.entry).search(_M("licenses", "text")).select("doc_id", F.round("_score", 6).alias("_score"))


# -- table operations -----------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@query(f"{_O} WHERE NOT (o_totalprice > 150000 OR o_orderkey % 10 = 3)")
def delete_apply(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.delete("o_totalprice > 150000 OR o_orderkey % 10 = 3")
    return t.to_df()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 + o_custkey ELSE o_totalprice END AS o_totalprice FROM orders")
def update_set(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.update({"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2 + o_custkey"}, "o_orderkey % 4 = 0")
    return t.to_df()


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir).where("o_orderkey % 5 = 0")
    far = df.select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return df.withColumns({"o_orderstatus": F.lit("M"), "o_totalprice": F.col("o_totalprice") - 1000}).unionByName(far)


_S = f"(SELECT o_orderkey, o_custkey, 'M' AS o_orderstatus, o_totalprice - 1000 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0)"
_N = "SELECT o_orderkey + 100000000 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0"


@query(f"{_O} WHERE o_orderkey % 5 <> 0 UNION ALL SELECT * FROM {_S} UNION ALL {_N}")
def merge_upsert(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.merge_insert("o_orderkey").when_matched_update_all().when_not_matched_insert_all().execute(_source(spark, sf_dir))
    return t.to_df()


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 AND o_totalprice - 1000 > 90000 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, "
       "CASE WHEN o_orderkey % 5 = 0 AND o_totalprice - 1000 > 90000 THEN o_totalprice - 1000 ELSE o_totalprice END AS o_totalprice FROM orders")
def merge_conditional(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.merge_insert("o_orderkey").when_matched_update_all("source.o_totalprice > 90000 AND target.o_custkey >= 0").execute(_source(spark, sf_dir))
    return t.to_df()


@query(f"SELECT * FROM {_S} UNION ALL {_O} WHERE o_orderkey % 5 <> 0 AND NOT o_totalprice > 100000")
def merge_delete_by_source(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.merge_insert("o_orderkey").when_matched_update_all().when_not_matched_by_source_delete("o_totalprice > 100000").execute(_source(spark, sf_dir))
    return t.to_df()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def merge_rewrite_columns(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    part = _orders(spark, sf_dir).where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(-1.0).alias("o_totalprice"))
    t.merge_insert("o_orderkey").when_matched_update_all().rewrite_columns().execute(part)
    return t.to_df()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_totalprice * 0.1 AS tax, o_orderstatus || '!' AS mark, NULL::VARCHAR AS note FROM orders")
def add_columns_sql(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.add_columns({"tax": "o_totalprice * 0.1", "mark": "o_orderstatus || '!'"})
    t.add_columns(T.StructType([T.StructField("note", T.StringType())]))
    return t.to_df()


@query("SELECT o_orderkey::INTEGER AS key, o_custkey, o_totalprice FROM orders")
def alter_and_drop_columns(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.alter_columns({"path": "o_orderkey", "name": "key", "data_type": "int"})
    t.drop_columns(["o_orderstatus"])
    return t.to_df()


@query("WITH r AS (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem GROUP BY 1) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, last AS lines FROM orders LEFT JOIN r ON o_orderkey = l_orderkey")
def merge_left_join(spark, sf_dir):
    right = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("lines"))
    return versioned(_orders(spark, sf_dir)).merge(right, "o_orderkey", "l_orderkey").to_df()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 8 = 0 THEN 5.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def overlay_patch(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.overlay(_orders(spark, sf_dir).where("o_orderkey % 8 = 0").select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.lit(5.0).alias("o_totalprice")), on="o_orderkey")
    return t.to_df()


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def compact_files(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir), rows_per_file=4000)
    t.delete("o_orderkey % 3 = 0")
    t.update({"o_totalprice": "o_totalprice + 1"}, "o_orderkey % 2 = 0")
    t.compact()
    return t.to_df()


@query(f"SELECT 1 AS version, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 3, count(*) + 25 FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 4, count(*) FROM orders")
def time_travel(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    t.delete("o_orderkey % 2 = 0")
    t.append(_orders(spark, sf_dir).orderBy("o_orderkey").limit(25))
    t.checkout(1).restore()
    parts = [t.checkout(v).to_df().agg(F.lit(v).alias("version"), F.count("*").alias("n")) for v in (1, 2, 3, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT o_orderkey, 'insert' AS kind FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, 'update' FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE o_orderkey % 10 = 3")
def delta_changes(spark, sf_dir):
    df = _orders(spark, sf_dir)
    t = versioned(df.where("o_orderkey % 10 <> 1"), stable_row_ids=True)
    begin = t.version
    t.append(df.where("o_orderkey % 10 = 1"))
    t.update({"o_totalprice": "0.0"}, "o_orderkey % 10 = 2")
    t.delete("o_orderkey % 10 = 3")
    d = t.delta(begin)
    gone = t.checkout(begin).to_df(system=True).join(d.deleted_row_ids(), "_rowid").select("o_orderkey", F.lit("delete").alias("kind"))
    return d.inserted().select("o_orderkey", F.lit("insert").alias("kind")).unionByName(d.updated().select("o_orderkey", F.lit("update").alias("kind"))).unionByName(gone)


@query(f"{_O} WHERE o_orderkey % 2 = 0 UNION ALL {_O} WHERE o_orderkey % 4 = 1")
def stitch_union(spark, sf_dir):
    df = _orders(spark, sf_dir)
    a, b = versioned(df.where("o_orderkey % 2 = 0")), versioned(df.where("o_orderkey % 4 = 1"))
    return stitch(spark, [a.root, b.root], f"{shared_dir(spark)}/table-{uuid.uuid4().hex}").to_df()


@query("SELECT 'main' AS at, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'branch', count(*) FROM orders WHERE o_orderkey > 100 UNION ALL SELECT 'clone', count(*) FROM orders")
def branches_and_clones(spark, sf_dir):
    t = versioned(_orders(spark, sf_dir))
    b = t.create_branch("work")
    b.delete("o_orderkey <= 100")
    c = t.clone(f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    parts = [x.to_df().agg(F.lit(n).alias("at"), F.count("*").alias("n")) for n, x in (("main", t), ("branch", b), ("clone", c))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def shard_buckets(spark, sf_dir):
    return shard.shard(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), [shard.ShardField("b", "bucket", "o_orderkey", 16), shard.ShardField("p", "bucket", "o_orderpriority", 4), shard.ShardField("all", "unsharded")])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_totalprice * 2 AS twice FROM orders")
def batch_udf_column(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    from brindle.functions.udf import batch_udf

    @batch_udf("twice double")
    def twice(batch):
        return pa.RecordBatch.from_arrays([pc.multiply(batch.column("o_totalprice"), 2.0)], names=["twice"])

    return twice.add_to(versioned(_orders(spark, sf_dir)), ["o_totalprice"]).to_df()


# -- indexes --------------------------------------------------------------------------------------------------


def _indexed(name: str, kind: str, column: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def make() -> Table:
            df = load(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))
            t = versioned(df.where("p_partkey % 3 <> 0"), rows_per_file=700)
            for c, k in zip(column.split(","), kind.split(","), strict=True):
                indexes.create(t, c, k)
            return t.append(df.where("p_partkey % 3 = 0"))

        return Scan(once(spark, sf_dir, name, make), columns=["p_partkey", "p_size"], filter=text).to_df()

    QUERIES[name], ORACLE[name] = run, f"SELECT p_partkey, p_size FROM part WHERE {sql}"


_indexed("index_btree", "BTREE", "p_size", "p_size BETWEEN 5 AND 9 AND p_retailprice > 910", "p_size BETWEEN 5 AND 9 AND p_retailprice > 910")
_indexed("index_and_or", "BTREE,BITMAP", "p_size,p_brand", "(p_size = 5 OR p_brand = 'Brand#12') AND NOT p_size = 50", "(p_size = 5 OR p_brand = 'Brand#12') AND p_size <> 50")
_indexed("index_zonemap", "ZONEMAP", "p_partkey", "p_partkey > 150 AND p_partkey < 600", "p_partkey > 150 AND p_partkey < 600")
_indexed("index_bloom", "BLOOMFILTER", "p_brand", "p_brand IN ('Brand#13', 'Brand#99')", "p_brand IN ('Brand#13', 'Brand#99')")
_indexed("index_label_list", "LABEL_LIST", "tags", "array_has_all(tags, ['red', 'bolt'])", "contains(p_name, 'red') AND contains(p_name, 'bolt')")
_indexed("index_ngram", "NGRAM", "p_name", "contains(p_name, 'ue bol')", "contains(p_name, 'ue bol')")


@query("SELECT event_id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7 OR CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 90 AND 95")
def index_json(spark, sf_dir):
    def make() -> Table:
        t = versioned(load(spark, sf_dir, "events"), rows_per_file=2000)
        indexes.create(t, "props", "JSON", path="$.k")
        return t

    t = once(spark, sf_dir, "index_json", make)
    return Scan(t, columns=["event_id", "event_type"], filter="json_get_int(props, 'k') = 7 OR json_get_int(props, 'k') BETWEEN 90 AND 95").to_df()


@query("SELECT count(*)::BIGINT AS n FROM part WHERE p_partkey % 10 <> 3 AND (p_size BETWEEN 5 AND 9 OR p_brand = 'Brand#12')")
def index_count(spark, sf_dir):
    """Counted from the indexes' side tables and the deletions alone."""
    def make() -> Table:
        t = versioned(load(spark, sf_dir, "part"), rows_per_file=700)
        indexes.create(t, "p_size", "BTREE")
        indexes.create(t, "p_brand", "BITMAP")
        t.delete("p_partkey % 10 = 3")
        return t

    t = once(spark, sf_dir, "index_count", make)
    n = indexes.count(t, "p_size BETWEEN 5 AND 9 OR p_brand = 'Brand#12'")
    return spark.createDataFrame([(n,)], "n long")


# -- ingestion, streaming -------------------------------------------------------------------------------------


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'b,k' WHEN event_id % 3 = 1 THEN 'k' END AS route, CASE WHEN event_id % 3 = 2 THEN 'not JSON' END AS reason, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def ndjson_routes(spark, sf_dir):
    line = F.expr("CASE event_id % 3 WHEN 0 THEN concat('{\"k\": 1, \"b\": ', event_id, '}') WHEN 1 THEN props ELSE concat('oops ', event_id) END")
    lines = load(spark, sf_dir, "events").select(line.alias("value"))
    return ingest.routes(lines).groupBy("route", "reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, value FROM events")
def stream_append(spark, sf_dir):
    """The events as a stream of files, each micro-batch an appended version."""
    df = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    adapters.append_stream(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return Table(spark, f"{at}/table").to_df()


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return adapters.tumbling_counts(load(spark, sf_dir, "events"), "ts", "1 hour", None, "event_type")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
       "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) "
       "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    return adapters.sessions(load(spark, sf_dir, "events"), "ts", "6 hours", "user_id")


# -- what Spark adds: joins, groups, windows, sets ------------------------------------------------------------


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS price, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def returnflag_agg(spark, sf_dir):
    df = Scan(load(spark, sf_dir, "lineitem"), filter="l_shipdate <= DATE '1998-09-02'").to_df()
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey, r FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS r FROM part) WHERE r <= 3")
def rank_parts(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return load(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_brand", "p_partkey", "r")


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def set_operations(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey")).union(t("supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


@query("WITH h AS (SELECT o_custkey AS s, l_suppkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT t FROM h)")
def graph_one_hop(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    customer, supplier = (lambda c: F.concat(F.lit("c"), c)), (lambda c: F.concat(F.lit("s"), c))
    seeds = t("orders").agg(customer(F.min("o_custkey")).alias("node"))
    edges = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(customer("o_custkey").alias("src"), supplier("l_suppkey").alias("dst"))
    return t("supplier").withColumn("node", supplier("s_suppkey")).join(joins.neighbours(seeds, edges), "node", "left_semi").select("s_suppkey", "s_name")


@query("SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_size, -1) AS size, count(*)::BIGINT AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def rollup_parts(spark, sf_dir):
    df = load(spark, sf_dir, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n"))
    return df.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce("p_size", F.lit(-1)).alias("size"), "n")


@query("SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 9000 DAY AS at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.at")
def asof_join(spark, sf_dir):
    """The last order of each user up to an event."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("at"))
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + INTERVAL 9000 DAY").alias("at"), "o_orderkey")
    return joins.join_asof(e, o, "at", ["user_id"], ["o_orderkey"], ties="o_orderkey").select("event_id", "o_orderkey")




import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import json_path
from brindle.functions.dialect import DialectError, Unsupported, parse
from brindle.functions.emit import column, condition, like_pattern, to_sql

NAMES = ["alice", "bob", "carol", None, "dave", "Eve", "al%", "frank"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (i, n, i * 0.5, datetime.date(2024, 1, 1 + i), {"a": i * 10}, None if i == 4 else [i, None] if i % 2 else [], '{"k": %d, "a": {"b": [1, 2, null]}, "n": null, "s": "Yes", "f": "2.5", "t": true}' % i)
        for i, n in enumerate(NAMES)
    ]
    return spark.createDataFrame(data, "id long, Name string, x double, d date, s struct<a:int>, l array<long>, j string").cache()


CASES = {
    "id = 3": [3], "NAME == 'bob'": [1], "\"Name\" != 'bob' AND id < 3": [0, 2], "name LIKE 'al\\%'": [6], "name NOT LIKE 'a%'": [1, 2, 4, 5, 7], "name ILIKE 'E%'": [5], "s.a > 40": [5, 6, 7],
    "s['a'] IN (10, 20, NULL)": [1, 2], "s['a'] NOT IN (10, NULL)": [], "id NOT BETWEEN 1 AND 6": [0, 7], "id BETWEEN 9 AND NULL": [], "NOT (id BETWEEN 9 AND NULL)": [], "id IN ()": [],
    "x / 0 > 1": [0, 1, 2, 3, 4, 5, 6, 7], "x % 0 = 1": [], "d >= '2024-01-07'": [6, 7], "d - DATE '2024-01-01' = 3": [3], "array_has(l, 3)": [3], "NOT array_has(l, 3)": [0, 1, 2, 5, 6, 7], "list_has_any(l, [1, 5])": [1, 5],
    "array_has_all(l, [])": [0, 1, 2, 3, 4, 5, 6, 7], "l[1] = 3": [3], "l[-2] = 5": [5], "l[0] = 1": [], "json_get_int(j, 'k') > 5": [6, 7], "json_get_int(j, 'f') = 3 AND id = 0": [0], "json_get_bool(j, 's') AND id = 1": [1],
    "json_get_float(j, 't') = 1.0 AND id < 2": [0, 1], "json_get_string(j, 'n') IS NULL AND id = 2": [2], "json_exists(j, '$.n') AND id = 0": [0], "json_exists(j, '$.zz')": [], "json_extract(j, '$.a.b[*]') = '1' AND id = 3": [3],
    "json_array_length(j, '$.a.b') = 3 AND id = 1": [1], "json_array_contains(j, '$.a.b', '2') AND id = 1": [1], "regexp_like(name, '^A', 'i')": [0, 6], "regexp_match(name, 'o')": [1, 2], "length(name) = 3": [1, 5, 6],
    "name || '!' = 'bob!'": [1], "CAST(x AS int) = 1": [2, 3], "x::bigint = 1": [2, 3], "coalesce(name, 'zz') = 'zz'": [3], "-id = -2": [2], "(id - 4) / 3 = -1": [0, 1], "(id - 4) % 3 = -1": [0, 3], "starts_with(name, 'f') OR ends_with(name, 'e')": [0, 4, 5, 7],
    "is_null(name) OR contains(name, '%')": [3, 6], "name IS NOT NULL AND NOT (x > 1)": [0, 1, 2], "(x > 1) IS NOT TRUE": [0, 1, 2], "add(id, 1) = 3": [2], "invert(id > 0)": [0], "abs(id - 5) <= 1": [4, 5, 6], "upper(name) = 'EVE'": [5],
}


@pytest.mark.parametrize("text", CASES)
def test_filters(rows, text):
    assert sorted(r.id for r in rows.where(condition(text, rows.schema)).select("id").collect()) == CASES[text]


@pytest.mark.parametrize("text", ["id = 'x'", "zz = 1", "id +", "", "id", "name + 1 = 2", "json_exists(j, 'a')", "lower(id) = 'a'", "id = 1 2", "#", "lower()"])
def test_wrong(rows, text):
    with pytest.raises((DialectError, ValueError)):
        condition(text, rows.schema)


@pytest.mark.parametrize("text", ["CASE WHEN id = 1 THEN 1 END", "name LIKE 'a' ESCAPE '!'", "substr(name, 1) = 'a'", "id IS DISTINCT FROM 1", "id IN (SELECT 1)"])
def test_refused(rows, text):
    with pytest.raises(Unsupported):
        condition(text, rows.schema)


def test_types_and_precedence(spark):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("f", T.FloatType()), T.StructField("c", T.DecimalType(10, 2))])
    kinds = {"i + i": T.LongType, "i + 1.5": T.DoubleType, "i > 1": T.BooleanType, "i || 'x'": T.StringType, "CAST(i AS decimal(5,1))": T.DecimalType, "c + c": T.DecimalType}
    for text, kind in kinds.items():
        assert isinstance(to_sql(text, schema)[1], kind), text
    df = spark.createDataFrame([(7, 0.1, None)], "i int, f float, c decimal(10,2)")
    assert df.where(condition("f = 0.1", df.schema)).count() == 1
    assert df.select(column("1 + 2 * 3 - 8 / 2 % 3", df.schema)).first()[0] == 6
    with pytest.raises(DialectError):
        to_sql("c > 1.5", schema)
    tree = parse("a OR b AND NOT c = 1")
    assert tree.op == "or" and tree.args[1].op == "and" and tree.args[1].args[1].op == "not"


def test_ambiguous_names(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("A", T.LongType()), T.StructField("bB", T.LongType())])
    assert to_sql("a + bb", schema)[0].count("`a`") == 1
    with pytest.raises(DialectError):
        to_sql("aa", schema)


def test_like_patterns():
    assert like_pattern(r"a\b\%c\\") == r"ab\%c\\"


def test_json_paths():
    doc = {"a": [{"b": 1}, {"b": 2}], "c.d": 3}
    assert json_path.select(doc, "$.a[*].b") == [1, 2]
    assert json_path.select(doc, "$.a[-1].b") == [2]
    assert json_path.select(doc, '$."c.d"') == [3] and json_path.select(doc, "$['c.d']") == [3]
    assert json_path.select(doc, "$") == [doc] and json_path.select(doc, "$.a[9]") == []
    for bad in ("a", "$.", "$[x]"):
        with pytest.raises(ValueError):
            json_path.select(doc, bad)


def test_overflow_is_an_error(spark):
    df = spark.createDataFrame([(2**63 - 1,)], "a long")
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        df.select(column("a + 1", df.schema), F.lit(1)).collect()


@pytest.mark.parametrize("path", ["$.a", "$.b", "$.c.d", "$[0]", "$.l", "$.l[1]", "$", "$.n"])
def test_json_paths_by_variant_and_by_the_path_walk(spark, path):
    docs = ['{"a": null, "b": 1, "c": {"d": []}, "l": [1, [2, 3]]}', "[1, 2]", "3", "null", '{"l": []}', '{"l": {"1": 2}, "n": "x"}', None]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, j string")
    for d, got in [(r.j, r) for r in df.select("j", column(f"json_exists(j, '{path}')", df.schema, spark).alias("e")).collect()]:
        assert got.e == (None if d is None else bool(json_path.select(json.loads(d), path)))
    for k, d in enumerate(docs):
        found = [] if d is None else json_path.select(json.loads(d), path)
        one = df.where(f"k = {k}").select(column(f"json_array_length(j, '{path}')", df.schema, spark).alias("n"))
        if found and not isinstance(found[0], list):
            with pytest.raises(Exception, match="array"):
                one.collect()
        else:
            assert one.first().n == (len(found[0]) if found else None), (d, path)

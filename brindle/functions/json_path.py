"""JSON accessors over JSON text.

Plain keys and indices go by Spark's variant functions; wildcards, negative indices and json_array_contains, which
compares values by their text, go by one Arrow UDF that evaluates the path.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = {
    "json_get": T.StringType(), "json_get_string": T.StringType(), "json_get_int": T.LongType(), "json_get_float": T.DoubleType(), "json_get_bool": T.BooleanType(),
    "json_extract": T.StringType(), "json_exists": T.BooleanType(), "json_array_length": T.LongType(), "json_array_contains": T.BooleanType(),
}
_STEP = re.compile(r"""\s*(?:\.\s*(?:(\*)|"([^"]*)"|([^.\[\s"]+))|\[\s*(?:(\*)|'([^']*)'|"([^"]*)"|(-?\d+))\s*\])""")


def steps(path: str) -> list[str | int]:
    """'*', keys and indices of a JSONPath."""
    at = len(path) - len(path.lstrip())
    if path[at : at + 1] != "$":
        raise ValueError(f"Invalid JSONPath {path!r}: a path starts with $")
    at += 1
    out: list[str | int | None] = []
    while path[at:].strip():
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"Invalid JSONPath {path!r}")
        a, k1, k2, b, k3, k4, index = m.groups()
        out.append(None if a or b else int(index) if index is not None else next(k for k in (k1, k2, k3, k4) if k is not None))
        at = m.end()
    return out


def select(root, path: str) -> list:
    """All values that the path meets."""
    now = [root]
    for step in steps(path):
        after = []
        for x in now:
            if step is None:
                after += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
            elif isinstance(step, int):
                if isinstance(x, list) and -len(x) <= step < len(x):
                    after.append(x[step])
            elif isinstance(x, dict) and step in x:
                after.append(x[step])
        now = after
    return now


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _with_paths(made):
    def run(docs: pd.Series, paths: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for row in zip(docs, paths, *more, strict=True):
            out.append(None if any(x is None for x in row) else made(select(json.loads(row[0]), row[1]), *row[2:]))
        return pd.Series(out, dtype=object)

    return run


def _length(found: list):
    if not found:
        return None
    if not isinstance(found[0], list):
        raise ValueError("the path does not point to an array")
    return len(found[0])


def register(spark: SparkSession) -> None:
    """The UDFs that emitted text may name."""
    known = {f.name for f in spark.catalog.listFunctions(pattern="brindle_*")} if hasattr(spark.catalog, "listFunctions") else set()
    if "brindle_json_exists" in known:
        return
    for name, kind, made in (
        ("exists", "boolean", lambda f: bool(f)),
        ("extract", "string", lambda f: _dump(f[0]) if f else None),
        ("array_length", "bigint", _length),
        ("array_contains", "boolean", lambda f, v: any(_dump(y) in (v, f'"{v}"') for x in f if isinstance(x, list) for y in x)),
    ):
        spark.udf.register(f"brindle_json_{name}", F.pandas_udf(_annotated(_with_paths(made), 3 if name == "array_contains" else 2), kind))
    spark.udf.register("brindle_half", F.pandas_udf(_half, "array<float>"))


def _annotated(f, n: int):
    if n == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return f(a, b)

        return two

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return f(a, b, c)

    return three


def _half(lists: pd.Series) -> pd.Series:
    return lists.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))


def _plain(path: str | None) -> str | None:
    """The path for Spark's variant functions, where it has only keys and indices."""
    if path is None:
        return None
    parts = steps(path)
    if any(p is None or isinstance(p, int) and p < 0 or isinstance(p, str) and ("'" in p or "\\" in p) for p in parts):
        return None
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"[\\'{p}\\']" for p in parts)


def sql(name: str, args: list[str], keys: list) -> str:
    """Spark SQL of an accessor; keys: the values of literal arguments. A document is parsed once, for a lambda that asks its value more often."""
    doc = args[0]
    if name.startswith("json_get"):
        key = keys[0]
        if not isinstance(key, (str, int)) or isinstance(key, bool) or "'" in str(key) or "\\" in str(key):
            raise ValueError(f"{name} takes a key in quotes")
        by_index = f"try_variant_get(parse_json({doc}), '$[{key}]', 'variant')" if re.fullmatch(r"\d+", str(key)) else "NULL"
        made = f"coalesce(try_variant_get(parse_json({doc}), '$[\\'{key}\\']', 'variant'), {by_index})"
        if name == "json_get":
            return f"to_json({made})"
        v, kind = "__j.v", "__j.kind"
        once = lambda test: f"element_at(transform(array(named_struct('v', {made})), __i -> transform(array(named_struct('v', __i.v, 'kind', schema_of_variant(__i.v))), __j -> {test})[0]), 1)"
        number = f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%')"
        none = f"WHEN {v} IS NULL OR {kind} = 'VOID' THEN NULL"
        text = f"variant_get({v}, '$', 'string')"
        fail = lambda what: f"ELSE raise_error('Failed to convert to {what}: InvalidCast') END)"
        if name == "json_get_string":
            return once(f"(CASE {none} WHEN {kind} IN ('BOOLEAN', 'STRING') OR {number} THEN {text} {fail('string')}")
        if name == "json_get_int":
            return once(f"(CASE {none} WHEN {kind} = 'BOOLEAN' THEN if({text} = 'true', 1L, 0L) WHEN {kind} = 'BIGINT' THEN variant_get({v}, '$', 'bigint') "
                    f"WHEN {number} OR {kind} = 'STRING' AND try_cast({text} AS double) IS NOT NULL THEN coalesce(try_cast({text} AS bigint), cast(round(cast({text} AS double)) AS bigint)) {fail('integer')}")
        if name == "json_get_float":
            return once(f"(CASE {none} WHEN {kind} = 'BOOLEAN' THEN if({text} = 'true', 1.0D, 0.0D) "
                    f"WHEN {number} OR {kind} = 'STRING' AND try_cast({text} AS double) IS NOT NULL THEN cast({text} AS double) {fail('float')}")
        return once(f"(CASE {none} WHEN {kind} = 'BOOLEAN' THEN {text} = 'true' WHEN {kind} = 'STRING' AND lower({text}) IN ('true', 'yes') THEN true "
                f"WHEN {kind} = 'STRING' AND lower({text}) IN ('false', 'no') THEN false {fail('boolean')}")
    plain = _plain(keys[0] if isinstance(keys[0], str) else None)
    if name == "json_extract" and plain:
        return f"to_json(try_variant_get(parse_json({doc}), '{plain}', 'variant'))"
    if plain and name in ("json_exists", "json_array_length"):
        v = f"try_variant_get(parse_json({doc}), '{plain}', 'variant')"  # a JSON null is a value, not null
        if name == "json_exists":
            return f"(CASE WHEN {doc} IS NOT NULL THEN {v} IS NOT NULL END)"
        return f"(CASE WHEN {v} IS NULL THEN NULL WHEN schema_of_variant({v}) LIKE 'ARRAY%' THEN cast(size(variant_get({v}, '$', 'array<variant>')) AS bigint) ELSE raise_error('the path does not point to an array') END)"
    return f"brindle_{name}({', '.join([doc, args[1], *(f'cast({x} AS string)' for x in args[2:])])})"

"""Scalar indexes as side tables, and which rows a filter can have by them.

An index narrows and never changes an answer: scans read only the fragments that hold its candidates, join these and
apply the whole filter again. Fragments that an index doesn't cover are read whole. A count that an index answers
exactly reads no data file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import emit, json_path
from brindle.functions.dialect import Node, parse
from brindle.session import stash

KINDS = ("BTREE", "BITMAP", "LABEL_LIST", "ZONEMAP", "BLOOMFILTER", "NGRAM", "JSON")
ZONE = 8192
BLOOM_BITS, BLOOM_HASHES = 131_072, 7
INLINE = 10_000  # candidates that are fetched at most; more stay a table, of which only the fragments' numbers are


def register(table, entry: dict, fragments: list[int] | None = None) -> dict:
    """Commit an index over the version's fragments, or some of them; one of the same name goes."""
    field = next(f["id"] for f in table.manifest.fields if f["name"] == entry["column"].partition(".")[0])
    entry = entry | {"field": field, "fragments": [f.id for f in table.manifest.fragments] if fragments is None else sorted(fragments), "version": table.version}

    def change(old, number: int):
        old.indexes = [i for i in old.indexes if i["name"] != entry["name"]] + [entry]
        return old

    table._again(table.log.commit(table.manifest, {"operation": "CreateIndex", "keys": [entry["name"]], "fragments": entry["fragments"]}, change))
    return entry


def create(table, column: str, kind: str = "BTREE", name: str | None = None, path: str | None = None, fragments: list[int] | None = None) -> dict:
    """Build the side table over the fragments, or some: (value, addr) in order of value, zones of a fragment, or trigrams."""
    kind = kind.upper()
    if kind not in KINDS:
        raise ValueError(f"unknown index kind {kind}")
    folder = f"_indices/{uuid.uuid4().hex}"
    _side(table, column, kind, path, fragments).write.parquet(table.store.at(f"{folder}/part-0"))
    return register(table, {"name": name or f"{column}_idx", "column": column, "kind": kind, "path": folder, "parts": ["part-0"], "json_path": path}, fragments)


def _side(table, column: str, kind: str, path: str | None, fragments: list[int] | None) -> DataFrame:
    rows = table.to_df(system=True, fragments=fragments, columns=[column.partition(".")[0]])
    df = rows.select(F.col("_rowaddr").alias("addr"), F.col(column).alias("value"))
    t = df.schema["value"].dataType
    zone = [F.shiftright("addr", 32).alias("frag"), F.floor(F.col("addr").bitwiseAND(0xFFFFFFFF) / ZONE).cast("int").alias("zone")]
    if kind in ("BTREE", "BITMAP"):
        made = df.repartitionByRange("value", "addr").sortWithinPartitions("value", "addr")
    elif kind == "LABEL_LIST":
        if not isinstance(t, T.ArrayType):
            raise ValueError("a LABEL_LIST index is over a list")
        made = df.select("addr", F.explode_outer(F.array_distinct("value")).alias("value"), F.col("value").isNull().alias("none")).repartitionByRange("value", "addr").sortWithinPartitions("value", "addr")
    elif kind == "ZONEMAP":
        nan = F.count_if(F.isnan("value")) if isinstance(t, (T.FloatType, T.DoubleType)) else F.lit(0)
        made = df.groupBy(*zone).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value").isNull()).alias("nulls"), nan.alias("nans"))
    elif kind == "BLOOMFILTER":
        bits = F.array(*[F.pmod(F.xxhash64("value", F.lit(k)), F.lit(BLOOM_BITS)).cast("int") for k in range(BLOOM_HASHES)])
        made = df.select(*zone, "value", F.explode(bits).alias("bit")).groupBy("frag", "zone").agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("bit"))).alias("bits"), F.max(F.col("value").isNull()).alias("nulls"))
    elif kind == "NGRAM":
        made = df.select("addr", F.explode(trigrams(F.col("value"))).alias("value")).repartitionByRange("value", "addr").sortWithinPartitions("value", "addr")
    else:
        made = rows.select(F.col("_rowaddr").alias("addr"), emit.column(f"json_extract({column}, '{path}')", table.schema, table.spark).alias("value"))
        made = made.repartitionByRange("value", "addr").sortWithinPartitions("value", "addr")
    return made


def trigrams(col: Column) -> Column:
    """Distinct runs of three ASCII letters or digits of the lower-cased text, within words."""
    words = F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]{3,}"), F.lit(0))
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def drop(table, name: str) -> None:
    def change(old, number: int):
        if name not in [i["name"] for i in old.indexes]:
            raise ValueError(f"no index {name}")
        old.indexes = [i for i in old.indexes if i["name"] != name]
        return old

    table._again(table.log.commit(table.manifest, {"operation": "CreateIndex", "keys": [name]}, change))


def describe(table) -> list[dict]:
    live = {f.id: f.live for f in table.manifest.fragments}
    return [i | {"covered_rows": sum(live.get(f, 0) for f in i["fragments"]), "uncovered_rows": sum(n for f, n in live.items() if f not in set(i["fragments"]))} for i in table.manifest.indexes]


def optimize(table) -> None:
    """Cover every fragment: scalar indexes get a part for the new ones, text and vector indexes are built anew."""
    for entry in list(table.manifest.indexes):
        rest = [f.id for f in table.manifest.fragments if f.id not in set(entry["fragments"])]
        if not rest:
            continue
        if entry["kind"] == "INVERTED":
            from brindle.operators.fts import TextIndex

            TextIndex.build(table, entry["column"], entry["name"], **{k: tuple(v) if isinstance(v, list) else v for k, v in entry["params"].items()})
        elif entry["kind"].startswith("IVF"):
            from brindle.operators.vector import IvfIndex

            IvfIndex.build(table, entry["column"], entry["name"], entry["metric"], kind=entry["kind"])
        else:
            if Planner(table)._covered(entry) != set(entry["fragments"]):  # cells were set since; their old values are in a part
                create(table, entry["column"], entry["kind"], entry["name"], entry.get("json_path"))
                continue
            part = f"part-{uuid.uuid4().hex}"
            _side(table, entry["column"], entry["kind"], entry.get("json_path"), rest).write.parquet(table.store.at(f"{entry['path']}/{part}"))
            live = {f.id for f in table.manifest.fragments}
            register(table, {**entry, "parts": [*entry.get("parts", ["part-0"]), part]}, [f for f in [*entry["fragments"], *rest] if f in live])


# -- candidates ---------------------------------------------------------------------------------------------


@dataclass
class Candidates:
    """Addresses (addr) that may match, and the fragments for which that is known; zones: (frag, zone) instead.

    exact: just these rows match, but for deleted ones. costly: they are stashed before they are asked more than once.
    """

    rows: DataFrame
    covered: set[int]
    zones: bool = False
    exact: bool = False
    costly: bool = False


def _literal(n: Node):
    if n.op == "literal":
        return True, n.value
    if n.op == "negate" and n.args[0].op == "literal":
        return True, -n.args[0].value
    if n.op in ("date", "timestamp"):
        return True, n
    return False, None


_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "<>": "<>"}


class Planner:
    def __init__(self, table):
        self.table = table
        self.names = table.schema.fieldNames()

    def _side(self, entry: dict) -> DataFrame:
        return self.table.spark.read.parquet(*[self.table.store.at(f"{entry['path']}/{p}") for p in entry.get("parts", ["part-0"])])

    def _entries(self, column: str, *kinds: str) -> list[dict]:
        try:
            own = emit.resolve(column, self.names)
        except ValueError:
            return []
        field = next(f["id"] for f in self.table.manifest.fields if f["name"] == own)
        return [i for i in self.table.manifest.indexes if i["field"] == field and i["kind"] in kinds]

    def plan(self, node: Node) -> Candidates | None:
        """AND takes either side or both, OR needs both; other nodes are looked up, or not answered."""
        if node.op == "and":
            a, b = map(self.plan, node.args)
            if a is None or b is None or a.zones != b.zones:
                one = a or b if a is None or b is None else b if a.zones else a
                return one and Candidates(one.rows, one.covered, one.zones, costly=one.costly)
            key = ["frag", "zone"] if a.zones else ["addr"]
            return Candidates(a.rows.join(b.rows, key, "left_semi"), a.covered & b.covered, a.zones, a.exact and b.exact, a.costly or b.costly)
        if node.op == "or":
            a, b = map(self.plan, node.args)
            if a is None or b is None or a.zones != b.zones:
                return None
            return Candidates(a.rows.unionByName(b.rows).distinct(), a.covered & b.covered, a.zones, a.exact and b.exact, a.costly or b.costly)
        return self._lookup(node)

    def _lookup(self, node: Node) -> Candidates | None:
        column, op, values = self._predicate(node)
        if column is None:
            return self._json(node)
        for entry in self._entries(column, "BTREE", "BITMAP", "ZONEMAP", "BLOOMFILTER", "LABEL_LIST", "NGRAM"):
            got = self._answer(entry, op, values)
            if got is not None:
                return got
        return None

    def _json(self, node: Node) -> Candidates | None:
        """A predicate over one JSON accessor: it is asked of the indexed values, each put back in its place."""
        if node.op not in (*_FLIP, "in", "between", "like", "ilike"):
            return None
        calls = [a for a in node.args if a.op == "call"]
        if len(calls) != 1 or not str(calls[0].value).startswith("json_") or any(not _literal(a)[0] for a in node.args if a is not calls[0]):
            return None
        accessor, (column, *where) = calls[0].value, calls[0].args
        if column.op != "column" or len(where) != 1 or not isinstance(_literal(where[0])[1], str):
            return None
        try:
            keys = json_path.steps(_literal(where[0])[1]) if accessor in ("json_extract",) else [_literal(where[0])[1]]
        except ValueError:
            return None
        if accessor not in ("json_extract", "json_get", "json_get_string", "json_get_int", "json_get_float", "json_get_bool") or not all(isinstance(k, str) for k in keys):
            return None
        for entry in self._entries(column.value, "JSON"):
            if json_path.steps(entry["json_path"]) != keys:
                continue
            lead = "".join("{" + json.dumps(k, ensure_ascii=False) + ":" for k in keys)
            side = self._side(entry).where("value IS NOT NULL")
            own = emit.resolve(column.value, self.names)
            back = side.withColumn(own, F.concat(F.lit(lead), "value", F.lit("}" * len(keys))))
            json_path.register(self.table.spark)
            test = emit.Emitter(T.StructType([T.StructField(own, T.StringType())]))(node)[0]
            return Candidates(back.where(F.expr(test)).select("addr"), self._covered(entry), costly=True)
        return None

    def _predicate(self, node: Node):
        """(column, operator, values) of a predicate that an index may answer."""
        args = node.args
        if node.op in _FLIP and node.op != "<>":
            for (a, b), op in (((args[0], args[1]), node.op), ((args[1], args[0]), _FLIP[node.op])):
                known, v = _literal(b)
                if a.op == "column" and known and v is not None:
                    return a.value, op, [v]
        if node.op == "in" and args[0].op == "column" and all(_literal(a)[0] for a in args[1:]):
            return args[0].value, "in", [v for a in args[1:] if (v := _literal(a)[1]) is not None]
        if node.op == "between" and args[0].op == "column" and all(_literal(a)[0] for a in args[1:]):
            return args[0].value, "between", [_literal(a)[1] for a in args[1:]]
        if node.op == "is_null" and args[0].op == "column":
            return args[0].value, "null", []
        if node.op == "call" and node.value in ("array_has", "array_contains", "list_has", "list_contains") and args[0].op == "column" and _literal(args[1])[0]:
            return args[0].value, "has", [_literal(args[1])[1]]
        if node.op == "call" and node.value in ("array_has_any", "list_has_any", "array_has_all", "list_has_all") and args[0].op == "column" and args[1].op == "list" and args[1].args and all(_literal(a)[0] for a in args[1].args):
            return args[0].value, "has_all" if node.value.endswith("all") else "has", [_literal(a)[1] for a in args[1].args]
        if node.op == "call" and node.value == "contains" and args[0].op == "column" and isinstance(_literal(args[1])[1], str):
            return args[0].value, "contains", [_literal(args[1])[1]]
        return None, None, None

    def _covered(self, entry: dict) -> set[int]:
        """The index's fragments, without those of which an overlay has set cells of the column since."""
        m = self.table.manifest
        field = entry["field"]
        stale = {f for p in m.patches if p["overlay"] and field in p["fields"] and p["version"] > entry["version"] for f in p["touched"]}
        return set(entry["fragments"]) - stale

    def _answer(self, entry: dict, op: str, values: list) -> Candidates | None:
        side, covered, kind = self._side(entry), self._covered(entry), entry["kind"]
        t = side.schema["value"].dataType if "value" in side.columns else side.schema["low"].dataType if "low" in side.columns else self.table.schema[entry["column"]].dataType
        lit = lambda v: F.expr(emit.Emitter(T.StructType())(v)[0]).cast(t) if isinstance(v, Node) else F.lit(v).cast(t)
        plain = {"=": lambda c, v: c == v[0], "<": lambda c, v: c < v[0], "<=": lambda c, v: c <= v[0], ">": lambda c, v: c > v[0], ">=": lambda c, v: c >= v[0],
                 "between": lambda c, v: (c >= v[0]) & (c <= v[1]), "in": lambda c, v: c.isin(*v) if v else F.lit(False)}
        if kind in ("BTREE", "BITMAP"):
            if isinstance(t, (T.FloatType, T.DecimalType)) and op != "null":
                return None  # literals are rounded to the column's type first
            if op == "null":
                return Candidates(side.where("value IS NULL").select("addr"), covered, exact=True)
            if op not in plain or any(v is None for v in values):
                return None
            if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
                return None
            exact = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType))
            return Candidates(side.where(plain[op](F.col("value"), [lit(v) for v in values])).select("addr"), covered, exact=exact)
        if kind == "LABEL_LIST":
            if op == "null":
                return Candidates(side.where("none").select("addr").distinct(), covered)
            if op not in ("has", "has_all") or None in values:
                return None
            found = side.where(F.col("value").isin(*[lit(v) for v in values]))
            if op == "has":
                return Candidates(found.select("addr").distinct(), covered)
            return Candidates(found.groupBy("addr").agg(F.count_distinct("value").alias("n")).where(F.col("n") == len(set(values))).select("addr"), covered)
        if kind == "NGRAM":
            if op != "contains":
                return None
            grams = [r for r in self.table.spark.range(1).select(trigrams(F.lit(values[0]))).first()[0]]
            inner = [g for g in grams]
            if not inner:
                return None
            found = side.where(F.col("value").isin(*inner)).groupBy("addr").agg(F.count_distinct("value").alias("n")).where(F.col("n") == len(inner))
            return Candidates(found.select("addr"), covered)
        if kind == "ZONEMAP":
            low, high = F.col("low"), F.col("high")
            v = [lit(x) for x in values]
            test = {"=": lambda: (low <= v[0]) & (high >= v[0]), "<": lambda: low < v[0], "<=": lambda: low <= v[0], ">": lambda: (high > v[0]), ">=": lambda: (high >= v[0]),
                    "between": lambda: (low <= v[1]) & (high >= v[0]), "null": lambda: F.col("nulls") > 0,
                    "in": lambda: reduce(lambda a, b: a | b, [(low <= x) & (high >= x) for x in v], F.lit(False))}.get(op)
            return Candidates(side.where(test()).select("frag", "zone"), covered, True) if test else None
        if kind == "BLOOMFILTER" and op in ("=", "in", "null"):
            if op == "null":
                return Candidates(side.where("nulls").select("frag", "zone"), covered, True)
            test = F.lit(False)
            for x in values:
                bits = F.array(*[F.pmod(F.xxhash64(lit(x), F.lit(k)), F.lit(BLOOM_BITS)).cast("int") for k in range(BLOOM_HASHES)])
                test = test | (F.size(F.array_except(bits, F.col("bits"))) == 0)
            return Candidates(side.where(test).select("frag", "zone"), covered, True)
        return None


def candidates(table, filter: str) -> Candidates | None:
    return Planner(table).plan(parse(filter))


class Narrowed:
    """What the indexes leave of a table for a filter: the fragments to read, and which of their rows."""

    def __init__(self, table, found: Candidates, covered_only: bool):
        self.found = found
        self.rest = [] if covered_only else [f.id for f in table.manifest.fragments if f.id not in found.covered]
        self.rows = found.rows
        if found.zones:
            hit = {r[0] for r in found.rows.select("frag").distinct().collect()}  # a row a fragment
        else:
            self.rows = stash(found.rows) if found.costly else found.rows
            few = self.rows.limit(INLINE + 1).collect()
            if len(few) <= INLINE:
                hit = {r[0] >> 32 for r in few}
                self.rows = F.broadcast(table.spark.createDataFrame([(r[0],) for r in few], "addr long"))
            else:
                hit = {r[0] for r in self.rows.select(F.shiftright("addr", 32)).distinct().collect()}  # a row a fragment
        live = {f.id for f in table.manifest.fragments}
        self.fragments = sorted((hit & found.covered & live) | set(self.rest))

    def apply(self, df: DataFrame) -> DataFrame:
        """df (of these fragments, with _rowaddr) without rows that the indexes rule out."""
        frag = F.shiftright("_rowaddr", 32)
        known = df.where(~frag.isin(self.rest)) if self.rest else df
        if self.found.zones:
            keys = known.withColumns({"frag": frag, "zone": F.floor(F.col("_rowaddr").bitwiseAND(0xFFFFFFFF) / ZONE).cast("int")})
            known = keys.join(self.rows, ["frag", "zone"], "left_semi").drop("frag", "zone")
        else:
            known = known.join(self.rows.withColumnRenamed("addr", "_rowaddr"), "_rowaddr", "left_semi")
        return known.unionByName(df.where(frag.isin(self.rest))) if self.rest else known


def narrowed(table, filter: str, covered_only: bool = False) -> Narrowed | None:
    """None where no index answers any part of the filter."""
    found = candidates(table, filter)
    return None if found is None else Narrowed(table, found, covered_only)


def count(table, filter: str) -> int | None:
    """The rows that match, from the indexes alone; None where they don't answer exactly for all fragments."""
    found = candidates(table, filter)
    if found is None or not found.exact or any(f.id not in found.covered for f in table.manifest.fragments):
        return None
    live = [f.id for f in table.manifest.fragments]
    rows = found.rows
    gone = {f for f in found.covered if f not in set(live)}
    if gone:
        rows = rows.where(~F.shiftright("addr", 32).isin(sorted(gone)))
    if table.manifest.deletions:
        rows = rows.join(table.spark.read.parquet(*[table.store.at(d["path"]) for d in table.manifest.deletions]).select("addr"), "addr", "left_anti")
    return rows.count()


def explain(table, filter: str) -> dict:
    """What the indexes say to a filter."""
    found = candidates(table, filter)
    return {"answered": found is not None, "by": None if found is None else "zones" if found.zones else "rows", "covered": sorted(found.covered) if found else []}

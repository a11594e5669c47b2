"""Directories of tables: namespaces, and a connection with a search builder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import fts, vector
from brindle.operators.scan import Scan, project
from brindle.sources import ingest
from brindle.sources.store import Store
from brindle.sources.table import Table


class Catalog:
    """Tables by name below a root; namespaces are folders. Declared tables have a name and no version yet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _path(self, name: str | list[str]) -> str:
        parts = name.split(".") if isinstance(name, str) else list(name)
        if not parts or any(not p or "/" in p or p.startswith("_") and p != "_rejects" and p != "_catalog" for p in parts):
            raise ValueError(f"bad name {name!r}")
        return self.store.at("/".join([*(f"{p}.ns" for p in parts[:-1]), parts[-1]]))

    def _registered(self) -> dict[str, str]:
        return json.loads(self.store.read("_registered.json")) if self.store.exists("_registered.json") else {}

    def location(self, name: str) -> str:
        return self._registered().get(name) or self._path(name)

    def exists(self, name: str) -> bool:
        return bool(Store(self.spark, self.location(name)).list("_versions"))

    def list_tables(self, namespace: str = "") -> list[str]:
        at = "/".join(f"{p}.ns" for p in namespace.split(".") if p)
        found = [d for d in self.store.folders(at) if not d.endswith(".ns") and not d.startswith("_")]
        lead = f"{namespace}." if namespace else ""
        mine = [n.removeprefix(lead) for n in self._registered() if n.startswith(lead) and "." not in n.removeprefix(lead)]
        return sorted({*found, *mine})

    def create_namespace(self, name: str) -> None:
        self.store.replace("/".join(f"{p}.ns" for p in name.split(".")) + "/_namespace", "{}")

    def list_namespaces(self, parent: str = "") -> list[str]:
        at = "/".join(f"{p}.ns" for p in parent.split(".") if p)
        return [d[:-3] for d in self.store.folders(at) if d.endswith(".ns")]

    def drop_namespace(self, name: str) -> None:
        if self.list_tables(name) or self.list_namespaces(name):
            raise ValueError(f"namespace {name} isn't empty")
        self.store.delete("/".join(f"{p}.ns" for p in name.split(".")))

    def create_table(self, name: str, data, mode: str = "create", **how) -> Table:
        return Table.write(ingest.to_rows(self.spark, data), self.location(name), mode, **how)

    def declare(self, name: str) -> str:
        self.store.replace(f"{self._path(name)}/_declared", "{}")
        return self._path(name)

    def register(self, name: str, location: str) -> None:
        Table(self.spark, location)
        self.store.replace("_registered.json", json.dumps(self._registered() | {name: location}))

    def deregister(self, name: str) -> None:
        known = self._registered()
        del known[name]
        self.store.replace("_registered.json", json.dumps(known))

    def open(self, name: str, version: int | str | None = None) -> Table:
        return Table(self.spark, self.location(name), version)

    def describe(self, name: str) -> dict:
        t = self.open(name)
        return {"name": name, "location": t.root, "schema": t.schema.simpleString(), **t.stats()}

    def drop(self, name: str) -> None:
        Table.drop(self.spark, self.location(name))
        if name in self._registered():
            self.deregister(name)

    def rename(self, old: str, new: str) -> None:
        self.store.move(self._path(old), self._path(new))

    def views(self) -> None:
        """Every table as a temporary view, for Spark SQL with joins, groups and windows."""
        for name in self.list_tables():
            self.open(name).to_df().createOrReplaceTempView(name)


def connect(spark: SparkSession, root: str) -> "Connection":
    return Connection(spark, root)


class Connection(Catalog):
    """Tables with the add / search / update API."""

    def create_table(self, name: str, data=None, schema: T.StructType | None = None, mode: str = "create", exist_ok: bool = False, on_bad_vectors: str = "error", fill_value: float = 0.0, **how) -> "Handle":
        if exist_ok and self.exists(name):
            return self.open_table(name)
        if data is None:
            if schema is None:
                raise ValueError("give data or a schema")
            df = self.spark.createDataFrame([], schema)
        else:
            df = ingest.to_rows(self.spark, data, schema)
        Table.write(_cleaned(df, on_bad_vectors, fill_value), self.location(name), mode, **how)
        return self.open_table(name)

    def open_table(self, name: str) -> "Handle":
        return Handle(self.open(name), name)

    def table_names(self) -> list[str]:
        return self.list_tables()

    def drop_table(self, name: str) -> None:
        self.drop(name)


def _cleaned(df: DataFrame, policy: str, fill: float) -> DataFrame:
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType) and (f.metadata or {}).get("dim"):
            df = ingest.clean_vectors(df, f.name, policy, fill)
    return df


def literal(value) -> str:
    """A Python value as text of the dialect."""
    import datetime

    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value}'"
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(literal, value))}]"
    return "'" + str(value).replace("'", "''") + "'"


class Handle:
    def __init__(self, table: Table, name: str = ""):
        self.table, self.name = table, name

    def add(self, data, mode: str = "append", on_bad_vectors: str = "error", fill_value: float = 0.0) -> "Handle":
        df = _cleaned(ingest.to_rows(self.table.spark, data), on_bad_vectors, fill_value)
        self.table = self.table.append(df) if mode == "append" else Table.write(df, self.table.root, "overwrite")
        return self

    def delete(self, where: str) -> dict:
        return self.table.delete(where)

    def update(self, where: str | None = None, values: dict | None = None, values_sql: dict[str, str] | None = None) -> dict:
        if (values is None) == (values_sql is None):
            raise ValueError("give values or values_sql")
        return self.table.update(values_sql or {k: literal(v) for k, v in values.items()}, where)

    def merge_insert(self, on):
        return self.table.merge_insert(on)

    def count_rows(self, filter: str | None = None) -> int:
        return self.table.count_rows(filter)

    def to_pandas(self):
        return self.table.to_df().toPandas()

    def optimize(self) -> dict:
        from brindle.plans import indexes

        done = self.table.compact()
        indexes.optimize(self.table)
        return done

    def vector_column(self) -> str:
        """The only vector column, or `vector`."""
        found = [f.name for f in self.table.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]
        if len(found) == 1:
            return found[0]
        if "vector" in found:
            return "vector"
        raise ValueError(f"name the vector column: {found}")

    def search(self, query=None, column: str | None = None, query_type: str = "auto") -> "SearchBuilder":
        """Text queries search text, vectors search vectors, none scans."""
        text = query_type == "fts" or query_type == "auto" and isinstance(query, (str, fts.Query))
        return SearchBuilder(self, query, column, "scan" if query is None else "fts" if text else "vector")


class SearchBuilder:
    def __init__(self, handle: Handle, query, column: str | None, kind: str):
        self.handle, self.query, self.column, self.kind = handle, query, column, kind
        self.settings: dict = {}
        self._where, self._prefilter, self._columns = None, True, None
        self._limit: int | None = None if kind == "scan" else 10
        self._offset = 0
        self._row_id = False

    def where(self, text: str, prefilter: bool = True) -> "SearchBuilder":
        self._where, self._prefilter = text, prefilter
        return self

    def select(self, columns) -> "SearchBuilder":
        self._columns = columns
        return self

    def limit(self, n: int | None) -> "SearchBuilder":
        self._limit = n
        return self

    def offset(self, n: int) -> "SearchBuilder":
        self._offset = n
        return self

    def with_row_id(self, on: bool = True) -> "SearchBuilder":
        self._row_id = on
        return self

    def distance_type(self, metric: str) -> "SearchBuilder":
        self.settings["metric"] = metric
        return self

    metric = distance_type

    def nprobes(self, n: int) -> "SearchBuilder":
        self.settings["nprobes"] = n
        return self

    def refine_factor(self, n: int) -> "SearchBuilder":
        self.settings["refine_factor"] = n
        return self

    def ef(self, n: int) -> "SearchBuilder":
        self.settings["ef"] = n
        return self

    def bypass_vector_index(self) -> "SearchBuilder":
        self.settings["use_index"] = False
        return self

    def distance_range(self, low: float | None = None, high: float | None = None) -> "SearchBuilder":
        self.settings["distance_range"] = (low, high)
        return self

    def to_df(self) -> DataFrame:
        table = self.handle.table
        how = {"filter": self._where, "limit": self._limit, "offset": self._offset or None, "columns": self._columns, "with_row_id": self._row_id}
        if self.kind == "scan":
            return Scan(table, **how).to_df()
        if self.kind == "fts":
            query = fts.MatchQuery(self.query, self.column) if isinstance(self.query, str) and self.column else self.query
            return Scan(table, **how, full_text_query=query, prefilter=self._prefilter).to_df()
        column = self.column or self.handle.vector_column()
        k = (self._limit or table.manifest.rows or 1) + self._offset
        spec = {"column": column, "q": self.query, "k": k, **self.settings}
        entry = next((i for i in table.manifest.indexes if i["column"] == column and i["kind"].startswith("IVF")), None)
        if entry and self.settings.get("use_index", True) and self._prefilter:
            found = vector.IvfIndex(table, entry).search({x: v for x, v in spec.items() if x != "column"}, self._where)
            found = found.orderBy(F.col("_distance").asc_nulls_last(), "_rowid").offset(self._offset)
            found = found.limit(self._limit) if self._limit is not None else found
            names = self._columns or table.schema.fieldNames()
            return project(found, [*names, "_distance", *(["_rowid"] if self._row_id else [])], found.schema)
        return Scan(table, **how, nearest=spec, prefilter=self._prefilter).to_df()

    def to_pandas(self):
        return self.to_df().toPandas()

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_df().toLocalIterator()]

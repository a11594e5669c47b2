"""Fragments one by one, and data files that are written first and committed later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import emit
from brindle.sources.manifest import Log, Manifest
from brindle.sources.store import Store
from brindle.sources.table import ROWS_PER_FILE, Table, _schema_of


class Handle:
    """One fragment of a table version."""

    def __init__(self, table: Table, number: int):
        self.table, self.id = table, number
        self.fragment = next((f for f in table.manifest.fragments if f.id == number), None)
        if self.fragment is None:
            raise ValueError(f"version {table.version} has no fragment {number}")

    @property
    def file(self) -> str:
        return self.fragment.file

    def scan(self, **how):
        return self.table.scan(**how, fragments=[self.id])

    def to_df(self) -> DataFrame:
        return self.scan().to_df()

    def head(self, n: int, **how) -> DataFrame:
        return self.scan(**how, limit=n).to_df()

    def take(self, positions: list[int], columns: list[str] | None = None) -> DataFrame:
        """Rows by their place among the fragment's live rows, in the order asked for."""
        from brindle.operators.scan import take

        bad = [p for p in positions if not 0 <= p < self.fragment.live]
        if bad:
            raise IndexError(f"positions {bad[:3]} are outside 0..{self.fragment.live - 1}")
        before = sum(f.live for f in self.table.manifest.fragments[: [f.id for f in self.table.manifest.fragments].index(self.id)])
        return take(self.table, [before + p for p in positions], columns)

    def count_rows(self, filter: str | None = None) -> int:
        return self.fragment.live if not filter else self.scan(filter=filter).count_rows()

    def delete(self, predicate: str) -> dict:
        """Strike the fragment's rows that match; the table is a version further then."""
        df = self.table.to_df(system=True, fragments=[self.id])
        folder, per = self.table._addresses(df.where(emit.condition(predicate, df.schema, df.sparkSession)).select(F.col("_rowaddr").alias("addr")))
        if per:
            def change(old: Manifest, number: int) -> Manifest:
                self.table._strike(old, folder, per)
                return old

            self.table._again(self.table.log.commit(self.table.manifest, {"operation": "Delete", "fragments": list(per)}, change))
        return {"num_deleted_rows": sum(per.values())}

    def merge_columns(self, make: Callable[[DataFrame], DataFrame] | dict[str, str]) -> Table:
        """New columns of the table, with values for this fragment's rows: expressions, or a function of its rows that keeps _rowid."""
        rows = self.table.to_df(system=True, fragments=[self.id])
        if isinstance(make, dict):
            got = rows.select("_rowid", *[emit.column(text, rows.schema, rows.sparkSession).alias(name) for name, text in make.items()])
        else:
            got = make(rows)
            if "_rowid" not in got.columns:
                raise ValueError("the rows must keep their _rowid")
        return self.table.add_columns(got.select("_rowid", *[c for c in got.columns if c not in rows.columns]), on="_rowid")


def handles(table: Table) -> list[Handle]:
    return [Handle(table, f.id) for f in table.manifest.fragments]


def write_fragments(df: DataFrame, root: str, table: Table | None = None, rows_per_file: int = ROWS_PER_FILE) -> list[dict]:
    """Data files below root that no version has yet: file, rows, bytes and fields, to be committed. table: whose columns they get."""
    spark = df.sparkSession
    if table is not None:
        fields = [f["name"] for f in table.manifest.fields]
        files = Table._write_files(table.store, table._aligned(df), rows_per_file)
        return [{"file": f, "rows": r, "bytes": b, "fields": fields} for f, r, b in files]
    files = Table._write_files(Store(spark, root), df, rows_per_file)
    schema = df.schema.json()
    return [{"file": f, "rows": r, "bytes": b, "fields": df.columns, "schema": schema} for f, r, b in files]


def commit(spark: SparkSession, root: str, fragments: list[dict], operation: str = "append", read_version: int | None = None, stable_row_ids: bool = False) -> Table:
    """One version of written files: append to the table, or overwrite (or make) it. read_version: the version that the writer saw."""
    from pyspark.sql import types as T

    files = [(f["file"], f["rows"], f["bytes"]) for f in fragments]
    log = Log(Store(spark, root))
    if operation == "append":
        table = Table(spark, root, read_version)
        names = [f["name"] for f in table.manifest.fields]
        if any(f["fields"] != names for f in fragments):
            raise ValueError(f"the files must have the columns {names}")
        fields = table.manifest.fields

        def change(old: Manifest, number: int) -> Manifest:
            Table._add(old, files, number, _schema_of(old, fields))
            return old

        return table._again(table.log.commit(table.manifest, {"operation": "Append", "fragments": []}, change))
    if operation != "overwrite":
        raise ValueError("operation is append or overwrite")
    if not fragments or any(f.get("schema") != fragments[0].get("schema") or "schema" not in f for f in fragments):
        raise ValueError("the files must have one schema")
    base = log.read(log.latest() if read_version is None else read_version) if log.versions() else None
    fields, ids = Table._fields(T.StructType.fromJson(__import__("json").loads(fragments[0]["schema"])), 0 if base is None else base.next_field)

    def change(old: Manifest | None, number: int) -> Manifest:
        stable = stable_row_ids if old is None else old.next_row_id is not None
        made = Manifest(number, fields, [], config=old.config if old else {}, metadata=old.metadata if old else {}, next_fragment=old.next_fragment if old else 0,
                        next_field=ids, next_row_id=(old.next_row_id if old else 0) if stable else None)
        Table._add(made, files, number, _schema_of(made))
        return made

    log.commit(base, {"operation": "Overwrite", "keys": []}, change)
    return Table(spark, root)


def commit_batch(spark: SparkSession, root: str, batches: list[list[dict]], read_version: int | None = None) -> Table:
    """Several writers' files appended as one version, or none of them."""
    return commit(spark, root, [f for b in batches for f in b], "append", read_version)

"""A versioned table: Parquet files under a root and a log of manifests.

Every change commits one new version; readers of a version never see another. A row's address is its
fragment's number shifted left by 32 bits, plus its place in the file. Deletions are files of addresses that
scans anti-join; patches (added columns, overlays) are files keyed by address that scans join only when a
patched column is read. A file is never changed.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import emit
from brindle.functions.dialect import DialectError
from brindle.sources.manifest import CommitConflict, Fragment, Log, Manifest, RetryableConflict
from brindle.sources.store import Store

ROWS_PER_FILE = 1 << 20
BROADCAST_ROWS = 1_000_000  # of addresses; more are joined by a shuffle
BROADCAST_FRAGMENTS = 100_000
LISTED = 32  # files that are read by their names; of more, a folder whose files are all wanted is listed as one
SYSTEM = ("_rowid", "_rowaddr", "_row_created_at_version", "_row_last_updated_at_version")
_KEPT = T.StructType([T.StructField("__rowid", T.LongType()), T.StructField("__created", T.LongType()), T.StructField("__updated", T.LongType())])


def _type(spec: dict) -> T.DataType:
    return T._parse_datatype_json_value(spec["type"])


def _fitting(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hinted for broadcast where the manifest knows that it is small."""
    return F.broadcast(df) if rows <= most else df


class Table:
    def __init__(self, spark: SparkSession, root: str, version: int | str | None = None, branch: str | None = None, asof: float | None = None):
        self.spark, self.store = spark, Store(spark, root)
        self.root = self.store.root
        self.log = Log(self.store, branch)
        if asof is not None:
            found = [m for m in map(self.log.read, self.log.versions()) if m.timestamp <= asof]
            if not found:
                raise ValueError(f"no version at or before {asof}")
            version = found[-1].version
        if isinstance(version, str):
            version = self._tags()[version]["version"]
        self.manifest = self.log.read(self.log.latest() if version is None else version)

    # -- opening and writing -------------------------------------------------------------------------------

    @classmethod
    def write(cls, df: DataFrame, root: str, mode: str = "create", stable_row_ids: bool = False, rows_per_file: int = ROWS_PER_FILE, message: str | None = None, config: dict[str, str] | None = None) -> "Table":
        """create: the root must have no table; append; overwrite: a new version with df's schema and rows, and config."""
        spark = df.sparkSession
        log = Log(Store(spark, root))
        log.extra = config or {}
        exists = bool(log.versions())
        if mode == "create" and exists:
            raise FileExistsError(f"there is a table at {root}")
        if mode not in ("create", "append", "overwrite"):
            raise ValueError(f"mode {mode!r}")
        if mode == "append" and exists:
            table = cls(spark, root)
            table.log.extra = config or {}
            return table.append(df, rows_per_file)
        base = log.read(log.latest()) if exists else None
        fields, ids = cls._fields(df.schema, 0 if base is None else base.next_field)
        files = cls._write_files(log.store, df.select(*[F.col(emit.quote(f["name"])).alias(f["column"]) for f in fields]), rows_per_file)

        def change(old: Manifest | None, number: int) -> Manifest:
            stable = stable_row_ids if old is None else old.next_row_id is not None
            made = Manifest(number, fields, [], config=old.config if old else {}, metadata=old.metadata if old else {}, next_fragment=old.next_fragment if old else 0,
                            next_field=ids, next_row_id=(old.next_row_id if old else 0) if stable else None)
            cls._add(made, files, number, _schema_of(made))
            return made

        log.commit(base, {"operation": "Overwrite", "message": message, "keys": []}, change)
        return cls(spark, root)

    @staticmethod
    def _fields(schema: T.StructType, first: int) -> tuple[list[dict], int]:
        fields = []
        for k, f in enumerate(schema.fields):
            t = T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType
            fields.append({"id": first + k, "name": f.name, "type": json.loads(t.json()), "nullable": f.nullable, "column": f.name, "metadata": dict(f.metadata or {})})
        return fields, first + len(fields)

    @staticmethod
    def _write_files(store: Store, df: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> list[tuple[str, int, int]]:
        """(file, rows, bytes) of df written below the root."""
        spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
        void = {f.name: F.col(emit.quote(f.name)).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
        df = df.withColumns(void)
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(store.at(folder))
        written = spark.read.schema(df.schema).parquet(store.at(folder)).groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("b")).count().collect()  # a row a file
        return sorted((f"{folder}/{r['f']}", r["count"], r["b"]) for r in written)

    @staticmethod
    def _add(m: Manifest, files: list[tuple[str, int, int]], number: int, schema: int, take_ids: bool = True) -> list[int]:
        ids = []
        for file, rows, size in files:
            first = m.next_row_id if take_ids else None
            m.fragments.append(Fragment(m.next_fragment, file, rows, schema, number, first, 0, size))
            ids.append(m.next_fragment)
            m.next_fragment += 1
            if take_ids and m.next_row_id is not None:
                m.next_row_id += rows
        return ids

    def _again(self, manifest: Manifest) -> "Table":
        self.manifest = manifest
        return self

    def append(self, df: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> "Table":
        """Rows by column name; columns that df lacks are null, others are refused."""
        m = self.manifest
        files = self._write_files(self.store, self._aligned(df), rows_per_file)

        def change(old: Manifest, number: int) -> Manifest:
            self._add(old, files, number, _schema_of(old, m.fields))
            return old

        return self._again(self.log.commit(m, {"operation": "Append", "fragments": []}, change))

    def _aligned(self, df: DataFrame) -> DataFrame:
        """df with the columns of the table's files."""
        m = self.manifest
        names = [f["name"] for f in m.fields]
        extra = [c for c in df.columns if c not in names]
        if extra:
            raise ValueError(f"the table has no columns {extra}")
        cols = []
        for f in m.fields:
            if f["name"] in df.columns:
                cols.append(F.col(emit.quote(f["name"])).cast(_type(f)).alias(f["column"]))
            elif f["nullable"]:
                cols.append(F.lit(None).cast(_type(f)).alias(f["column"]))
            else:
                raise ValueError(f"column {f['name']} can't be null")
        return df.select(*cols)

    # -- reading -------------------------------------------------------------------------------------------

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], _type(f), f["nullable"], f["metadata"]) for f in self.manifest.fields])

    @property
    def version(self) -> int:
        return self.manifest.version

    def to_df(self, system: bool = False, fragments: list[int] | None = None, deleted: bool = False, columns: list[str] | None = None) -> DataFrame:
        """The version's rows; system: with _rowid, _rowaddr and the version columns.

        fragments: only those. deleted: deleted rows too, with a null _rowid. columns: read only these, which
        spares the joins with patches of others.
        """
        m, spark = self.manifest, self.spark
        wanted = [f for f in m.fields if columns is None or f["name"] in columns]
        asked = None if fragments is None else set(fragments)
        live = [f for f in m.fragments if asked is None or f.id in asked]
        patches = [p for p in m.patches if any(f["id"] in p["fields"] for f in wanted)]
        dead = sum(f.deleted for f in live)
        addressed = system or dead > 0 or bool(patches) or deleted
        parts = [self._read(live_of, kind, wanted, addressed) for kind, live_of in _by_schema(live).items()]
        if not parts:
            empty = T.StructType([T.StructField(f["name"], _type(f)) for f in wanted] + [T.StructField(s, T.LongType()) for s in SYSTEM])
            df = spark.createDataFrame([], empty)
        else:
            df = reduce(DataFrame.unionByName, parts)
        if dead and m.deletions:
            gone = spark.read.parquet(*[self.store.at(d["path"]) for d in m.deletions]).select(F.col("addr").alias("_rowaddr"))
            gone = _fitting(gone, sum(d["rows"] for d in m.deletions))
            if deleted:
                df = df.join(gone.withColumn("__gone", F.lit(True)), "_rowaddr", "left").withColumn("_rowid", F.when(F.col("__gone").isNull(), F.col("_rowid"))).drop("__gone")
            else:
                df = df.join(gone, "_rowaddr", "left_anti")
        for p in patches:
            df = self._patched(df, p, wanted)
        return df.select(*[F.col(emit.quote(f["name"])) for f in wanted], *(SYSTEM if system or deleted else ()))

    def _read(self, fragments: list[Fragment], kind: int, wanted: list[dict], addressed: bool) -> DataFrame:
        m, spark = self.manifest, self.spark
        held = {h["id"]: h for h in m.schemas[kind]}
        schema = T.StructType([T.StructField(h["column"], T._parse_datatype_json_value(h["type"])) for h in m.schemas[kind]] + _KEPT.fields)
        df = spark.read.schema(schema).parquet(*[self.store.at(p) for p in self._paths([f.file for f in fragments])])
        cols = []
        for f in wanted:
            h = held.get(f["id"])
            col = F.lit(None).cast(_type(f)) if h is None else F.col(emit.quote(h["column"]))
            cols.append(col.alias(f["name"]) if h is None else _as(col, T._parse_datatype_json_value(h["type"]), _type(f)).alias(f["name"]))
        if not addressed:
            return df.select(*cols)
        known = spark.createDataFrame(
            [(f.file.rpartition("/")[2], f.id, f.version, f.first_row_id) for f in fragments], "__file string, __frag long, __version long, __first long")
        df = df.withColumns({"__file": F.col("_metadata.file_name"), "__pos": F.col("_metadata.row_index")}).join(_fitting(known, len(fragments), BROADCAST_FRAGMENTS), "__file")
        addr = F.shiftleft(F.col("__frag"), 32) + F.col("__pos")
        row_id = F.coalesce("__rowid", F.col("__first") + F.col("__pos")) if m.next_row_id is not None else addr
        return df.select(*cols, row_id.alias("_rowid"), addr.alias("_rowaddr"), F.coalesce("__created", "__version").alias("_row_created_at_version"), F.coalesce("__updated", "__version").alias("_row_last_updated_at_version"))

    def _paths(self, files: list[str]) -> list[str]:
        """The files, or their folders: Spark looks up each path given to it by itself."""
        if len(files) <= LISTED:
            return files
        held: dict[str, list[str]] = {}
        for f in files:
            held.setdefault(f.rpartition("/")[0], []).append(f.rpartition("/")[2])
        out = []
        for folder, names in held.items():
            whole = len(names) > 1 and self.store.count(folder, ".parquet") == len(names)
            out += [folder] if whole else [f"{folder}/{n}" for n in names]
        return out

    def _patched(self, df: DataFrame, patch: dict, wanted: list[dict]) -> DataFrame:
        fields = [f for f in wanted if f["id"] in patch["fields"]]
        rows = self.spark.read.parquet(self.store.at(patch["path"]))
        p = rows.select(F.col("addr").alias("_rowaddr"), *[F.col(f"f{f['id']}").cast(_type(f)).alias(f"__p{f['id']}") for f in fields], F.lit(True).alias("__hit"))
        df = df.join(_fitting(p, patch["rows"], BROADCAST_ROWS // 10), "_rowaddr", "left")
        df = df.withColumns({f["name"]: F.when(F.col("__hit"), F.col(f"__p{f['id']}")).otherwise(F.col(emit.quote(f["name"]))) for f in fields})
        return df.withColumn("_row_last_updated_at_version", F.when(F.col("__hit") & F.lit(patch["overlay"]), F.lit(patch["version"])).otherwise(F.col("_row_last_updated_at_version"))).drop("__hit", *[f"__p{f['id']}" for f in fields])

    def count_rows(self, filter: str | None = None) -> int:
        """From the manifest alone without a filter."""
        if not filter or not filter.strip():
            return self.manifest.rows
        return self.to_df().where(emit.condition(filter, self.schema, self.spark)).count()

    def fragments(self) -> list[Fragment]:
        return list(self.manifest.fragments)

    def scan(self, **how):
        from brindle.operators.scan import Scan

        return Scan(self, **how)

    def sql(self, query: str, name: str = "dataset", **how) -> DataFrame:
        from brindle.plans.sql import run

        return run(query, self, name, **how)

    # -- row changes ---------------------------------------------------------------------------------------

    def _matched(self, predicate: str) -> DataFrame:
        if not predicate or not predicate.strip():
            raise DialectError("an empty predicate")
        df = self.to_df(system=True)
        return df.where(emit.condition(predicate, df.schema, self.spark))

    def _addresses(self, df: DataFrame) -> tuple[str, dict[int, int]]:
        """Addresses (addr) written to a deletion folder; how many of each fragment."""
        folder = f"_deletions/{uuid.uuid4().hex}"
        df.write.parquet(self.store.at(folder))
        per = self.spark.read.parquet(self.store.at(folder)).groupBy(F.shiftright("addr", 32).alias("f")).count().collect()  # a row a fragment
        return folder, {r["f"]: r["count"] for r in per}

    @staticmethod
    def _strike(m: Manifest, folder: str, per: dict[int, int]) -> None:
        for f in m.fragments:
            f.deleted += per.get(f.id, 0)
        gone = {f.id for f in m.fragments if not f.live}
        m.fragments = [f for f in m.fragments if f.id not in gone]
        m.deletions.append({"path": folder, "rows": sum(per.values())})

    def delete(self, predicate: str) -> dict:
        """Strike the rows that match. Deletions committed meanwhile are kept, in the same fragments too."""
        folder, per = self._addresses(self._matched(predicate).select(F.col("_rowaddr").alias("addr")))
        while per:
            def change(old: Manifest, number: int, folder: str = folder, per: dict[int, int] = per) -> Manifest:
                self._strike(old, folder, per)
                return old

            try:
                self._again(self.log.commit(self.manifest, {"operation": "Delete", "fragments": list(per)}, change))
                break
            except RetryableConflict:
                others = [self.log.read(v) for v in self.log.versions() if v > self.manifest.version]
                if any(m.transaction["operation"] != "Delete" for m in others):
                    raise
                # Only deletions came between, so addresses stand; those struck already are left out.
                self.manifest = others[-1]
                gone = self.spark.read.parquet(*[self.store.at(d["path"]) for d in self.manifest.deletions]).select("addr")
                folder, per = self._addresses(self.spark.read.parquet(self.store.at(folder)).join(gone, "addr", "left_anti"))
        return {"num_deleted_rows": sum(per.values())}

    def truncate(self) -> dict:
        return self.delete("true")

    def _rewrite(self, moved: DataFrame, fresh: DataFrame | None, dropped: DataFrame | None, operation: str = "Update") -> dict:
        """Commit moved rows (table columns, __addr, __rowid, __created) in place of their old ones, fresh rows, and dropped addresses."""
        m = self.manifest
        shape = [F.col(emit.quote(f["name"])).cast(_type(f)).alias(f["column"]) for f in m.fields]
        kept = moved.select(*shape, F.col("__rowid"), F.col("__created"), F.col("__addr"))
        files = self._write_files(self.store, kept)
        new = self._write_files(self.store, fresh.select(*shape)) if fresh is not None else []
        n_moved = sum(n for _, n, _ in files)
        gone = None
        if files:
            gone = self.spark.read.parquet(*[self.store.at(f) for f, _, _ in files]).select(F.col("__addr").alias("addr"))
        if dropped is not None:
            gone = dropped if gone is None else gone.unionByName(dropped)
        folder, per = self._addresses(gone.distinct()) if gone is not None else ("", {})
        if not (files or new or per):
            return {"moved": 0, "fresh": 0, "gone": 0}

        def change(old: Manifest, number: int) -> Manifest:
            kind = _schema_of(old, m.fields)
            if per:
                self._strike(old, folder, per)
            self._add(old, files, number, kind, take_ids=False)
            self._add(old, new, number, kind)
            return old

        self._again(self.log.commit(m, {"operation": operation, "fragments": list(per), "added": bool(files or new)}, change))
        return {"moved": n_moved, "fresh": sum(n for _, n, _ in new), "gone": sum(per.values())}

    @staticmethod
    def _keep(df: DataFrame) -> DataFrame:
        return df.withColumns({"__rowid": F.col("_rowid"), "__created": F.col("_row_created_at_version"), "__addr": F.col("_rowaddr")})

    def update(self, values: dict[str, str], where: str | None = None) -> dict:
        """Set columns to expressions over the old row."""
        names = self.schema.fieldNames()
        df = self._matched(where) if where else self.to_df(system=True)
        made = {}
        for name, text in values.items():
            own = emit.resolve(name, names)
            made[own] = emit.column(text, df.schema, self.spark).cast(self.schema[own].dataType)
        done = self._rewrite(self._keep(df).withColumns(made), None, None)
        return {"num_updated_rows": done["moved"], "num_rows_updated": done["moved"]}

    def merge_insert(self, on: str | list[str] | None = None):
        from brindle.operators.merge import MergeInsert

        keys = [on] if isinstance(on, str) else on or self.manifest.config.get("primary_key", "").split(",")
        if not keys or not keys[0]:
            raise ValueError("merge_insert needs key columns")
        return MergeInsert(self, keys)

    # -- columns -------------------------------------------------------------------------------------------

    def add_columns(self, new: dict[str, str] | T.StructType | DataFrame, on: str = "_rowid") -> "Table":
        """Columns by expression ({name: text}), all null (a schema), or from a DataFrame keyed by `on`."""
        m, schema = self.manifest, self.schema
        names = list(new) if isinstance(new, dict) else new.fieldNames() if isinstance(new, T.StructType) else [c for c in new.columns if c != on]
        clash = [n for n in names if n in schema.fieldNames()]
        if clash:
            raise ValueError(f"columns {clash} exist")
        if isinstance(new, T.StructType):
            fields, nxt = self._fields(T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in new.fields]), m.next_field)
            return self._evolve(fields, nxt, None, "Merge")
        df = self.to_df(system=True)
        if isinstance(new, dict):
            got = df.select(F.col("_rowaddr").alias("addr"), *[emit.column(t, df.schema, self.spark).alias(n) for n, t in new.items()])
        else:
            got = df.select("_rowaddr", on).join(new, on).select(F.col("_rowaddr").alias("addr"), *names)
        fields, nxt = self._fields(T.StructType([T.StructField(f.name, f.dataType, True) for f in got.drop("addr").schema.fields]), m.next_field)
        return self._evolve(fields, nxt, got, "Merge")

    def _patch(self, got: DataFrame, fields: list[dict], overlay: bool) -> dict:
        path = f"_patches/{uuid.uuid4().hex}"
        got.select("addr", *[F.col(emit.quote(f["name"])).alias(f"f{f['id']}") for f in fields]).write.parquet(self.store.at(path))
        n = self.spark.read.parquet(self.store.at(path)).count()
        return {"path": path, "fields": [f["id"] for f in fields], "rows": n, "overlay": overlay, "version": self.manifest.version + 1}

    def _evolve(self, fields: list[dict], next_field: int, got: DataFrame | None, operation: str) -> "Table":
        taken = {h["column"] for s in self.manifest.schemas for h in s}
        for f in fields:
            f["column"] = f["name"] if f["name"] not in taken else f"{f['name']}__{f['id']}"
        patch = self._patch(got, fields, False) if got is not None else None

        def change(old: Manifest, number: int) -> Manifest:
            old.fields += fields
            old.next_field = next_field
            if patch:
                old.patches.append(patch)
            return old

        return self._again(self.log.commit(self.manifest, {"operation": operation, "fragments": [f.id for f in self.manifest.fragments]}, change))

    def overlay(self, df: DataFrame, on: str = "_rowid") -> "Table":
        """Set cells: df's columns replace those of the rows it names; a null replaces too. Files stay."""
        fields = [f for f in self.manifest.fields if f["name"] in df.columns and f["name"] != on]
        if not fields:
            raise ValueError("no column of the table to set")
        base = self.to_df(system=True, columns=[on] if on in self.schema.fieldNames() else [])
        got = base.select(F.col("_rowaddr").alias("addr"), on).join(df.select(on, *[emit.quote(f["name"]) for f in fields]), on).drop(on)
        patch = self._patch(got, fields, True)
        touched = [r[0] for r in got.select(F.shiftright("addr", 32)).distinct().collect()]  # a row a fragment

        def change(old: Manifest, number: int) -> Manifest:
            old.patches.append(patch | {"version": number, "touched": touched})
            return old

        return self._again(self.log.commit(self.manifest, {"operation": "DataOverlay", "fragments": touched}, change))

    def drop_columns(self, names: list[str]) -> "Table":
        """Columns, or struct fields as `struct.child`; files stay as they are."""
        fields = [dict(f) for f in self.manifest.fields]
        for name in names:
            own = next((f for f in fields if f["name"] == name), None)
            if own:
                fields.remove(own)
                continue
            top, _, child = name.partition(".")
            own = next((f for f in fields if f["name"] == top and child), None)
            if own is None or not isinstance(_type(own), T.StructType) or child not in _type(own).fieldNames():
                raise ValueError(f"no column {name}")
            left = [f for f in _type(own).fields if f.name != child]
            own["type"] = json.loads(T.StructType(left).json())
        if not fields:
            raise ValueError("a table keeps one column at least")

        def change(old: Manifest, number: int) -> Manifest:
            old.fields = fields
            return old

        return self._again(self.log.commit(self.manifest, {"operation": "Project", "fragments": []}, change))

    _FAMILIES = [("byte", "short", "integer", "long"), ("float", "double"), ("string",), ("timestamp", "timestamp_ntz", "date")]

    def alter_columns(self, *changes: dict) -> "Table":
        """{path, name?, nullable?, data_type?}; types change within their family only."""
        fields = [dict(f) for f in self.manifest.fields]
        for c in changes:
            f = next((f for f in fields if f["name"] == c["path"]), None)
            if f is None:
                raise ValueError(f"no column {c['path']}")
            if c.get("data_type"):
                to = c["data_type"] if isinstance(c["data_type"], T.DataType) else emit.data_type(c["data_type"])
                old, new = _type(f), json.loads(to.json())
                if not any(f["type"] in k and new in k for k in self._FAMILIES if isinstance(f["type"], str)) and not (isinstance(old, T.DecimalType) and isinstance(to, T.DecimalType)):
                    raise ValueError(f"{c['path']} can't change from {f['type']} to {new}")
                bad = self.to_df(columns=[f["name"]]).where(F.col(emit.quote(f["name"])).isNotNull() & F.col(emit.quote(f["name"])).try_cast(to).isNull())
                if bad.limit(1).count():
                    raise ValueError(f"values of {c['path']} don't fit {new}")
                f["type"] = new
            if c.get("nullable") is not None:
                if not c["nullable"] and self.to_df(columns=[f["name"]]).where(F.col(emit.quote(f["name"])).isNull()).limit(1).count():
                    raise ValueError(f"{c['path']} holds nulls")
                f["nullable"] = c["nullable"]
            if c.get("name"):
                f["name"] = c["name"]
        names = [f["name"] for f in fields]
        if len(set(names)) < len(names):
            raise ValueError("two columns would have one name")

        def change(old: Manifest, number: int) -> Manifest:
            old.fields = fields
            return old

        return self._again(self.log.commit(self.manifest, {"operation": "Project", "fragments": []}, change))

    def merge(self, right: DataFrame, left_on: str, right_on: str | None = None) -> "Table":
        """Left join that adds right's columns; of repeated keys the last row counts, null keys meet nothing."""
        right_on = right_on or left_on
        names = [c for c in right.columns if c != right_on]
        if any(n in self.schema.fieldNames() for n in names):
            raise ValueError("a column exists on both sides")
        if any(f.deleted for f in self.manifest.fragments):
            raise ValueError("the table has deleted rows; compact it first")
        last = right.where(F.col(right_on).isNotNull()).withColumn("__n", F.monotonically_increasing_id()).groupBy(right_on).agg(F.max_by(F.struct(*names), "__n").alias("__r"))
        df = self.to_df(system=True, columns=[left_on]).select(F.col("_rowaddr").alias("addr"), F.col(left_on).alias("__k"))
        got = df.join(last, F.col("__k") == F.col(right_on)).select("addr", "__r.*")
        fields, nxt = self._fields(T.StructType([T.StructField(f.name, f.dataType, True) for f in got.drop("addr").schema.fields]), self.manifest.next_field)
        return self._evolve(fields, nxt, got, "Merge")

    # -- versions, refs, settings --------------------------------------------------------------------------

    def versions(self) -> list[dict]:
        return [{"version": m.version, "timestamp": m.timestamp, "operation": m.transaction.get("operation"), "rows": m.rows, "fragments": len(m.fragments)} for m in map(self.log.read, self.log.versions())]

    def checkout(self, version: int | str | None = None) -> "Table":
        return Table(self.spark, self.root, version, self.log.branch)

    def restore(self) -> "Table":
        """A new version that equals the one checked out."""
        mine, latest = self.manifest, self.log.read(self.log.latest())

        def change(old: Manifest, number: int) -> Manifest:
            made = Manifest.loads(mine.dumps())
            made.next_fragment, made.next_field = max(old.next_fragment, made.next_fragment), max(old.next_field, made.next_field)
            if made.next_row_id is not None and old.next_row_id is not None:
                made.next_row_id = max(made.next_row_id, old.next_row_id)
            return made

        return self._again(self.log.commit(latest, {"operation": "Restore"}, change))

    def _tags(self) -> dict[str, dict]:
        return json.loads(self.store.read("_refs/tags.json")) if self.store.exists("_refs/tags.json") else {}

    def tags(self) -> dict[str, dict]:
        return self._tags()

    def tag(self, name: str, version: int | None = None, replace: bool = False) -> None:
        tags = self._tags()
        if (name in tags) != replace:
            raise ValueError(f"tag {name} " + ("exists" if name in tags else "doesn't exist"))
        at = version or self.version
        self.log.read(at)
        self.store.replace("_refs/tags.json", json.dumps(tags | {name: {"version": at, "branch": self.log.branch}}))

    def delete_tag(self, name: str) -> None:
        tags = self._tags()
        del tags[name]
        self.store.replace("_refs/tags.json", json.dumps(tags))

    def create_branch(self, name: str) -> "Table":
        """A branch that begins with this version and shares its files."""
        log = Log(self.store, name)
        if log.versions():
            raise ValueError(f"branch {name} exists")
        mine = self.manifest
        log.commit(None, {"operation": "Clone"}, lambda old, number: Manifest.loads(mine.dumps()))
        return Table(self.spark, self.root, branch=name)

    def branches(self) -> list[str]:
        return self.store.folders("tree")

    def delete_branch(self, name: str) -> None:
        if name not in self.branches():
            raise ValueError(f"no branch {name}")
        self.store.delete(f"tree/{name}")

    def clone(self, root: str, deep: bool = False) -> "Table":
        """shallow: a table elsewhere that refers to this one's files; deep: with copies of them."""
        to = Store(self.spark, root)
        mine = Manifest.loads(self.manifest.dumps())
        where = (lambda name: name) if deep else self.store.at
        for f in mine.fragments:
            f.file = where(f.file)
        mine.deletions, mine.patches = ([p | {"path": where(p["path"])} for p in part] for part in (mine.deletions, mine.patches))
        if deep:
            for name in dict.fromkeys([*(f.file for f in mine.fragments), *(p["path"] for p in [*mine.deletions, *mine.patches])]):
                self.store.copy(name, to.at(name))
        Log(to).commit(None, {"operation": "Clone"}, lambda old, number: mine)
        return Table(self.spark, root)

    def config(self, values: dict[str, str | None], kind: str = "config") -> "Table":
        """Set (or with None unset) table settings, or with kind 'metadata' its metadata."""

        def change(old: Manifest, number: int) -> Manifest:
            held = getattr(old, kind)
            for k, v in values.items():
                held.pop(k, None) if v is None else held.update({k: v})
            return old

        return self._again(self.log.commit(self.manifest, {"operation": "UpdateConfig", "keys": [f"{kind}.{k}" for k in values]}, change))

    def field_metadata(self, name: str, values: dict) -> "Table":
        def change(old: Manifest, number: int) -> Manifest:
            next(f for f in old.fields if f["name"] == name)["metadata"] = values
            return old

        return self._again(self.log.commit(self.manifest, {"operation": "UpdateConfig", "keys": [f"field.{name}"]}, change))

    def transactions(self, begin: int = 0, end: int | None = None) -> list[dict]:
        return [m.transaction | {"version": m.version} for m in map(self.log.read, self.log.versions()) if begin < m.version <= (end or self.version)]

    # -- upkeep --------------------------------------------------------------------------------------------

    def compact(self, target_rows: int = ROWS_PER_FILE, deleted_share: float = 0.1) -> dict:
        """Rewrite neighbouring small fragments, and those with many deletions, as files of about target_rows."""
        from brindle.operators.compact import commit, execute, plan

        tasks = plan(self, target_rows, deleted_share)
        return commit(self, [execute(self, t) for t in tasks])

    def delta(self, begin: int, end: int | None = None):
        from brindle.operators.delta import Delta

        return Delta(self, begin, self.version if end is None else end)

    def tracked_files(self) -> DataFrame:
        """(version, path, type) of every file or folder that a version refers to."""
        rows = []
        for m in map(self.log.read, self.log.versions()):
            rows += [(m.version, f.file, "data") for f in m.fragments] + [(m.version, d["path"], "deletion") for d in m.deletions] + [(m.version, p["path"], "patch") for p in m.patches]
            rows += [(m.version, i["path"], "index") for i in m.indexes]
        return self.spark.createDataFrame(rows, "version long, path string, type string")

    def all_files(self) -> DataFrame:
        return self.spark.createDataFrame(self.store.list("", True), "path string, size_bytes long, last_modified long")

    def cleanup(self, older_than: float = 14 * 86400, keep: int = 1, dry_run: bool = False) -> dict:
        """Delete versions older than so many seconds, but tagged ones and the newest `keep`, and files no version refers to."""
        branches = [None, *self.branches()]
        now, tagged = time.time(), {(t["branch"], t["version"]) for t in self._tags().values()}
        gone, held = [], set()
        for b in branches:
            log = Log(self.store, b)
            versions = log.versions()
            for v in versions:
                m = log.read(v)
                if b == self.log.branch and v not in versions[-max(1, keep):] and (b, v) not in tagged and m.timestamp < now - older_than:
                    gone.append(log._name(v))
                else:
                    held |= {f.file for f in m.fragments} | {p["path"] for p in [*m.deletions, *m.patches, *m.indexes]}
        old = [(p, n) for top in ("data", "_deletions", "_patches", "_indices") for p, n, t in self.store.list(top, True) if t / 1000 < now - older_than]
        loose = [(p, n) for p, n in old if not any(p.endswith("/" + h) or f"/{h}/" in p for h in self._ancestors(p, held))]
        if not dry_run:
            for name in [*gone, *(p for p, _ in loose)]:
                self.store.delete(name)
        return {"old_versions": len(gone), "files": len(loose), "bytes_removed": sum(n for _, n in loose)}

    @staticmethod
    def _ancestors(path: str, held: set[str]) -> list[str]:
        parts = path.split("/")
        return [n for k in range(1, 5) if (n := "/".join(parts[-k:])) in held] + [n for k in range(1, 5) for j in range(1, 3) if (n := "/".join(parts[-k - j : -j])) in held]

    def validate(self) -> list[str]:
        """What is wrong: missing files, wrong row counts, repeated fragment ids."""
        m, wrong = self.manifest, []
        ids = [f.id for f in m.fragments]
        if len(set(ids)) < len(ids):
            wrong.append("fragment ids repeat")
        wrong += [f"missing: {n}" for n in [*(f.file for f in m.fragments), *(p["path"] for p in [*m.deletions, *m.patches])] if not self.store.exists(n)]
        if not wrong and m.fragments:
            files = self.spark.read.parquet(*[self.store.at(f.file) for f in m.fragments]).groupBy(F.col("_metadata.file_name").alias("f")).count()
            n = {r["f"]: r["count"] for r in files.collect()}  # a row a fragment
            wrong += [f"{f.file} has {n.get(f.file.rpartition('/')[2], 0)} rows, not {f.rows}" for f in m.fragments if n.get(f.file.rpartition("/")[2], 0) != f.rows]
        return wrong

    def stats(self) -> dict:
        m = self.manifest
        return {"version": m.version, "num_fragments": len(m.fragments), "num_rows": m.rows, "num_deleted_rows": sum(f.deleted for f in m.fragments),
                "num_small_files": sum(f.rows < 1024 * 1024 for f in m.fragments), "bytes": sum(f.bytes for f in m.fragments)}

    def data_stats(self) -> list[dict]:
        """Bytes on disk by field, from Parquet footers read on the executors."""
        files = [self.store.at(f.file) for f in self.manifest.fragments]
        names = {h["column"]: f["name"] for f in self.manifest.fields for s in self.manifest.schemas for h in s if h["id"] == f["id"]}
        df = self.spark.read.format("binaryFile").load(files) if files else None

        def run(batches):
            import io

            import pandas as pd
            import pyarrow.parquet as pq

            for b in batches:
                rows = []
                for content in b["content"]:
                    meta = pq.ParquetFile(io.BytesIO(content)).metadata
                    for g in range(meta.num_row_groups):
                        for c in range(meta.num_columns):
                            col = meta.row_group(g).column(c)
                            rows.append((col.path_in_schema.split(".")[0], col.total_compressed_size))
                yield pd.DataFrame(rows, columns=["field", "bytes"])

        got = df.select("content").mapInPandas(run, "field string, bytes long").groupBy("field").agg(F.sum("bytes").alias("bytes")).collect() if files else []
        sizes = {names.get(r["field"], r["field"]): r["bytes"] for r in got}
        return [{"field": f["name"], "bytes_on_disk": sizes.get(f["name"], 0)} for f in self.manifest.fields]

    @staticmethod
    def drop(spark: SparkSession, root: str) -> None:
        Store(spark, root).delete("")


def _as(col: Column, held: T.DataType, wanted: T.DataType) -> Column:
    """A file's column as the table has it now: cast, struct fields by name."""
    if held == wanted:
        return col
    if isinstance(held, T.StructType) and isinstance(wanted, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_as(col.getField(f.name), held[f.name].dataType, f.dataType).alias(f.name) for f in wanted.fields]))
    return col.cast(wanted)


def _by_schema(fragments: list[Fragment]) -> dict[int, list[Fragment]]:
    out: dict[int, list[Fragment]] = {}
    for f in fragments:
        out.setdefault(f.schema, []).append(f)
    return out


def _schema_of(m: Manifest, fields: list[dict] | None = None) -> int:
    """The number of the file schema of these fields in m, which gets it where it is new."""
    shape = [{"id": f["id"], "column": f["column"], "type": f["type"]} for f in fields or m.fields]
    if shape not in m.schemas:
        m.schemas.append(shape)
    return m.schemas.index(shape)


def stitch(spark: SparkSession, roots: list[str], to: str) -> Table:
    """One table of the files of several with one schema; nothing is written but a manifest."""
    tables = [Table(spark, r) for r in roots]
    first = tables[0]
    if any(t.schema != first.schema for t in tables):
        raise ValueError("the tables' schemas differ")
    if any(t.manifest.deletions or t.manifest.patches for t in tables):
        raise ValueError("compact tables with deletions or patches first")

    def change(old, number: int) -> Manifest:
        made = Manifest(number, first.manifest.fields, next_field=first.manifest.next_field)
        for t in tables:
            for f in t.manifest.fragments:
                Table._add(made, [(t.store.at(f.file), f.rows, f.bytes)], number, _schema_of(made, t.manifest.fields))
        return made

    Log(Store(spark, to)).commit(None, {"operation": "Overwrite", "keys": []}, change)
    return Table(spark, to)


__all__ = ["CommitConflict", "RetryableConflict", "Table", "stitch"]

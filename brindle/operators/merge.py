"""Upserts: source rows against a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import emit
from brindle.session import stash, unstash


class MergeInsert:
    """Null keys match nothing. Of target rows that repeat a key only the last is matched.

    Source rows that repeat a key are each written if the source has all columns; where it has a part of them,
    a target row that several source rows match is an error. A part keeps a matched row's other values.
    """

    def __init__(self, table, keys: list[str]):
        self.table, self.keys = table, keys
        self._matched = self._insert = None
        self._condition = self._by_source = None
        self._columns_only = False

    def when_matched_update_all(self, condition: str | None = None) -> "MergeInsert":
        self._matched, self._condition = "update", condition
        return self

    def when_matched_fail(self) -> "MergeInsert":
        self._matched = "fail"
        return self

    def when_matched_delete(self) -> "MergeInsert":
        self._matched = "delete"
        return self

    def when_not_matched_insert_all(self) -> "MergeInsert":
        self._insert = True
        return self

    def when_not_matched_by_source_delete(self, condition: str | None = None) -> "MergeInsert":
        self._by_source = condition or "true"
        return self

    def rewrite_columns(self) -> "MergeInsert":
        """Patch the source's columns in place; updates only."""
        self._columns_only = True
        return self

    def plan(self, source: DataFrame) -> DataFrame:
        """Rows (s: source row or null, t: target row or null, matched) of the merge."""
        table, keys = self.table, self.keys
        fields = [f["name"] for f in table.manifest.fields]
        unknown = [c for c in source.columns if c not in fields]
        if unknown or any(k not in source.columns or k not in fields for k in keys):
            raise ValueError(f"unknown columns {unknown}" if unknown else f"both sides need the keys {keys}")
        if source.schema.fieldNames() != fields:
            source = source.select(*[emit.quote(c) for c in fields if c in source.columns])
        types = {f: table.schema[f].dataType for f in fields}
        s = source.select(F.struct(*[F.col(emit.quote(c)).cast(types[c]).alias(c) for c in source.columns]).alias("s"), *[F.col(emit.quote(k)).cast(types[k]).alias(f"__k{i}") for i, k in enumerate(keys)])
        target = table.to_df(system=True)
        t = target.select(F.struct(*target.columns).alias("t"), *[F.col(emit.quote(k)).alias(f"__k{i}") for i, k in enumerate(keys)])
        names = [f"__k{i}" for i in range(len(keys))]
        known = F.col(names[0]).isNotNull()
        for k in names[1:]:
            known = known & F.col(k).isNotNull()
        # The last target row of each key that the source has. The source's keys are the smaller side, so they go to the target.
        wanted = s.where(known).select(*names).distinct()
        last = t.join(wanted, names, "left_semi").groupBy(*names).agg(F.max(F.col("t._rowaddr")).alias("__last"))
        t = t.join(last, names, "left").withColumn("__own", known & (F.col("t._rowaddr") == F.col("__last"))).drop("__last")
        hit = s.where(known).join(t.where("__own").drop("__own"), names, "left").select("s", "t")
        rest = s.where(~known).select("s", F.lit(None).cast(t.schema["t"].dataType).alias("t"))
        out = hit.unionByName(rest)
        if self._by_source is not None:
            others = t.where(~F.coalesce(F.col("__own"), F.lit(False))).select(F.lit(None).cast(s.schema["s"].dataType).alias("s"), "t")
            out = out.unionByName(others)
        return out

    def _decided(self, planned: DataFrame) -> DataFrame:
        """planned with the condition's value as __when; both rows stand under the names that conditions use."""
        schema = T.StructType([T.StructField("source", self._row_type("s")), T.StructField("target", self._row_type("t"))])
        made, _ = emit.to_sql(self._condition, schema)
        both = planned.select("*", F.col("s").alias("source"), F.col("t").alias("target"))
        return both.withColumn("__when", F.expr(made)).drop("source", "target")

    def _row_type(self, side: str) -> T.DataType:
        return self._planned.schema[side].dataType

    def execute(self, source: DataFrame) -> dict:
        if not (self._matched or self._insert or self._by_source):
            raise ValueError("no clause is configured")
        table = self.table
        fields = [f["name"] for f in table.manifest.fields]
        part = [c for c in fields if c not in source.columns]
        if self._columns_only and (self._insert or not part):
            raise ValueError("rewrite_columns takes a part of the columns, and no inserts")
        planned = self.plan(source)
        self._planned = planned
        matched = F.col("s").isNotNull() & F.col("t").isNotNull()
        when = None
        if self._condition is not None:
            planned, when = self._decided(planned), F.col("__when")
        action = F.when(matched, F.lit(self._matched or "none") if when is None else F.when(F.coalesce(when, F.lit(False)), F.lit("update")).otherwise("none"))
        action = action.when(F.col("t").isNull(), F.lit("insert" if self._insert else "none"))
        if self._by_source is not None:
            made, _ = emit.to_sql(self._by_source, self._row_type("t"))
            gone = F.expr(made) if made == "true" else None
            others = planned.where("s IS NULL").select("t", "t.*") if gone is None else None
            if others is not None:
                addresses = others.where(emit.condition(self._by_source, others.schema)).select(F.col("t._rowaddr").alias("__a"))
                planned = planned.join(addresses, F.col("t._rowaddr") == F.col("__a"), "left")
                action = action.when(F.col("s").isNull() & F.col("__a").isNotNull(), F.lit("remove")).otherwise("none")
            else:
                action = action.when(F.col("s").isNull(), F.lit("remove")).otherwise("none")
        rows = stash(planned.withColumn("__do", action).where("__do <> 'none'").select("__do", "s", "t"))
        if self._matched == "fail" and rows.where("__do = 'fail'").limit(1).count():
            raise ValueError("a source row matches a row of the table")
        if part and rows.where("__do = 'update'").groupBy("t._rowaddr").count().where("count > 1").limit(1).count():
            raise ValueError("several source rows match one row of the table")
        counts = {r["__do"]: r["count"] for r in rows.groupBy("__do").count().collect()}  # a row a kind of action
        value = lambda c: F.col(f"s.{emit.quote(c)}" if c not in part else f"t.{emit.quote(c)}").alias(c)
        if self._columns_only:
            got = rows.where("__do = 'update'").select(F.col("t._rowid").alias("_rowid"), *[F.col(f"s.{emit.quote(c)}").alias(c) for c in source.columns if c not in self.keys])
            table.overlay(got)
        else:
            moved = rows.where("__do = 'update'").select(
                *map(value, fields), F.col("t._rowid").alias("__rowid"), F.col("t._row_created_at_version").alias("__created"), F.col("t._rowaddr").alias("__addr"))
            fresh = rows.where("__do = 'insert'").select(*[F.col(f"s.{emit.quote(c)}").alias(c) if c not in part else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in fields])
            gone = rows.where("__do IN ('delete', 'remove')").select(F.col("t._rowaddr").alias("addr"))
            table._rewrite(moved, fresh if counts.get("insert") else None, gone if counts.get("delete") or counts.get("remove") else None)
        unstash(rows)
        return {"num_inserted_rows": counts.get("insert", 0), "num_updated_rows": counts.get("update", 0), "num_deleted_rows": counts.get("delete", 0) + counts.get("remove", 0)}

    def explain(self, source: DataFrame) -> str:
        return self.plan(source)._jdf.queryExecution().toString()

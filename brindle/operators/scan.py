"""Scans: projection, filter, order, range, row lookups, searches, over a table's version or any DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import emit
from brindle.functions.dialect import DialectError, Unsupported, parse
from brindle.sources.table import SYSTEM, Table

#: How a scan gives out binary columns.
BLOBS = ("all_binary", "blobs_descriptions", "all_descriptions")
_ADDRESSES = ("_rowid", "_rowaddr", "_rowoffset")


@dataclass(frozen=True)
class Ordering:
    column: str
    ascending: bool = True
    nulls_first: bool = False


def order_columns(schema: T.StructType, keys: list) -> list[Column]:
    """Sort columns: nulls last unless asked for, floats in total order (-0.0 before 0.0, NaN above infinity)."""
    out = []
    for k in keys:
        k = Ordering(k) if isinstance(k, str) else Ordering(*k) if isinstance(k, tuple) else k
        if k.column not in schema.fieldNames():
            raise DialectError(f"No field named {k.column}.")
        col = F.col(emit.quote(k.column))
        place = {(True, False): "asc_nulls_last", (True, True): "asc_nulls_first", (False, False): "desc_nulls_last", (False, True): "desc_nulls_first"}[k.ascending, k.nulls_first]
        out.append(getattr(col, place)())
        if isinstance(schema[k.column].dataType, (T.FloatType, T.DoubleType)):
            sign = F.when((col == 0) & F.startswith(col.cast("string"), F.lit("-")), 0).otherwise(1)
            out.append(sign.asc() if k.ascending else sign.desc())
    return out


def from_pyarrow(expression) -> str:
    """The filter text of a pyarrow compute expression: comparisons, and, or, invert, is_null, is_valid, is_in, arithmetic."""
    import re

    text = str(expression)
    text = re.sub(r",\s*\{nan_is_null=\w+\}", "", text)
    strings: list[str] = []

    def hold(m) -> str:
        strings.append(m.group(0)[1:-1].replace('\\"', '"').replace("'", "''"))
        return f"\x00{len(strings) - 1}\x00"

    text = re.sub(r'"(?:[^"\\]|\\.)*"', hold, text)

    def among(m) -> str:
        values = ", ".join(x.strip() for x in m.group(2).split(","))
        return f"({m.group(1)} IN ({values}))"

    text = re.sub(r"is_in\(([\w.]+), \{value_set=[\w<>, ]*:?\[\s*([^\]]*?)\s*\][^}]*\}\)", among, text)
    text = re.sub(r"\s+", " ", text).replace("==", "=")
    return re.sub("\x00(\\d+)\x00", lambda m: "'" + strings[int(m.group(1))] + "'", text)


def project(df: DataFrame, columns, schema: T.StructType) -> DataFrame:
    """Names, dotted paths and system columns (a list), or {alias: expression} in its order."""
    if columns is None:
        return df
    if isinstance(columns, dict):
        made = []
        for alias, text in columns.items():
            node = parse(text)
            if node.op != "column" and any(c in _ADDRESSES for c in node.columns()):
                raise Unsupported("expressions over row addresses are not supported")
            made.append(emit.column(text, df.schema, df.sparkSession).alias(alias))
        return df.select(*made)
    made = []
    for name in columns:
        if name in df.columns:
            made.append(F.col(emit.quote(name)))
            continue
        top, *rest = name.split(".")
        own = emit.resolve(top, df.columns)
        col, t = F.col(emit.quote(own)), df.schema[own].dataType
        for part in rest:
            if not isinstance(t, T.StructType):
                raise DialectError(f"No field named {name}.")
            part = emit.resolve(part, t.fieldNames())
            col, t = col.getField(part), t[part].dataType
        made.append(col.alias(name if rest else own))
    return df.select(*made)


class Scan:
    """A scan of a table version, or of a DataFrame whose row order is that of `row_key` (then without row addresses)."""

    KNOWN = {
        "columns", "filter", "limit", "offset", "order_by", "nearest", "full_text_query", "prefilter", "with_row_id", "with_row_address", "fragments", "include_deleted_rows",
        "row_addr_allowlist", "row_addr_blocklist", "batch_size", "batch_size_bytes", "late_materialization", "use_scalar_index", "fast_search", "row_key", "disable_scoring_autoprojection", "blob_handling",
    }

    def __init__(self, source: Table | DataFrame, **how):
        if type(how.get("filter")).__module__.startswith("pyarrow"):
            how = how | {"filter": from_pyarrow(how["filter"])}
        unknown = set(how) - self.KNOWN
        if unknown:
            raise TypeError(f"unknown arguments: {sorted(unknown)}")
        for k in ("limit", "offset"):
            if how.get(k) is not None and (not isinstance(how[k], int) or how[k] < 0):
                raise ValueError(f"{k} must be a whole number of at least 0")
        for k, most in (("batch_size", 2**32 - 1), ("batch_size_bytes", 2**63 - 1)):
            if how.get(k) is not None and not 0 < how[k] <= most:
                raise ValueError(f"{k} must be between 1 and {most}")
        if how.get("order_by") and (how.get("nearest") or how.get("full_text_query")):
            raise Unsupported("order_by can't go with a search")
        if how.get("order_by") and isinstance(how.get("columns"), dict):
            raise Unsupported("order_by can't go with renamed columns")
        if how.get("nearest") and how.get("full_text_query"):
            raise Unsupported("one scan does one search; give the text query as a filter")
        if how.get("include_deleted_rows") and not how.get("with_row_id"):
            raise ValueError("include_deleted_rows needs with_row_id")
        if how.get("blob_handling") not in (None, *BLOBS):
            raise ValueError(f"blob_handling is one of {BLOBS}")
        self.source, self.how = source, how

    def with_(self, **more) -> "Scan":
        """The fluent form: the same scan with more settings."""
        return Scan(self.source, **self.how | more)

    @property
    def is_table(self) -> bool:
        return isinstance(self.source, Table)

    def _narrowed(self):
        """What indexes leave to read for the filter, or None."""
        how, text = self.how, self.how.get("filter")
        text = text.get("expr_filter") if isinstance(text, dict) else text
        if not self.is_table or not isinstance(text, str) or not text.strip() or not how.get("use_scalar_index", True) or not self.source.manifest.indexes:
            return None
        if (how.get("nearest") or how.get("full_text_query")) and not how.get("prefilter"):
            return None
        from brindle.plans.indexes import narrowed

        return narrowed(self.source, text, covered_only=bool(how.get("fast_search")))

    def _leading(self) -> list[int] | None:
        """The first fragments that hold offset + limit rows, where nothing but the range chooses rows."""
        how = self.how
        if how.get("limit") is None or any(how.get(k) for k in ("filter", "order_by", "nearest", "full_text_query", "row_addr_allowlist", "row_addr_blocklist", "include_deleted_rows", "fragments")):
            return None
        chosen, rows = [], 0
        for f in sorted(self.source.manifest.fragments, key=lambda f: f.id):
            if rows >= how["limit"] + (how.get("offset") or 0):
                break
            chosen.append(f.id)
            rows += f.live
        return chosen

    def _base(self, narrowed=None) -> DataFrame:
        how = self.how
        if not self.is_table:
            return self.source
        fragments = how.get("fragments")
        fragments = self._leading() if fragments is None else [getattr(f, "id", f) for f in fragments]
        if narrowed is not None:
            fragments = narrowed.fragments if fragments is None else [f for f in fragments if f in set(narrowed.fragments)]
        df = self.source.to_df(system=True, fragments=fragments, deleted=bool(how.get("include_deleted_rows")), columns=self._needed())
        for key, kind in (("row_addr_allowlist", "left_semi"), ("row_addr_blocklist", "left_anti")):
            mask = how.get(key)
            if mask is not None:
                if not isinstance(mask, DataFrame):
                    mask = df.sparkSession.createDataFrame([(int(a),) for a in mask], "_rowaddr long")
                df = df.join(mask.select("_rowaddr"), "_rowaddr", kind)
        return df

    def _needed(self) -> list[str] | None:
        """The table's columns that the scan reads, so that patches of others aren't joined."""
        how, names = self.how, self.source.schema.fieldNames()
        if how.get("columns") is None or how.get("nearest") or how.get("full_text_query"):
            return None
        texts = list(how["columns"].values()) if isinstance(how["columns"], dict) else [f'"{c.split(".")[0]}"' for c in how["columns"]]
        used = {str(c) for t in [*texts, *([how["filter"]] if isinstance(how.get("filter"), str) and how["filter"].strip() else [])] for c in parse(t).columns()}
        used |= {getattr(k, "column", k[0] if isinstance(k, tuple) else k) for k in how.get("order_by") or []}
        return [n for n in names if n in used or n.lower() in {u.lower() for u in used}]

    def _filtered(self, df: DataFrame, narrowed=None) -> DataFrame:
        text = self.how.get("filter")
        if text is None or isinstance(text, str) and not text.strip():
            return df
        if isinstance(text, dict):  # the matches of a text query as a filter
            df = self.with_(filter=text.get("expr_filter"))._filtered(df, narrowed)
            return self._text_filter(df, text["search_filter"]) if text.get("search_filter") is not None else df
        if narrowed is not None:
            df = narrowed.apply(df)
        return df.where(emit.condition(text, df.schema, df.sparkSession))

    @staticmethod
    def _text_filter(df: DataFrame, query) -> DataFrame:
        from brindle.operators import fts

        return fts.search(df, query).drop("_score")

    def to_df(self) -> DataFrame:
        how = self.how
        narrowed = self._narrowed()
        df = self._base(narrowed)
        if how.get("nearest"):
            return self._search(df, "_distance", narrowed)
        if how.get("full_text_query") is not None:
            return self._search(df, "_score", narrowed)
        df = self._filtered(df, narrowed)
        if isinstance(how.get("columns"), list) and "_rowoffset" in how["columns"]:
            df = self._with_offset(df)
        ordered = bool(how.get("order_by")) or how.get("limit") is not None or bool(how.get("offset"))
        if ordered:
            df = df.orderBy(*order_columns(df.schema, how.get("order_by") or []), *self._order())
        if how.get("offset"):
            df = df.offset(how["offset"])
        if how.get("limit") is not None:
            df = df.limit(how["limit"])
        return self._shape(df)

    def _order(self) -> list[Column]:
        if self.is_table:
            return [F.col("_rowaddr")]
        key = self.how.get("row_key")
        return [F.col(emit.quote(k)) for k in ([key] if isinstance(key, str) else key or [])]

    def _with_offset(self, df: DataFrame) -> DataFrame:
        """_rowoffset: the place among live rows, from fragment counts and ranks within fragments."""
        from pyspark.sql import Window

        if not self.is_table:
            raise ValueError("_rowoffset needs a table")
        starts, at = [], 0
        for f in self.source.manifest.fragments:
            starts.append((f.id, at))
            at += f.live
        known = df.sparkSession.createDataFrame(starts, "__f long, __start long")
        every = self.source.to_df(system=True, columns=[]).select("_rowaddr").withColumn("__f", F.shiftright("_rowaddr", 32))
        rank = F.row_number().over(Window.partitionBy("__f").orderBy("_rowaddr")) - 1
        return df.join(every.join(F.broadcast(known), "__f").select("_rowaddr", (F.col("__start") + rank).alias("_rowoffset")), "_rowaddr")

    def _described(self, df: DataFrame) -> DataFrame:
        """Blobs as (position, size), position being the row's address, where that is asked for."""
        handling = self.how.get("blob_handling") or "all_binary"
        if handling == "all_binary" or not self.is_table:
            return df
        flagged = {f["name"] for f in self.source.manifest.fields if str(f["metadata"].get("blob", "")).lower() == "true"}
        for f in df.schema.fields:
            if isinstance(f.dataType, T.BinaryType) and (handling == "all_descriptions" or f.name in flagged):
                col = F.col(emit.quote(f.name))
                df = df.withColumn(f.name, F.when(col.isNotNull(), F.struct(F.col("_rowaddr").alias("position"), F.octet_length(col).cast("long").alias("size"))))
        return df

    def _shape(self, df: DataFrame, score: str | None = None) -> DataFrame:
        how = self.how
        df = self._described(df)
        columns = how.get("columns")
        extra = [c for c, on in (("_rowid", how.get("with_row_id")), ("_rowaddr", how.get("with_row_address"))) if on]
        if score and not how.get("disable_scoring_autoprojection"):
            extra = [score, *extra]
        if columns is None:
            own = [c for c in df.columns if c not in (*SYSTEM, "_distance", "_score", "query_index")]
            lead = ["query_index"] if "query_index" in df.columns else []
            return df.select(*[F.col(emit.quote(c)) for c in [*lead, *own, *extra]])
        if isinstance(columns, dict):
            return project(df, columns | {c: f'"{c}"' for c in extra if c not in columns}, df.schema)
        lead = ["query_index"] if "query_index" in df.columns else []
        return project(df, [*lead, *columns, *(c for c in extra if c not in columns)], df.schema)

    def _search(self, df: DataFrame, score: str, narrowed) -> DataFrame:
        from brindle.operators import fts, vector

        how = self.how
        if isinstance(how.get("filter"), str) and any(c in _ADDRESSES for c in parse(how["filter"]).columns() if how["filter"].strip()):
            raise Unsupported("a search can't be filtered by row addresses")
        pre = bool(how.get("prefilter"))
        df = self._filtered(df, narrowed) if pre else df
        key = "_rowid" if self.is_table else how.get("row_key")
        if score == "_distance":
            spec = dict(how["nearest"])
            spec.setdefault("k", how.get("limit") or 10)
            found = vector.nearest(df, spec, key)
            order = [*(["query_index"] if "query_index" in found.columns else []), F.col("_distance").asc_nulls_last(), key]
        else:
            found = fts.search(df, how["full_text_query"], how.get("limit") if pre or not how.get("filter") else None, key)
            order = [F.desc("_score"), key]
        found = found if pre else self._filtered(found)
        found = found.orderBy(*order)
        if how.get("offset"):
            found = found.offset(how["offset"])
        if how.get("limit") is not None:
            found = found.limit(how["limit"])
        return self._shape(found, score)

    # -- reading out -----------------------------------------------------------------------------------------

    def count_rows(self) -> int:
        if self.is_table and not any(self.how.get(k) for k in ("filter", "fragments", "row_addr_allowlist", "row_addr_blocklist", "limit", "offset", "nearest", "full_text_query", "include_deleted_rows")):
            return self.source.manifest.rows
        others = ("fragments", "row_addr_allowlist", "row_addr_blocklist", "limit", "offset", "nearest", "full_text_query", "include_deleted_rows", "fast_search")
        if self.is_table and isinstance(self.how.get("filter"), str) and self.how.get("use_scalar_index", True) and self.source.manifest.indexes and not any(self.how.get(k) for k in others):
            from brindle.plans.indexes import count

            known = count(self.source, self.how["filter"])
            if known is not None:
                return known
        return self.with_(columns=None).to_df().count()

    def head(self, n: int):
        """The first n rows as an Arrow table."""
        limit = self.how.get("limit")
        return self.with_(limit=n if limit is None else min(n, limit)).to_arrow()

    def analyze(self) -> str:
        """The plan as it was run, with the rows and times that its operators measured."""
        plan = self.to_df()._jdf.queryExecution().executedPlan()
        plan.execute().count()
        lines: list[str] = []

        def walk(node, depth: int) -> None:
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                node = node.executedPlan()
            found = node.metrics().toSeq()
            told = sorted(f"{found.apply(k)._1()}={found.apply(k)._2().value()}" for k in range(found.size()) if found.apply(k)._2().value() > 0)
            lines.append("  " * depth + node.nodeName() + (f" [{', '.join(told)}]" if told else ""))
            under = node.children()
            inner = [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [under.apply(k) for k in range(under.size())]
            for x in inner:
                walk(x, depth + 1)

        walk(plan, 0)
        return "\n".join(lines)

    def to_arrow(self):
        return self.to_df().toArrow()

    def to_pandas(self):
        return self.to_df().toPandas()

    def to_batches(self):
        """Arrow batches of at most batch_size rows, a partition at a time; they travel as Arrow, not row by row."""
        import pyarrow as pa

        df, size = self.to_df(), self.how.get("batch_size") or 8192

        def pack(batches):
            for b in batches:
                for k in range(0, b.num_rows, size):
                    part = b.slice(k, size)
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, part.schema) as w:
                        w.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["b"])

        for row in df.mapInArrow(pack, "b binary").toLocalIterator(prefetchPartitions=True):
            yield from pa.ipc.open_stream(row["b"])

    def explain(self) -> str:
        return self.to_df()._jdf.queryExecution().toString()


def slice_rows(table: Table, start: int, end: int, columns=None) -> DataFrame:
    """Live rows [start, end) in address order; only the fragments that hold them are read."""
    if start > table.manifest.rows:
        raise IndexError(f"the table has {table.manifest.rows} rows")
    at, chosen, skip = 0, [], 0
    for f in table.manifest.fragments:
        if at < end and at + f.live > start:
            if not chosen:
                skip = start - at
            chosen.append(f.id)
        at += f.live
    df = table.to_df(system=True, fragments=chosen).orderBy("_rowaddr").offset(max(0, skip)).limit(max(0, end - start))
    return project(df.drop(*SYSTEM), columns, df.schema)


def take(table: Table, positions: list[int], columns=None) -> DataFrame:
    """Rows at logical positions, in the order asked for, repeats too (with a column __ord to sort by, dropped at the end)."""
    from pyspark.sql import Window

    n = table.manifest.rows
    bad = [p for p in positions if not 0 <= p < n]
    if bad:
        raise IndexError(f"positions {bad[:3]} are outside 0..{n - 1}")
    starts, at = [], 0
    for f in table.manifest.fragments:
        starts.append((at, f))
        at += f.live
    import bisect

    firsts = [s for s, _ in starts]
    wanted = []
    for k, p in enumerate(positions):
        s, f = starts[bisect.bisect_right(firsts, p) - 1]
        wanted.append((k, f.id, p - s))
    spark = table.spark
    asked = spark.createDataFrame(wanted, "__ord long, __f long, __k long")
    df = table.to_df(system=True, fragments=sorted({f for _, f, _ in wanted})).withColumn("__f", F.shiftright("_rowaddr", 32))
    df = df.withColumn("__k", (F.row_number().over(Window.partitionBy("__f").orderBy("_rowaddr")) - 1).cast("long"))
    got = df.join(F.broadcast(asked) if len(positions) <= 1_000_000 else asked, ["__f", "__k"]).orderBy("__ord")
    return project(got.select(*table.schema.fieldNames()), columns, got.schema)


def take_rows(table: Table, row_ids: list[int], columns=None) -> DataFrame:
    """Rows by id in the order asked for. Ids of deleted rows are left out unless ids are stable, where a missing id is an error."""
    asked = table.spark.createDataFrame([(k, int(r)) for k, r in enumerate(row_ids)], "__ord long, _rowid long")
    if table.manifest.next_row_id is None:
        known = {f.id: f.rows for f in table.manifest.fragments}
        gone = {f.id for m in map(table.log.read, table.log.versions()) for f in m.fragments}
        bad = [r for r in row_ids if (r >> 32) not in gone or (r >> 32) in known and (r & 0xFFFFFFFF) >= known[r >> 32]]
        if bad:
            raise IndexError(f"no rows at {bad[:3]}")
        fragments = sorted({r >> 32 for r in row_ids} & known.keys())
        df = table.to_df(system=True, fragments=fragments)
    else:
        df = table.to_df(system=True)
        if df.join(asked.select("_rowid").distinct(), "_rowid", "left_semi").count() < len(set(row_ids)):
            raise IndexError("a row id doesn't exist")
    got = df.join(F.broadcast(asked) if len(row_ids) <= 1_000_000 else asked, "_rowid").orderBy("__ord")
    return project(got.select(*table.schema.fieldNames()), columns, got.schema)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

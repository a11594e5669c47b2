"""Inputs: JSON lines routed to one table a record shape, Arrow, pandas, rows and Parquet."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import delete_path, shared_dir, stash, unstash
from brindle.sources.table import Table

_MOST_ROUTES = 10_000


def routes(lines: DataFrame, column: str = "value", route_key: str | None = None) -> DataFrame:
    """lines with route (the sorted keys, or a field's value) or the reason why a line has none.

    Blank lines go. A line that isn't a JSON object, or lacks the routing field, is rejected.
    """
    text = F.col(column)
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    keys = F.array_join(F.sort_array(F.json_object_keys(text)), ",")
    route = F.get_json_object(text, f"$.{route_key}") if route_key else keys
    reason = F.when(v.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object").when(route.isNull(), F.lit(f"no field {route_key}"))
    return lines.where(F.trim(text) != "").withColumns({"route": F.when(reason.isNull(), route), "reason": reason})


def route_ndjson(lines: DataFrame, root: str, route_key: str | None = None, learn_rows: int = 10_000, strict: bool = False, column: str = "value") -> DataFrame:
    """One table a route below root, plus _rejects and _catalog; returns the catalog (table, route, rows, schema).

    A route's schema is learned from a bounded number of its rows and then fixed: later keys are dropped, or
    with strict rejected; values that don't fit reject their line.
    """
    spark = lines.sparkSession
    routed = stash(routes(lines, column, route_key))
    counts = routed.where("route IS NOT NULL").groupBy("route").count().orderBy("route").limit(_MOST_ROUTES + 1).collect()
    if len(counts) > _MOST_ROUTES:
        raise ValueError(f"more than {_MOST_ROUTES} record shapes; give a route_key")
    catalog, rejects = [], routed.where("reason IS NOT NULL").select(F.col(column).alias("line"), "reason")
    # Dealt out once: a route's table then reads the route's own files only.
    numbers = spark.createDataFrame([(r["route"], k) for k, r in enumerate(counts)], "route string, __n int")
    dealt = f"{shared_dir(spark)}/routes-{uuid.uuid4().hex}"
    own = routed.join(F.broadcast(numbers), "route").select(column, "__n")
    own.repartition("__n", F.pmod(F.xxhash64(column), F.lit(8))).write.partitionBy("__n").parquet(dealt)
    for k, r in enumerate(counts):
        mine = spark.read.parquet(f"{dealt}/__n={k}")
        learned = spark.read.json(mine.orderBy(F.xxhash64(column), column).limit(learn_rows).select(column).rdd.map(lambda x: x[0])).schema
        parsed = mine.select(column, F.from_json(column, T.StructType([*learned.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"}).alias("j"))
        bad = F.when(F.col("j._corrupt_record").isNotNull(), "a value doesn't fit the learned schema")
        if strict:
            extra = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, learned.fieldNames())))
            bad = F.coalesce(bad, F.when(F.size(extra) > 0, F.concat(F.lit("new key after lock: "), F.array_join(extra, ","))))
        parsed = parsed.withColumn("bad", bad)
        rejects = rejects.unionByName(parsed.where("bad IS NOT NULL").select(F.col(column).alias("line"), F.col("bad").alias("reason")))
        name = f"t{k + 1:02d}_" + (re.sub(r"\W+", "_", r["route"])[:60] or "empty")
        rows = parsed.where("bad IS NULL").select(*[F.col("j").getField(f).alias(f) for f in learned.fieldNames()])
        table = Table.write(rows, f"{root}/{name}", mode="create")
        catalog.append((name, r["route"], table.count_rows(), learned.simpleString()))
    Table.write(rejects, f"{root}/_rejects")
    unstash(routed)
    delete_path(spark, dealt)
    made = spark.createDataFrame(catalog, "table string, route string, rows long, schema string")
    Table.write(made, f"{root}/_catalog")
    return made


def to_rows(spark: SparkSession, data, schema: T.StructType | None = None) -> DataFrame:
    """A DataFrame of rows: Spark, Arrow, pandas, polars, {name: values}, dicts, pydantic models, or a Parquet path."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.read.parquet(data)
    if hasattr(data, "to_arrow"):  # polars
        data = data.to_arrow()
    if hasattr(data, "read_all"):  # a reader of batches
        data = data.read_all()
    import pyarrow as pa

    if isinstance(data, dict):
        data = pa.table(data)
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, list):
        data = pa.Table.from_pylist([x.model_dump() if hasattr(x, "model_dump") else dict(x) for x in data])
    df = spark.createDataFrame(data)
    return infer_vectors(df) if schema is None else df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def infer_vectors(df: DataFrame) -> DataFrame:
    """Lists of numbers of one length as float vectors, with the length as the field's `dim`."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))]
    if not lists:
        return df
    row = df.agg(*[x for n in lists for x in (F.min(F.size(n)).alias(f"a_{n}"), F.max(F.size(n)).alias(f"b_{n}"))]).first()
    fixed = [n for n in lists if row[f"a_{n}"] == row[f"b_{n}"] and (row[f"a_{n}"] or 0) > 0]
    return _with_dims(df, {n: row[f"a_{n}"] for n in fixed})


def _with_dims(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    for n, d in dims.items():
        df = df.withColumn(n, F.col(n).cast("array<float>")).withMetadata(n, {"dim": d})
    return df


def clean_vectors(df: DataFrame, column: str, policy: str = "error", fill: float = 0.0) -> DataFrame:
    """Vectors with NaN or of an odd length: error, drop the row, fill the values, or null the vector."""
    dim = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = dim["n"] if dim else 0
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x)) | (F.size(column) != width)
    if policy == "error":
        if df.where(bad).limit(1).count():
            raise ValueError(f"{column} has bad vectors")
        return df
    if policy == "drop":
        return df.where(F.coalesce(~bad, F.lit(True)))
    if policy == "null":
        return df.withColumn(column, F.when(~bad, F.col(column)))
    if policy == "fill":
        padded = F.slice(F.concat(F.col(column), F.array_repeat(F.lit(fill).cast("float"), width)), 1, width)
        return df.withColumn(column, F.transform(padded, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(fill).cast("float")).otherwise(x)))
    raise ValueError(f"unknown policy {policy!r}")


def fetch_blobs(df: DataFrame, uri: str = "uri", position: str = "position", size: str = "size", out: str = "content") -> DataFrame:
    """df with the bytes of (uri, position, size). Files are read whole by Spark's own reader, once each, and sliced."""
    spark = df.sparkSession
    files = sorted(r[0] for r in df.select(uri).where(F.col(uri).isNotNull()).distinct().collect())  # names only
    if not files:
        return df.withColumn(out, F.lit(None).cast("binary"))
    key = f"__u{uuid.uuid4().hex[:6]}"
    content = spark.read.format("binaryFile").load(files).select(F.regexp_replace("path", "^file:/+", "/").alias(key), F.col("content").alias("__c"))
    joined = df.withColumn(key, F.regexp_replace(uri, "^file:/+", "/")).join(content, key, "left")
    return joined.withColumn(out, F.expr(f"substring(__c, cast({position} AS int) + 1, cast({size} AS int))")).drop(key, "__c")

"""Structured Streaming into and out of versioned tables, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.store import Store
from brindle.sources.table import Table


def _sink(stream: DataFrame, root: str, checkpoint: str, put, available_now: bool, every: str | None) -> StreamingQuery:
    """Each micro-batch is one version, which holds its number: a batch that a restart brings again is skipped."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        key = f"stream.{checkpoint}"
        table = Table(spark, root) if Store(spark, root).list("_versions") else None
        if table is not None and int(table.manifest.config.get(key, -1)) >= number:
            return
        mark = {key: str(number)}
        if table is not None:
            table.log.extra = mark
        table = put(table, df, mark)
        table.log.extra = {}
        if table.manifest.config.get(key) != mark[key]:  # nothing was changed, so nothing was committed
            table.config(mark)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def append_stream(stream: DataFrame, root: str, checkpoint: str, available_now: bool = True, every: str | None = None) -> StreamingQuery:
    """Micro-batches as appended versions; the first makes the table."""
    return _sink(stream, root, checkpoint, lambda t, df, mark: Table.write(df, root, config=mark) if t is None else t.append(df), available_now, every)


def merge_stream(stream: DataFrame, root: str, checkpoint: str, on: str | list[str], available_now: bool = True, every: str | None = None) -> StreamingQuery:
    """Micro-batches as upserts by key; of a batch's rows that repeat a key one counts."""
    keys = [on] if isinstance(on, str) else on

    def put(table: Table | None, df: DataFrame, mark: dict[str, str]) -> Table:
        df = df.dropDuplicates(keys)
        if table is None:
            return Table.write(df, root, stable_row_ids=True, config=mark)
        table.merge_insert(keys).when_matched_update_all().when_not_matched_insert_all().execute(df)
        return table

    return _sink(stream, root, checkpoint, put, available_now, every)


def changes(spark: SparkSession, root: str, since: int, until: int | None = None) -> DataFrame:
    """Rows inserted or updated after version `since`, with _change_type; feed a loop with the version reached."""
    table = Table(spark, root)
    delta = table.delta(since, until)
    new = delta.inserted().withColumn("_change_type", F.lit("insert"))
    return new.unionByName(delta.updated().withColumn("_change_type", F.lit("update")))


def tumbling_counts(events: DataFrame, time: str, width: str, late: str | None = None, *keys: str) -> DataFrame:
    """Counts by window of event time and keys; on a stream rows later than `late` are dropped."""
    df = events.withWatermark(time, late) if late else events
    out = df.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


def sliding_counts(events: DataFrame, time: str, width: str, step: str, late: str | None = None, *keys: str) -> DataFrame:
    df = events.withWatermark(time, late) if late else events
    out = df.groupBy(F.window(time, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """Sessions of each key: events no further apart than gap."""
    df = events.withWatermark(time, late) if late else events
    out = df.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")

"""Rows of a table by key: joins that split hot keys, and verdicts that are carried out row by row."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KEYS = 1_000_000  # rows of a table of keys that is broadcast at most, some 50 MB; larger ones are joined by a shuffle
HOT = 1_000  # a key is hot if more than one in HOT of the rows have it, so at most HOT keys are


TEXTS = 500  # whose results a Python worker holds at a time


def slices(batches: Iterable[pa.RecordBatch], rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a worker holds the results of few texts; freed memory goes back at the end."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def fresh() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def few(keys: DataFrame) -> DataFrame:
    """A stashed table of keys, for broadcast where its count shows that it is small."""
    return F.broadcast(keys) if keys.count() <= KEYS else keys


def text_key(text: str | Column) -> Column:
    return F.xxhash64(text)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], size: str, spread: Column, how: str = "left", total: int | None = None) -> DataFrame:
    """left joined with right by keys, right having one row a key and, in `size`, the number of left rows with it.

    A hot key, one of more than a HOT-th of the rows, is split: its left rows are dealt to parts by `spread` and its
    right row is repeated for each part. Only the hot keys with their parts, at most HOT, are broadcast. total: the
    rows of left, counted where not given. `size` is not returned; no other columns have the same name.
    """
    if total is None:
        total = left.count()
    salt, parts = fresh(), fresh()
    number = F.greatest(F.ceil(F.col(size) / max(total / HOT, 1)).cast("int"), F.lit(1))
    dealt = right.withColumn(parts, number)
    hot = F.broadcast(dealt.where(F.col(parts) > 1).select(*keys, parts))
    wide = left.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    many = dealt.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts, size)
    return wide.join(many, [*keys, salt], how).select(*left.columns, *(c for c in right.columns if c not in (*keys, size)))


def carry_out(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs less the rows that verdicts (doc_id, tkey, gone) name, with all columns as they were.

    A verdict holds for the rows of that id, null being one too, and text: gone ones go, of others one row stays,
    that of the least hash over all columns. tkey is text_key of the text; there is at most one verdict a key. They are
    a stashed table, which spares the texts a shuffle where it is small.
    """
    i, k, g, one = fresh(), fresh(), fresh(), fresh()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    told = few(verdicts).select(F.col("doc_id").alias(i), F.col("tkey").alias(k), F.col("gone").alias(g))
    met = docs.join(told, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (text_key(F.col(f"`{text_col}`")) == F.col(k)), "left")
    rest = met.where(F.col(g).isNull()).select(*cols)
    if verdicts.where("NOT gone").isEmpty():
        return rest
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    thin = met.where(~F.col(g)).groupBy(i, k).agg(F.min_by(F.struct(*cols), F.xxhash64(*plain)).alias(one))
    return rest.unionByName(thin.select(f"{one}.*"))

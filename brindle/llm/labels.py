"""Labelled rows for the classifiers: a bounded sample, and which rows are held out."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of a null id that of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % folds == fold


def sample(labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """(doc_id, label) of at most `rows` rows, chosen by a hash of the id, none of them of the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    one = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return one.where(remainder("doc_id", folds) != fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, label); the chosen rows are bounded, so they are broadcast."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

"""Sharding transforms: bucket, identity, unsharded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's Murmur3 hash has seed 42; a leading integer that hashes to 0 makes the seed of the next value 0.
SEED_ZERO = -1693959553


@dataclass(frozen=True)
class ShardField:
    name: str
    transform: str  # bucket, identity, unsharded
    column: str | None = None
    buckets: int | None = None


def bucket(column: str, n: int) -> Column:
    """Murmur3 (seed 0) of the value modulo n; null falls into the bucket of hash 0."""
    if n <= 0:
        raise ValueError("buckets must be above 0")
    return F.pmod(F.hash(F.lit(SEED_ZERO), F.col(column)).bitwiseAND(0x7FFFFFFF), F.lit(n)).cast("int")


def shard(df: DataFrame, fields: list[ShardField]) -> DataFrame:
    made = {}
    for f in fields:
        if f.transform == "bucket":
            if f.buckets is None or f.column is None:
                raise ValueError(f"{f.name} needs a column and a number of buckets")
            made[f.name] = bucket(f.column, f.buckets)
        elif f.transform == "identity":
            made[f.name] = F.col(f.column)
        elif f.transform == "unsharded":
            made[f.name] = F.lit(0)
        else:
            raise ValueError(f"unknown transform {f.transform!r}")
    return df.withColumns(made)

"""Samplers of rows, batches and fragments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_hash(keys: list[str], seed: int):
    """A seeded order of rows that doesn't depend on partitions: the MD5 of the keys and the seed as text, with | between."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))))


def sample(df: DataFrame, n: int, keys: list[str], seed: int = 0, shuffled: bool = False) -> DataFrame:
    """n rows, uniformly and without replacement, in key order or shuffled."""
    got = df.orderBy(order_hash(keys, seed), *keys).limit(n)
    return got.orderBy(order_hash(keys, seed + 1), *keys) if shuffled else got.orderBy(*keys)


def reservoir(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows with the least random priorities."""
    return df.withColumn("__p", F.rand(seed)).orderBy("__p").limit(n).drop("__p")


def chunked(df: DataFrame, position: str, chunk: int, per_chunk: int, seed: int = 0) -> DataFrame:
    """One run of per_chunk neighbours from a random place of every chunk of rows by position."""
    c = F.floor(F.col(position) / chunk)
    start = F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(max(1, chunk - per_chunk + 1)))
    at = F.pmod(F.col(position), F.lit(chunk))
    return df.where((at >= start) & (at < start + per_chunk))


def shard_fragments(fragments: list, rank: int, world: int) -> list:
    """Every world-th fragment from rank."""
    if not 0 <= rank < world:
        raise ValueError("rank must be below world")
    return fragments[rank::world]


def shard_batches(df: DataFrame, position: str, batch: int, rank: int, world: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """Whole batches of rows by position, dealt in turns (or by a seeded hash), with their number as _batch."""
    number = F.floor(F.col(position) / batch)
    turn = number if seed is None else F.xxhash64(number, F.lit(seed), F.lit(epoch))
    return df.withColumn("_batch", number).where(F.pmod(turn, F.lit(world)) == rank)


def batches(df: DataFrame, position: str, batch: int) -> Iterator:
    """pandas batches in order, a partition at a time."""
    import pandas as pd

    held = []
    for row in df.orderBy(position).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == batch:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def per_group(df: DataFrame, group: str, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows of each group."""
    w = Window.partitionBy(group).orderBy(order_hash(keys, seed), *keys)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def rand_batches(df: DataFrame, position: str, batch: int, count: int, keys: list[str], seed: int = 0) -> DataFrame:
    """`count` whole batches of rows by position, chosen at random without replacement, with their number as _batch."""
    numbered = df.withColumn("_batch", F.floor(F.col(position) / batch))
    chosen = numbered.select("_batch").distinct().orderBy(order_hash(["_batch"], seed)).limit(count)
    return numbered.join(F.broadcast(chosen), "_batch", "left_semi").orderBy(order_hash(["_batch"], seed), *keys)

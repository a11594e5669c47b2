"""Joins that Spark's own lack: as-of by time, and steps along the edges of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_asof(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str], tolerance: str | None = None, direction: str = "backward", ties: str | None = None) -> DataFrame:
    """left with `columns` of the right row of its group whose `on` is the last at or before its own (forward: first at or after).

    Nulls where there is none, or none within `tolerance` (an interval like '3 days', or a number for numbers). Of right
    rows with one time the one with the largest `ties` counts (forward: the smallest). left rows with a null time or
    group find nothing; repeated rows each come back. Both sides are sorted once by group and time; nothing is joined.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    back = direction == "backward"
    own, theirs = left.columns, [*by, on, *columns]
    l = left.select(*[F.col(c).alias(c) for c in by], F.col(on).alias("__at"), F.struct(*own).alias("__l"), F.lit(None).cast(right.select(F.struct(*theirs).alias("r")).schema["r"].dataType).alias("__r"))
    r = right.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("__at"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(*theirs).alias("__r"), *([F.col(ties).alias("__tie")] if ties else []))
    l = l.withColumn("__tie", F.lit(None).cast(right.schema[ties].dataType)) if ties else l
    both = l.unionByName(r)
    # Right rows of the same time come first backward; forward everything runs the other way round.
    is_left = F.col("__l").isNotNull()
    order = [F.col("__at").asc() if back else F.col("__at").desc(), is_left.asc(), *([F.col("__tie").asc() if back else F.col("__tie").desc()] if ties else [])]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__f", F.last("__r", ignorenulls=True).over(w)).where(is_left)
    known = F.col("__at").isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True))
    if tolerance is not None:
        near = F.expr(f"INTERVAL {tolerance}") if isinstance(tolerance, str) else F.lit(tolerance)
        known = known & (F.col(f"__f.{on}") >= F.col("__at") - near if back else F.col(f"__f.{on}") <= F.col("__at") + near)
    return found.select("__l.*", *[F.when(known, F.col(f"__f.{c}")).alias(c) for c in columns])


def neighbours(seeds: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst", hops: int = 1) -> DataFrame:
    """(node) that edges reach from seeds (node) in `hops` steps or fewer, without the seeds themselves.

    A step is one semi-join of the edges with the nodes of the last one, so no path is spelled out.
    """
    reached = seeds.select("node").where("node IS NOT NULL").distinct()
    last = reached
    for _ in range(hops):
        step = edges.join(last.select(F.col("node").alias(src)), src, "left_semi").select(F.col(dst).alias("node")).where("node IS NOT NULL").distinct()
        last = step.join(reached, "node", "left_anti")
        reached = reached.unionByName(last)
    return reached.join(seeds.select("node").distinct(), "node", "left_anti")

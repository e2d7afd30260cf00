"""Ordered computations in two levels: running sums and maxima by chunk of the order, then within the chunk.

A window over all rows of a table, or of a hot stream, would be one task. Chunks are ranges of the order column; one
row for each stream and chunk carries the offset, so a task sorts one chunk of one stream only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Rows that a task sorts where partitions() deals them out.
ROWS = 1 << 17


def partitions(df: DataFrame) -> int:
    """So many that each gets ROWS rows. Adaptive execution joins partitions by their bytes, and narrow sorted rows
    compress so well that one task would get millions."""
    return df.count() // ROWS + 1


def running(df: DataFrame, value: str, out: str, order: str, by: tuple[str, ...] = (), how: str = "sum", chunk: int = CHUNK) -> DataFrame:
    """Add the running sum or maximum of value in the order column, the row itself included, within by."""
    agg = {"sum": F.sum, "max": F.max}[how]
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    keys = [*by, "_chunk"]
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(*keys).agg(agg(value).alias("_part")).withColumn("_before", agg("_part").over(before)).drop("_part")
    own = agg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_own", own).join(parts, keys)
    both = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_own") if how == "sum" else F.greatest("_own", "_before")
    return df.withColumn(out, both).drop("_chunk", "_own", "_before")


def sequenced(df: DataFrame, order: str, by: tuple[str, ...], out: str = "sequence") -> DataFrame:
    """Dense sequence from 0 within by."""
    df = running(df.withColumn("_one", F.lit(1).cast("long")), "_one", out, order, by)
    return df.withColumn(out, F.col(out) - 1).drop("_one")

"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to a few bits each, rows are sorted by their index on the Hilbert curve through
that grid, and the order is cut into runs. Neighbours on the curve are near in every dimension, so a filter on any
of the dimensions prunes most shards by their minimum and maximum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import global_rank, prepare, saved, text_of

BITS = 6


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points, one row of coords for each dimension (Skilling's transform)."""
    x = [c.astype(np.int64).copy() for c in coords]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()]), BITS))


def coded(values: DataFrame, name: str) -> DataFrame:
    """_name -> code: the value's place in the order of all rows, in 2^BITS parts, null first; so that each part of a
    dimension's range holds as many rows as any other. values has one row for each distinct value, with its rows n."""
    before = F.coalesce(F.sum("n").over(W.orderBy(F.col(name).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = (before + F.col("n") / 2) / F.sum("n").over(W.partitionBy(F.lit(1)))
    return saved(values.select(F.col(name).alias(f"_{name}"), F.floor(middle * (1 << BITS)).cast("int").alias(f"code_{name}")), f"codes-{name}")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    The law is `rows`: shards are runs of the curve with row counts at most one apart; grown_shard is null.
    Dimensions are source, lang (null as its own value) and the size class, each coded in order and by its share of
    the rows. Equal texts take the dimensions of the least of their rows, so a group of equal texts lies together on
    the curve, at most cut by a shard's end; ties go by text digest, doc_id, source and lang. Null text is empty: size
    8. With fewer rows than shards the last shards are empty; an empty table gives no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    raw = F.encode(text_of(), "utf-8")
    base = docs.select("doc_id", "source", "lang", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("digest"))
    base = saved(base.withColumn("class", F.floor(F.log2("size") * 4).cast("int")), "sharding")
    rows = base.join(base.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "lang")).alias("m")), "digest").select(*base.columns, F.col("m.source").alias("s"), F.col("m.lang").alias("l"))
    for own, name in (("s", "source"), ("l", "lang"), ("class", "class")):
        rows = rows.join(coded(base.groupBy(name).agg(F.count("*").alias("n")), name), F.col(own).eqNullSafe(F.col(f"_{name}"))).drop(f"_{name}")
    rows = rows.withColumn("curve", _curve("code_source", "code_lang", "code_class")).select(*base.columns, "curve")
    rows = global_rank(rows, ["curve", "digest", "doc_id", "source", "lang"])
    total = rows.agg(F.count("*").alias("_all"))  # one row
    rows = rows.join(F.broadcast(total))
    least, more = F.expr(f"_all div {shards}"), F.col("_all") % shards
    long = more * (least + 1)
    at = F.when(F.col("rank") < long, F.expr(f"rank div (_all div {shards} + 1)")).otherwise(more + F.floor((F.col("rank") - long) / F.greatest(least, F.lit(1))))
    rows = rows.withColumn("shard", at.cast("int"))
    start = F.col("shard") * least + F.least(F.col("shard"), more)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Compaction: which segments to merge, and what the merge of them holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_SEGMENTS, MAX_BYTES = 8, 64 << 20


def compaction_inputs(segments: DataFrame, max_segments: int = MAX_SEGMENTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(segment_id, bytes) of the first two or more segments with adjacent entry ids that stay within the bounds.

    segments has segment_id, first_entry_id, last_entry_id and bytes, one row for each segment of the manifest; the
    windows run over those rows.
    """
    order = W.partitionBy(F.lit(1)).orderBy("first_entry_id", "last_entry_id")
    starts = F.coalesce(F.col("first_entry_id") != F.lag("last_entry_id").over(order) + 1, F.lit(True))
    runs = segments.withColumn("_run", F.sum(starts.cast("long")).over(order))
    ahead = F.collect_list(F.struct("segment_id", "bytes")).over(W.partitionBy("_run").orderBy("first_entry_id", "last_entry_id").rowsBetween(0, max_segments - 1))
    sums = "transform(_ahead, (x, i) -> struct(x.segment_id, x.bytes, aggregate(slice(_ahead, 1, i + 1), 0L, (a, y) -> a + y.bytes) AS upto))"
    found = runs.withColumn("_ahead", ahead).withColumn("_taken", F.expr(f"filter({sums}, x -> x.upto <= {max_bytes})")).where("size(_taken) >= 2")
    return found.orderBy("first_entry_id", "last_entry_id").limit(1).select(F.explode("_taken").alias("x")).select("x.segment_id", "x.bytes")


def segments(records: DataFrame) -> DataFrame:
    return records.groupBy("segment_id").agg(F.min("entry_id").alias("first_entry_id"), F.max("entry_id").alias("last_entry_id"), F.sum("frame_len").alias("bytes"))


def merged(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """The streams of the union of inputs: their ranges, and whether sequences and bytes go on without a gap."""
    own = records.join(inputs.select("segment_id"), "segment_id", "left_semi")
    per = own.groupBy("stream").agg(
        F.min("sequence").alias("first_sequence"), (F.max("sequence") + 1).alias("next_sequence"), F.count("*").alias("n"),
        F.min("byte_offset").alias("first_byte_offset"), F.max(F.col("byte_offset") + F.col("frame_len")).alias("next_byte_offset"),
    )
    # Each record but a stream's last meets the one that goes on from it.
    ends = own.select("stream", (F.col("sequence") + 1).alias("sequence"), (F.col("byte_offset") + F.col("frame_len")).alias("byte_offset"))
    on = own.join(ends, ["stream", "sequence", "byte_offset"]).groupBy("stream").agg(F.count("*").alias("_on"))
    return per.join(on, "stream", "left").withColumn("continuous", F.coalesce("_on", F.lit(0)) + 1 == F.col("n")).drop("_on")

"""Recovery and scrubbing of a store: tails from segments and the log, projections, and all invariants as faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import log, ordered, reads


class RecoveryError(Exception):
    pass


def recovered(extents: DataFrame, log_: DataFrame, checkpoint: int, through: int | None = None) -> DataFrame:
    """(stream, next_sequence, next_byte_offset, replayed): tails from the extents up to a checkpoint and the whole
    batches of the log after it. Raises RecoveryError if the log doesn't go on from the checkpoint, breaks, or ends in
    a part of a batch that is not cut off by `through`."""
    rest = log_.where(F.col("entry_id") > checkpoint)
    first = rest.agg(F.min("entry_id").alias("a")).first()["a"]
    if first is not None and first != checkpoint + 1:
        raise RecoveryError(f"the log goes on at {first}")
    if not log.broken(rest).isEmpty():
        raise RecoveryError("the log is broken")
    if through is None and not log.leftovers(log_, checkpoint).isEmpty():
        raise RecoveryError("a batch is not whole")
    new = log.replay(log_, checkpoint, through).groupBy("stream").agg((F.max("sequence") + 1).alias("_next"), F.min("sequence").alias("_first"), F.sum("frame_len").alias("_bytes"), F.count("*").alias("_n"))
    old = extents.groupBy("stream").agg(F.max("next_sequence").alias("_old"), F.max("next_byte_offset").alias("_at"))
    j = old.join(new, "stream", "full")
    wrong = j.where(F.coalesce("_old", F.lit(0)) != F.coalesce("_first", "_old"))
    if not wrong.isEmpty():
        raise RecoveryError("the log doesn't go on from a stream's tail")
    return j.select("stream", F.coalesce("_next", "_old").alias("next_sequence"), (F.coalesce("_at", F.lit(0)) + F.coalesce("_bytes", F.lit(0))).alias("next_byte_offset"), F.coalesce("_n", F.lit(0)).alias("replayed"))


def scrub(records: DataFrame, extents: DataFrame, chunk: int = reads.GAP_CHUNK) -> DataFrame:
    """(stream, sequence, fault) over stored records and their extents: GAP, OFFSET and TIME where a record doesn't
    follow the one before, TWICE where a place is held twice, EXTENT where extents of a stream don't tile it.
    A task sorts the extents of chunks of a stream's sequences, and of records about ordered.ROWS."""
    keys, parts = ["stream", "sequence"], ordered.partitions(records)
    deal = lambda df: df.repartition(parts, *keys)
    gaps = reads.gaps(deal(records.select(*keys)).distinct(), chunk, parts).withColumn("fault", F.lit("GAP"))
    head = records.groupBy("stream").agg(F.min("sequence").alias("sequence")).where("sequence <> 0").withColumn("fault", F.lit("GAP"))
    twice = deal(records.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.lit("TWICE").alias("fault"))
    before = records.select("stream", (F.col("sequence") + 1).alias("sequence"), (F.col("byte_offset") + F.col("frame_len")).alias("_end"), F.col("recorded_us").alias("_time"))
    found = F.array_compact(F.array(F.when(F.col("_end") != F.col("byte_offset"), "OFFSET"), F.when(F.col("recorded_us") < F.col("_time"), "TIME")))
    near = deal(records.select(*keys, "byte_offset", "frame_len", "recorded_us")).join(deal(before), keys).select(*keys, F.explode(found).alias("fault"))
    tiles = extents.withColumn("_chunk", F.floor(F.col("first_sequence") / chunk)).withColumn("_end", F.struct("next_sequence", "next_byte_offset"))
    ends = tiles.groupBy("stream", "_chunk").agg(F.max_by("_end", "first_sequence").alias("_past"))  # then as in gaps()
    ends = ends.withColumn("_past", F.lag("_past").over(W.partitionBy("stream").orderBy("_chunk")))
    past = F.coalesce(F.lag("_end").over(W.partitionBy("stream", "_chunk").orderBy("first_sequence")), F.col("_past"))
    tiles = tiles.join(ends, ["stream", "_chunk"]).withColumn("_past", past).withColumn("_s", F.coalesce("_past.next_sequence", F.lit(0))).withColumn("_b", F.coalesce("_past.next_byte_offset", F.lit(0)))
    tiles = tiles.where((F.col("_s") != F.col("first_sequence")) | (F.col("_b") != F.col("first_byte_offset"))).select("stream", F.col("first_sequence").alias("sequence"), F.lit("EXTENT").alias("fault"))
    out = gaps.select(*keys, "fault")
    for part in (head.select(*keys, "fault"), twice, near, tiles):
        out = out.unionByName(part)
    return out


def projections(records: DataFrame) -> dict[str, DataFrame]:
    """Registry, tails and extents of one generation, from its records."""
    return {"registry": reads.registry(records), "tails": reads.tails(records), "extents": reads.extents(records)}

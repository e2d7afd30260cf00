"""Reads, lookups in time and stream metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordered

#: Sequences of a chunk in gaps(): far fewer than a task's rows, so that chunks spread evenly over tasks.
GAP_CHUNK = 1 << 14


def read(records: DataFrame, stream: str, start: int, max_records: int, max_bytes: int) -> DataFrame:
    """Records from a sequence, while their count and running bytes stay within the budgets.

    The filter bounds the rows by max_records before the window runs, so the window holds one answer at most.
    """
    part = records.where((F.col("stream") == stream) & (F.col("sequence") >= start) & (F.col("sequence") < start + max_records))
    run = F.sum("frame_len").over(W.partitionBy("stream").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0))
    return part.withColumn("running_bytes", run).where(F.col("running_bytes") <= max_bytes)


def tails(records: DataFrame) -> DataFrame:
    return records.groupBy("namespace", "stream").agg(
        (F.max("sequence") + 1).alias("next_sequence"), F.max(F.col("byte_offset") + F.col("frame_len")).alias("next_byte_offset"),
        F.max_by("recorded_us", "sequence").alias("last_recorded_us"), F.max("entry_id").alias("last_entry_id"), F.count("*").alias("record_count"),
    )


def inspect(records: DataFrame) -> DataFrame:
    return records.groupBy("namespace", "stream").agg(
        F.lit(0).cast("long").alias("head"), (F.max("sequence") + 1).alias("next_sequence"), F.count("*").alias("record_count"),
        F.min_by("recorded_us", "sequence").alias("first_us"), F.max_by("recorded_us", "sequence").alias("last_us"),
    )


def registry(records: DataFrame) -> DataFrame:
    """stream_id by first appearance. The window runs over one row for each stream."""
    first = records.groupBy("namespace", "stream").agg(F.min("entry_id").alias("created_entry_id"))
    return first.withColumn("stream_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("created_entry_id")).cast("long"))


def resolve(records: DataFrame, targets: DataFrame, mode: str, chunk_us: int = 3_600_000_000) -> DataFrame:
    """For each target (stream, target_us) the first sequence at or after it, or the last one at or before it.

    Targets and records are sorted together by time, in two levels as in `ordered`: a task sorts one chunk of time of
    one stream, and one row for each stream and chunk carries what the chunks beyond it hold.
    """
    after = mode == "AT_OR_AFTER"
    best = F.min if after else F.max
    asked = targets.select("stream", "target_us").distinct()
    rows = records.select("stream", F.col("recorded_us").alias("_t"), F.struct("sequence", "recorded_us").alias("_r"), F.lit(False).alias("_asked"))
    rows = rows.unionByName(asked.select("stream", F.col("target_us").alias("_t"), F.lit(True).alias("_asked")), allowMissingColumns=True)
    rows = rows.withColumn("_chunk", F.floor(F.col("_t") / chunk_us))
    along = lambda c: F.col(c).desc() if after else F.col(c).asc()
    beyond = best("_part").over(W.partitionBy("stream").orderBy(along("_chunk")).rowsBetween(W.unboundedPreceding, -1))
    parts = rows.where("_t IS NOT NULL").groupBy("stream", "_chunk").agg(best("_r").alias("_part")).withColumn("_beyond", beyond).drop("_part")
    own = best("_r").over(W.partitionBy("stream", "_chunk").orderBy(along("_t")).rangeBetween(W.unboundedPreceding, W.currentRow))
    out = rows.withColumn("_own", F.when(F.col("_t").isNotNull(), own)).where("_asked").join(parts, ["stream", "_chunk"], "left")
    out = out.withColumn("_best", F.least("_own", "_beyond") if after else F.greatest("_own", "_beyond"))
    return out.select("stream", F.col("_t").alias("target_us"), "_best.sequence", "_best.recorded_us").withColumn("found", F.col("sequence").isNotNull())


def extents(records: DataFrame) -> DataFrame:
    return records.groupBy("segment_id", "stream").agg(
        F.min("sequence").alias("first_sequence"), (F.max("sequence") + 1).alias("next_sequence"), F.min("byte_offset").alias("first_byte_offset"),
        F.max(F.col("byte_offset") + F.col("frame_len")).alias("next_byte_offset"), F.min("recorded_us").alias("first_us"), F.max("recorded_us").alias("last_us"),
        F.min("entry_id").alias("first_entry_id"), F.max("entry_id").alias("last_entry_id"), F.count("*").alias("record_count"),
    )


def locate(extents_: DataFrame, points: DataFrame) -> DataFrame:
    """The segment that holds each (stream, sequence); null if none does."""
    on = (F.col("p.stream") == F.col("x.stream")) & (F.col("p.sequence") >= F.col("first_sequence")) & (F.col("p.sequence") < F.col("next_sequence"))
    return points.alias("p").join(extents_.alias("x"), on, "left").select("p.stream", "p.sequence", "segment_id")


def gaps(records: DataFrame, chunk: int = GAP_CHUNK, parts: int | None = None) -> DataFrame:
    """(stream, sequence) of the records whose predecessor is missing, but for the first of each stream.

    The first record of a chunk of sequences follows the last one of the preceding chunk that has any. Chunks are dealt
    to so many tasks as parts says, by default ordered.partitions().
    """
    own = records.select("stream", "sequence").withColumn("_chunk", F.floor(F.col("sequence") / chunk))
    ends = own.groupBy("stream", "_chunk").agg(F.max("sequence").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(W.partitionBy("stream").orderBy("_chunk")))
    before = F.coalesce(F.lag("sequence").over(W.partitionBy("stream", "_chunk").orderBy("sequence")), F.col("_end"))
    own = own.repartition(parts or ordered.partitions(records), "stream", "_chunk")
    return own.join(ends, ["stream", "_chunk"]).withColumn("_p", before).where("sequence <> _p + 1").select("stream", "sequence")


def answers(requests: DataFrame, records: DataFrame, width: int = 1024) -> DataFrame:
    """One row for each request (request, stream, from_sequence, max_records, max_bytes): request, outcome,
    current_next_sequence, required_bytes, records, next_sequence.

    Outcomes, the first that holds: INVALID_ARGUMENT, STREAM_NOT_FOUND, SEQUENCE_AHEAD, RECORD_TOO_LARGE with the bytes
    that the first record needs, OK. A read at the tail is OK and empty. Requests meet records by stream and blocks of
    `width` sequences, so a request meets the blocks that its range touches and no others.
    """
    ends = records.groupBy("stream").agg((F.max("sequence") + 1).alias("_tail"))
    asked = requests.join(ends, "stream", "left")
    invalid = (F.col("max_records") < 1) | (F.col("max_bytes") < 1) | (F.col("from_sequence") < 0)
    asked = asked.withColumn("_can", ~F.coalesce(invalid, F.lit(True)) & F.coalesce(F.col("from_sequence") < F.col("_tail"), F.lit(False)))
    last = F.least(F.col("from_sequence") + F.col("max_records"), F.col("_tail")) - 1
    spans = asked.where("_can").select("request", "stream", "from_sequence", "max_bytes", last.alias("_last"))
    spans = spans.withColumn("_block", F.explode(F.sequence(F.expr(f"from_sequence div {width}"), F.expr(f"_last div {width}"))))
    met = spans.join(records.select("stream", "sequence", "frame_len", F.expr(f"sequence div {width}").alias("_block")), ["stream", "_block"]).where("sequence between from_sequence and _last")
    run = F.sum("frame_len").over(W.partitionBy("request").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0))
    taken = met.withColumn("_run", run).groupBy("request").agg(F.count_if(F.col("_run") <= F.col("max_bytes")).alias("_n"), F.min_by("frame_len", "sequence").alias("_first"))
    j = asked.join(taken, "request", "left")
    large = F.coalesce(F.col("_first") > F.col("max_bytes"), F.lit(False))
    outcome = F.when(F.coalesce(invalid, F.lit(True)), "INVALID_ARGUMENT").when(F.col("_tail").isNull(), "STREAM_NOT_FOUND").when(F.col("from_sequence") > F.col("_tail"), "SEQUENCE_AHEAD").when(large, "RECORD_TOO_LARGE").otherwise("OK")
    n = F.coalesce("_n", F.lit(0))
    return j.select("request", outcome.alias("outcome"), F.col("_tail").alias("current_next_sequence"), F.when(large, F.col("_first")).alias("required_bytes"), n.alias("records"), F.when(outcome == "OK", F.col("from_sequence") + n).alias("next_sequence"))

"""Structural checks as tables of faults: dense indexes, segment layouts, extent pages, manifests, diagnostics.

Neighbours meet by joins on sequence or offset; windows run over one row for each extent or segment only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_index(records: DataFrame, extents: DataFrame) -> DataFrame:
    """segment_id, stream, sequence, relative_offset, time_delta, frame_len: places within a record's extent."""
    first = extents.select("segment_id", "stream", "first_byte_offset", "first_us")
    return records.join(first, ["segment_id", "stream"]).select("segment_id", "stream", "sequence", (F.col("byte_offset") - F.col("first_byte_offset")).alias("relative_offset"), (F.col("recorded_us") - F.col("first_us")).alias("time_delta"), "frame_len")


def index_faults(index: DataFrame, extents: DataFrame) -> DataFrame:
    """(segment_id, stream, sequence, fault): OFFSET where an entry doesn't begin where the one before ends, TIME where
    its delta falls, START where an extent doesn't begin at 0, END where it ends elsewhere than the extent says."""
    keys = ["segment_id", "stream", "sequence"]
    before = index.select("segment_id", "stream", (F.col("sequence") + 1).alias("sequence"), (F.col("relative_offset") + F.col("frame_len")).alias("_end"), F.col("time_delta").alias("_time"))
    x = extents.select("segment_id", "stream", "first_sequence", "next_sequence", (F.col("next_byte_offset") - F.col("first_byte_offset")).alias("_bytes"))
    j = index.join(before, keys, "left").join(x, ["segment_id", "stream"])
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.col("_end") != F.col("relative_offset"), F.col("sequence") != F.col("first_sequence")), "OFFSET"),
        F.when(F.col("time_delta") < F.coalesce("_time", F.lit(0)), "TIME"),
        F.when((F.col("sequence") == F.col("first_sequence")) & (F.col("relative_offset") != 0), "START"),
        F.when((F.col("sequence") == F.col("next_sequence") - 1) & (F.col("relative_offset") + F.col("frame_len") != F.col("_bytes")), "END"),
    ))
    return j.select(*keys, F.explode(found).alias("fault"))


def layout_faults(extents: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, fault) of segments whose extents don't add up to their totals: RECORDS, BYTES, FIRST or LAST entry,
    and NO_EXTENTS."""
    per = extents.groupBy("segment_id").agg(F.sum("record_count").alias("_n"), F.sum(F.col("next_byte_offset") - F.col("first_byte_offset")).alias("_bytes"), F.min("first_entry_id").alias("_a"), F.max("last_entry_id").alias("_b"))
    j = segments.join(per, "segment_id", "left")
    found = F.when(F.col("_n").isNull(), F.array(F.lit("NO_EXTENTS"))).otherwise(F.array_compact(F.array(
        F.when(F.col("_n") != F.col("record_count"), "RECORDS"), F.when(F.col("_bytes") != F.col("data_bytes"), "BYTES"),
        F.when(F.col("_a") != F.col("first_entry_id"), "FIRST"), F.when(F.col("_b") != F.col("last_entry_id"), "LAST"),
    )))
    return j.select("segment_id", F.explode(found).alias("fault"))


def extent_pages(extents: DataFrame, capacity: int) -> DataFrame:
    """extents with page: each stream's extents in order, `capacity` to a page."""
    rank = F.row_number().over(W.partitionBy("stream").orderBy("first_sequence", "segment_id")) - 1
    return extents.withColumn("page", F.floor(rank / capacity).cast("long"))


def page_headers(pages: DataFrame) -> DataFrame:
    return pages.groupBy("stream", "page").agg(F.min("first_sequence").alias("first_sequence"), F.max("next_sequence").alias("next_sequence"), F.count("*").alias("extents"))


def page_faults(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """(stream, page, fault): GAP or OVERLAP between extents of a page, HEADER where a header differs from its page, and
    MISSING or EXTRA headers."""
    before = F.lag("next_sequence").over(W.partitionBy("stream", "page").orderBy("first_sequence", "segment_id"))
    inner = pages.withColumn("_before", before).select("stream", "page", F.when(F.col("first_sequence") > F.col("_before"), "GAP").when(F.col("first_sequence") < F.col("_before"), "OVERLAP").alias("fault"))
    own = page_headers(pages).withColumn("_own", F.lit(True)).alias("o")
    said = headers.withColumn("_said", F.lit(True)).alias("h")
    j = own.join(said, (F.col("o.stream") == F.col("h.stream")) & (F.col("o.page") == F.col("h.page")), "full")
    differ = (F.col("o.first_sequence") != F.col("h.first_sequence")) | (F.col("o.next_sequence") != F.col("h.next_sequence")) | (F.col("o.extents") != F.col("h.extents"))
    outer = j.select(F.coalesce("o.stream", "h.stream").alias("stream"), F.coalesce("o.page", "h.page").alias("page"), F.when(F.col("_said").isNull(), "MISSING").when(F.col("_own").isNull(), "EXTRA").when(differ, "HEADER").alias("fault"))
    return inner.unionByName(outer).where("fault is not null").distinct()


def manifest_faults(references: DataFrame, header: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(subject, fault) of a manifest: its segment references (position, segment_id, record_count, first_entry_id,
    last_entry_id), its header (segments, record_count, last_entry_id) and its artifacts (type, covers_entry_id)."""
    total = references.agg(F.count("*").alias("_s"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("_n"), F.max("last_entry_id").alias("_e"))
    j = header.crossJoin(total)  # one row each
    sums = F.array_compact(F.array(F.when(F.col("segments") != F.col("_s"), "SEGMENTS"), F.when(F.col("record_count") != F.col("_n"), "RECORDS"), F.when(~F.col("last_entry_id").eqNullSafe(F.col("_e")), "CHECKPOINT")))
    out = j.select(F.lit("header").alias("subject"), F.explode(sums).alias("fault"))
    o = W.partitionBy(F.lit(1)).orderBy("position")  # one row for each segment
    order = references.withColumn("_before", F.lag("last_entry_id").over(o)).where("first_entry_id <= _before")
    out = out.unionByName(order.select(F.col("segment_id").cast("string").alias("subject"), F.lit("ORDER").alias("fault")))
    twice = artifacts.groupBy("type").agg(F.count("*").alias("n")).where("n > 1").select(F.col("type").alias("subject"), F.lit("DUPLICATE").alias("fault"))
    beyond = artifacts.crossJoin(header.select("last_entry_id")).where("covers_entry_id > last_entry_id").select(F.col("type").alias("subject"), F.lit("BEYOND").alias("fault"))
    return out.unionByName(twice).unionByName(beyond)


def diagnosed(status: DataFrame) -> DataFrame:
    """status (flags recovering, fatal, draining, critical, guarded) with state, the first that holds, and ready."""
    state = F.lit("READY")
    for flag, name in (("guarded", "NOT_LEADER"), ("critical", "CAPACITY"), ("draining", "DRAINING"), ("fatal", "FATAL"), ("recovering", "RECOVERING")):
        state = F.when(F.col(flag), name).otherwise(state)
    return status.withColumn("state", state).withColumn("ready", F.col("state") == "READY")


def standby_snapshot(status: DataFrame) -> DataFrame:
    """What a standby shows: never ready for writes; replicated is absent, and it lags what is committed but unapplied."""
    state = F.when(F.col("recovering"), "RECOVERING").when(F.col("fatal"), "FATAL").otherwise("STANDBY")
    return status.select("name", "term", state.alias("state"), F.lit(False).alias("ready"), "local_durable", "committed", "applied", F.greatest(F.coalesce(F.col("committed") - F.col("applied"), F.lit(0)), F.lit(0)).cast("long").alias("apply_lag"))

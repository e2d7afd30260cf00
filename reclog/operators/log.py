"""The commit log as a table: chained entries, files, bounds, ranges, torn ends, replay and collection.

An entry is a record with its place in a batch, a checksum and the checksum of the entry before it. All checks are
joins of an entry with its neighbour by id, so no task orders the whole log; windows run over one row for each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running

FILE_ENTRIES, BATCH = 700, 3


def checksum(payload: Column) -> Column:
    """32 bits of the SHA-256 of a payload."""
    return F.conv(F.substring(F.sha2(payload.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def entries(records: DataFrame, file_entries: int = FILE_ENTRIES, batch: int = BATCH) -> DataFrame:
    """The log of records: batches of up to `batch` records of one stream, files of `file_entries` entries."""
    ends = records.groupBy("stream").agg((F.max("sequence") + 1).alias("_end"))
    log = records.join(ends, "stream").withColumn("batch_index", (F.col("sequence") % batch).cast("long"))
    log = log.withColumn("batch_count", F.least(F.lit(batch).cast("long"), F.col("_end") - F.col("sequence") + F.col("batch_index")))
    log = log.withColumn("file_id", F.expr(f"entry_id div {file_entries}")).withColumn("checksum", checksum(F.col("payload")))
    log = log.select("entry_id", "file_id", "stream", "sequence", "batch_index", "batch_count", "request_id", "frame_len", "recorded_us", "checksum")
    before = log.select((F.col("entry_id") + 1).alias("entry_id"), F.col("checksum").alias("previous_checksum"))
    return log.join(before, "entry_id", "left").withColumn("previous_checksum", F.coalesce("previous_checksum", F.lit(0).cast("long")))


def files(log: DataFrame) -> DataFrame:
    """One row for each file: its range, size, and the checksums at its ends."""
    return log.groupBy("file_id").agg(
        F.min("entry_id").alias("first_entry_id"), F.max("entry_id").alias("last_entry_id"), F.count("*").alias("entries"), F.sum("frame_len").alias("bytes"),
        F.min_by("previous_checksum", "entry_id").alias("previous_checksum"), F.max_by("checksum", "entry_id").alias("last_checksum"),
    )


def broken(log: DataFrame) -> DataFrame:
    """(entry_id, fault) of entries that don't follow their predecessor: GAP without one, CHAIN with another checksum."""
    before = log.select((F.col("entry_id") + 1).alias("entry_id"), F.col("checksum").alias("_before"))
    first = log.agg(F.min("entry_id").alias("_first"))  # one row
    joined = log.join(before, "entry_id", "left").join(F.broadcast(first))
    fault = F.when(F.col("_before").isNull() & (F.col("entry_id") > F.col("_first")), "GAP").when(F.col("_before") != F.col("previous_checksum"), "CHAIN")
    return joined.select("entry_id", fault.alias("fault")).where("fault is not null")


def valid_prefix(log: DataFrame) -> DataFrame:
    """The entries before the first that doesn't follow: what a scan of an active file keeps of a torn log."""
    stop = broken(log).agg(F.min("entry_id").alias("_stop"))  # one row
    return log.join(F.broadcast(stop)).where("_stop is null or entry_id < _stop").drop("_stop")


def whole_batches(log: DataFrame) -> DataFrame:
    """Batches of the log: stream, first_sequence, batch_count, present, complete, and the range of entry ids.

    Complete are those whose indexes are 0..n-1, all with one count and one request; the sums need no order.
    """
    per = log.groupBy("stream", (F.col("sequence") - F.col("batch_index")).alias("first_sequence")).agg(
        F.max("batch_count").alias("batch_count"), F.min("batch_count").alias("_least"), F.count_distinct("batch_index").alias("present"), F.count("*").alias("_n"),
        F.max("batch_index").alias("_last"), F.min("entry_id").alias("first_entry_id"), F.max("entry_id").alias("last_entry_id"),
    )
    whole = (F.col("present") == F.col("batch_count")) & (F.col("_n") == F.col("present")) & (F.col("_last") == F.col("batch_count") - 1) & (F.col("_least") == F.col("batch_count"))
    return per.withColumn("complete", whole).drop("_least", "_n", "_last")


def replay(log: DataFrame, checkpoint: int, through: int | None = None) -> DataFrame:
    """Entries after a checkpoint, up to `through`, of batches that lie wholly in that range."""
    part = log.where((F.col("entry_id") > checkpoint) & (F.lit(True) if through is None else F.col("entry_id") <= through))
    good = whole_batches(part).where("complete").select("stream", F.col("first_sequence").alias("_first"))
    return part.withColumn("_first", F.col("sequence") - F.col("batch_index")).join(good, ["stream", "_first"], "left_semi").drop("_first")


def leftovers(log: DataFrame, checkpoint: int) -> DataFrame:
    """Batches after a checkpoint that are not whole: recovery fails on them rather than guess."""
    return whole_batches(log.where(F.col("entry_id") > checkpoint)).where(~F.col("complete")).select("stream", "first_sequence", "batch_count", "present")


def footer_faults(log: DataFrame, footers: DataFrame) -> DataFrame:
    """(file_id, fault) of sealed files whose entries differ from their footer, or that one of both lacks."""
    own, say = files(log).alias("o"), footers.alias("f")
    j = own.join(say, F.col("o.file_id") == F.col("f.file_id"), "full")
    fault = F.when(F.col("f.file_id").isNull(), "UNSEALED").when(F.col("o.file_id").isNull(), "MISSING").when(F.col("o.entries") != F.col("f.entries"), "COUNT").when(F.col("o.bytes") != F.col("f.bytes"), "BYTES").when(F.col("o.last_checksum") != F.col("f.last_checksum"), "CHECKSUM")
    return j.select(F.coalesce("o.file_id", "f.file_id").alias("file_id"), fault.alias("fault")).where("fault is not null")


def history_range(log: DataFrame, start: int, max_entries: int, max_bytes: int) -> DataFrame:
    """Entries from an id on, within budgets of count and bytes. The count bounds the rows before the window runs."""
    part = log.where((F.col("entry_id") >= start) & (F.col("entry_id") < start + max_entries))
    run = F.sum("frame_len").over(W.partitionBy(F.lit(1)).orderBy("entry_id").rowsBetween(W.unboundedPreceding, 0))
    return part.withColumn("running_bytes", run).where(F.col("running_bytes") <= max_bytes).select("entry_id", "checksum", "frame_len", "running_bytes")


def history_points(log: DataFrame, asked: DataFrame) -> DataFrame:
    """Outcome and checksum for each asked entry_id: PRESENT, COLLECTED before the first retained, AHEAD after the last."""
    ends = log.agg(F.min("entry_id").alias("_a"), F.max("entry_id").alias("_b"))  # one row
    j = asked.join(log.select("entry_id", "checksum"), "entry_id", "left").join(F.broadcast(ends))
    outcome = F.when(F.col("checksum").isNotNull(), "PRESENT").when(F.col("_a").isNull() | (F.col("entry_id") > F.col("_b")), "AHEAD").when(F.col("entry_id") < F.col("_a"), "COLLECTED").otherwise("MISSING")
    return j.select("entry_id", outcome.alias("outcome"), "checksum")


def discover(files_: DataFrame) -> DataFrame:
    """Files in order with link: FIRST, LINKED, GAP, FORK where ranges overlap, or CHAIN where checksums don't meet."""
    o = W.partitionBy(F.lit(1)).orderBy("first_entry_id", "file_id")  # one row for each file
    end, mark = F.max("last_entry_id").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lag("last_checksum").over(o)
    df = files_.withColumn("_end", end).withColumn("_mark", mark)
    link = F.when(F.col("_end").isNull(), "FIRST").when(F.col("first_entry_id") <= F.col("_end"), "FORK").when(F.col("first_entry_id") > F.col("_end") + 1, "GAP").when(F.col("previous_checksum") != F.col("_mark"), "CHAIN").otherwise("LINKED")
    return df.select("file_id", "first_entry_id", "last_entry_id", link.alias("link"))


def collectable(files_: DataFrame, covered: int, snapshot: int | None) -> DataFrame:
    """Files that may go: sealed and unpinned, covered by segments and a verified snapshot, from the oldest on without
    a gap. files_ has pinned and sealed besides the columns of files()."""
    limit = F.least(F.lit(covered), F.lit(snapshot if snapshot is not None else -1)).cast("long")
    fit = F.col("sealed") & ~F.col("pinned") & (F.col("last_entry_id") <= limit)
    stop = F.min(F.when(~fit, F.col("first_entry_id"))).over(W.partitionBy(F.lit(1)))  # one row for each file
    return files_.withColumn("collect", F.coalesce(F.col("first_entry_id") < stop, F.lit(True)))


def collection_report(files_: DataFrame, covered: int, snapshot: int | None, budget: int) -> DataFrame:
    """One row: bytes and files deleted and retained, the earliest entry retained, and whether the log still exceeds
    its budget, and a snapshot is what it waits for."""
    c = collectable(files_, covered, snapshot)
    kept = ~F.col("collect")
    out = c.agg(
        F.coalesce(F.sum(F.when(F.col("collect"), F.col("bytes"))), F.lit(0)).alias("deleted_bytes"), F.count_if("collect").alias("deleted_files"),
        F.coalesce(F.sum(F.when(kept, F.col("bytes"))), F.lit(0)).alias("retained_bytes"), F.count_if(kept).alias("retained_files"),
        F.min(F.when(kept, F.col("first_entry_id"))).alias("earliest_entry_id"),
        F.coalesce(F.max(kept & F.col("sealed") & ~F.col("pinned") & (F.col("last_entry_id") <= covered)), F.lit(False)).alias("needs_snapshot"),
    )
    return out.withColumn("pressure", F.col("retained_bytes") > budget)


def clamped(log: DataFrame) -> DataFrame:
    """Entries whose time is before that of an earlier entry of any stream: invariant of the clamp."""
    return running(log.select("entry_id", "recorded_us"), "recorded_us", "_max", "entry_id", how="max").where("recorded_us < _max").select("entry_id")

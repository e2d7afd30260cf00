"""Upkeep of a store: storage by kind, capacity, maintenance, retention, deferred deletion, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running

BUCKETS_US = (1_000, 10_000, 100_000, 1_000_000, 10_000_000)


def storage_by_kind(files: DataFrame) -> DataFrame:
    """files (kind, bytes) -> kind, files, bytes. Kinds other than the known ones are one: other."""
    known = F.when(F.col("kind").isin("segment", "log", "manifest", "projection", "snapshot", "trash"), F.col("kind")).otherwise("other")
    return files.groupBy(known.alias("kind")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def capacity(samples: DataFrame, high: float, low: float) -> DataFrame:
    """samples (tick, used) with critical: from a sample at or over high on, until one at or under low."""
    up = running(samples.withColumn("_h", F.when(F.col("used") >= high, F.col("tick"))), "_h", "_up", "tick", how="max")
    both = running(up.withColumn("_l", F.when(F.col("used") <= low, F.col("tick"))), "_l", "_down", "tick", how="max")
    return both.select("tick", "used", (F.coalesce("_up", F.lit(-1)) > F.coalesce("_down", F.lit(-1))).alias("critical"))


def due(status: DataFrame, max_age_us: int, max_bytes: int, max_log_bytes: int) -> DataFrame:
    """status (name, age_us, pending_bytes, log_bytes, critical, entered_high) with the reason to checkpoint, or null."""
    reason = F.when(F.col("pending_bytes") == 0, F.lit(None).cast("string")).when(F.col("entered_high"), "CAPACITY").when(F.col("pending_bytes") >= max_bytes, "BYTES").when(F.col("log_bytes") >= max_log_bytes, "LOG").when(F.col("age_us") >= max_age_us, "AGE")
    return status.select("name", reason.alias("reason"), (~F.col("critical")).alias("writes"))


def retired(files: DataFrame, live: DataFrame, pins: DataFrame) -> DataFrame:
    """files (path, generation) with fate: LIVE if the current manifest names it, PINNED if a reader holds a generation
    that had it, else TRASH. pins has generation; a file lives from its own generation up to the one that dropped it."""
    least = pins.agg(F.min("generation").alias("_pin"))  # one row
    j = files.join(live.select("path", F.lit(True).alias("_live")), "path", "left").join(F.broadcast(least))
    fate = F.when(F.col("_live").isNotNull(), "LIVE").when(F.coalesce(F.col("dropped_generation") > F.col("_pin"), F.lit(False)), "PINNED").otherwise("TRASH")
    return j.select("path", fate.alias("fate"))


def retention(snapshots: DataFrame, keep: int) -> DataFrame:
    """snapshots (snapshot_id, covers_entry_id, verified) with fate: the newest verified one is the ANCHOR, up to
    keep - 1 verified ones before it stay as KEPT, unverified ones newer than the anchor are PENDING, all else EXPIRED."""
    good = snapshots.where("verified").orderBy(F.desc("covers_entry_id"), F.desc("snapshot_id")).limit(keep)
    ends = good.agg(F.max(F.struct("covers_entry_id", "snapshot_id")).alias("_anchor"), F.collect_set("snapshot_id").alias("_kept"))  # `keep` ids
    j = snapshots.join(F.broadcast(ends))
    me = F.struct("covers_entry_id", "snapshot_id")
    fate = F.when(me.eqNullSafe(F.col("_anchor")) & F.col("verified"), "ANCHOR").when(F.array_contains("_kept", F.col("snapshot_id")), "KEPT").when(~F.col("verified") & (F.col("_anchor").isNull() | (me > F.col("_anchor"))), "PENDING").otherwise("EXPIRED")
    return j.select("snapshot_id", fate.alias("fate"))


def snapshot_faults(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, fault) of a snapshot whose files (path, bytes, digest) differ from its manifest: MISSING, EXTRA, SIZE,
    DIGEST."""
    j = manifest.alias("m").join(listing.alias("l"), F.col("m.path") == F.col("l.path"), "full")
    fault = F.when(F.col("l.path").isNull(), "MISSING").when(F.col("m.path").isNull(), "EXTRA").when(F.col("m.bytes") != F.col("l.bytes"), "SIZE").when(F.col("m.digest") != F.col("l.digest"), "DIGEST")
    return j.select(F.coalesce("m.path", "l.path").alias("path"), fault.alias("fault")).where("fault is not null")


def usable_snapshots(snapshots: DataFrame, earliest: int) -> DataFrame:
    """The verified snapshots that the log goes on from, newest first, as rank 1, 2, ...: what an install may use."""
    good = snapshots.where(F.col("verified") & (F.col("covers_entry_id") + 1 >= earliest))
    return good.select("snapshot_id", "covers_entry_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("covers_entry_id"), F.desc("snapshot_id"))).alias("rank"))


def call_metrics(calls: DataFrame, buckets: tuple[int, ...] = BUCKETS_US) -> DataFrame:
    """calls (method, code, took_us) -> method, code, requests, total_us, and the cumulative count up to each bound."""
    return calls.groupBy("method", "code").agg(F.count("*").alias("requests"), F.sum("took_us").alias("total_us"), *[F.count_if(F.col("took_us") <= b).alias(f"le_{b}") for b in buckets])


def commit_stats(groups: DataFrame) -> DataFrame:
    """groups (stage, requests, bytes, wait_us) -> sums and maxima over all groups, and the mean size of a group."""
    return groups.agg(
        F.count("*").alias("groups"), F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"), F.max("requests").alias("largest_group"),
        F.sum("wait_us").alias("wait_us"), F.max("wait_us").alias("longest_wait_us"), F.try_divide(F.sum("requests").cast("double"), F.count("*")).alias("mean_group"),
    )


def grouped(requests: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """requests (arrival, stream, bytes) with group: groups in arrival order, each within both bounds of a fixed grid of
    running count and bytes, so that a group never holds more than `most` requests or twice `most_bytes`."""
    run = running(running(requests.withColumn("_one", F.lit(1).cast("long")), "_one", "_n", "arrival"), "bytes", "_b", "arrival")
    return run.select("arrival", "stream", "bytes", F.floor((F.col("_n") - 1) / most).alias("count_group"), F.floor((F.col("_b") - F.col("bytes")) / most_bytes).alias("bytes_group"))

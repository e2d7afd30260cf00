"""Appends as a stream: requests by micro-batch, decided against the stored tails, published once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import append, ordered
from ..sources.store import RecordStore


def tails_of(store: RecordStore) -> DataFrame | None:
    """stream, next_sequence, next_byte_offset from the extents: one row for each stream and segment is read."""
    if not store.manifest()["segments"]:
        return None
    return store.extents().groupBy("stream").agg(F.max("next_sequence").alias("next_sequence"), F.max("next_byte_offset").alias("_bytes"), F.max("last_us").alias("_us"))


def commit(store: RecordStore, requests: DataFrame, batch: str) -> DataFrame:
    """Decide the requests of one micro-batch (arrival, stream, expected_sequence, request_id, request_hash,
    record_count, frame_len of each record, wall_us), append what is accepted, and return the outcomes.

    Entry ids go on from the manifest's last one; times are clamped so that they never fall; a batch that was
    published before is not published again. Registering a stream takes an entry id.
    """
    now, old = store.manifest(), tails_of(store)
    batches = None
    if old is not None:
        seen = store.scan().groupBy("stream", "first_sequence").agg(F.first("request_id").alias("request_id"), F.first("request_hash").alias("request_hash"), F.count("*").alias("record_count"))
        batches = seen
    outcomes = append.entry_ids(append.decide(requests.select("arrival", "stream", "expected_sequence", "request_id", "request_hash", "record_count"), None if old is None else old.select("stream", "next_sequence"), batches), now["last_entry_id"])
    new = outcomes.where("outcome = 'OK' and not deduplicated").select("arrival", "first_sequence", "first_entry_id", "record_count")
    rows = new.join(requests.select("arrival", "stream", "request_id", "request_hash", "frame_len", "wall_us"), "arrival")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("record_count") - 1)))
    rows = rows.select("stream", (F.col("first_sequence") + F.col("_i")).alias("sequence"), "first_sequence", (F.col("first_entry_id") + F.col("_i")).alias("entry_id"), "request_id", "request_hash", "frame_len", "wall_us")
    rows = ordered.running(ordered.running(rows, "wall_us", "recorded_us", "entry_id", how="max"), "frame_len", "_end", "entry_id", ("stream",))
    if old is not None:
        rows = rows.join(old.select("stream", "_bytes"), "stream", "left").join(F.broadcast(old.agg(F.max("_us").alias("_us"))))
        rows = rows.withColumn("_end", F.col("_end") + F.coalesce("_bytes", F.lit(0))).withColumn("recorded_us", F.greatest("recorded_us", "_us")).drop("_bytes", "_us")
    store.append(rows.withColumn("byte_offset", F.col("_end") - F.col("frame_len")).drop("_end"), batch)
    return outcomes


def ingest(store: RecordStore, requests: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run commit() on each micro-batch of a streaming DataFrame of requests. The checkpoint and the manifest's batch
    names together make each micro-batch count once, also after a restart."""
    return requests.writeStream.foreachBatch(lambda df, n: commit(store, df, f"ingest-{n}") and None).option("checkpointLocation", checkpoint).start()

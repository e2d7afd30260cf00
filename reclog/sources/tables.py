"""Tables of events as committed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import frame_len
from ..operators.ordered import running, sequenced
from .store import RecordStore, shared_folder

SEGMENT_ENTRIES = 1000


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each event: streams by event type, clamped times, dense sequences and byte offsets.

    Walls are perturbed by up to a minute so that the clamp has work; times are in microseconds since 1970.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    wall = F.unix_micros(F.col("ts").cast("timestamp")) - F.pmod(F.col("event_id") * 7919, F.lit(61)) * 1_000_000
    df = e.select(
        F.lit("events").alias("namespace"), F.col("event_type").alias("stream"), F.col("event_id").alias("entry_id"), wall.alias("wall_us"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("producer"), F.col("props").alias("payload"),
        F.expr(f"event_id div {SEGMENT_ENTRIES}").alias("segment_id"),
    )
    size = frame_len(F.col("request_id"), F.col("producer"), F.create_map(F.lit("kind"), F.col("stream")), F.col("payload"))
    df = running(df.withColumn("frame_len", size), "wall_us", "recorded_us", "entry_id", how="max")
    df = running(sequenced(df, "entry_id", ("stream",)), "frame_len", "_end", "entry_id", ("stream",))
    return df.withColumn("byte_offset", F.col("_end") - F.col("frame_len")).drop("_end")


_STORED: dict[tuple[str, str], RecordStore] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the events of a folder, from a store below the shared folder.

    The first call of an application appends them to the store; events are append-only, so later calls read what is
    stored, sorted by stream and sequence, and filters on both reach the scan.
    """
    return stored(spark, sf_dir).scan()


def stored(spark: SparkSession, sf_dir: str) -> RecordStore:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not _STORED[key].generations():  # the shared folder may have been cleared
        store = RecordStore(spark, shared_folder(spark, "records"))
        store.append(derived(spark, sf_dir), "load")
        _STORED[key] = store
    return _STORED[key]

"""Compare-and-append of requests against the tails of their streams.

Outcomes depend on one stream's requests only; entry ids follow from the arrival order of what was accepted, by a running
sum. One call handles one micro-batch, in chunks of arrivals, so that no task holds or sorts a whole stream: each chunk
first tells which tail it would leave for each tail that it could meet, a walk over these tails gives each chunk the one
it does meet, and the requests of all chunks are then decided side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import running

#: Arrivals of a chunk, of which a Python worker holds one stream's requests at a time.
CHUNK = 1 << 18
MOST = (1 << 63) - 1
ORDER = ["arrival", "expected_sequence", "record_count"]


def _exits(rows: pa.Table) -> pa.Table:
    """The tail that a chunk of one stream leaves, for each tail that one of its requests would extend."""
    rows, leaves = rows.sort_by([(c, "ascending") for c in ORDER]), {}
    for want, n in zip(reversed(rows["expected_sequence"].to_pylist()), reversed(rows["record_count"].to_pylist())):
        end = min(want + n, MOST)
        leaves[want] = leaves.get(end, end)
    k = len(leaves)
    ends = [pa.array(list(leaves), pa.int64()), pa.array(list(leaves.values()), pa.int64())]
    return pa.table([rows["stream"].slice(0, k), rows["_chunk"].slice(0, k), *ends], names=["stream", "_chunk", "enters", "leaves"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tail that each chunk meets. Rows come by stream and chunk: the chunk itself, then its exits."""
    stream, at, meets, known = object(), 0, 0, False
    for b in batches:
        out = []
        for name, chunk, enters, leaves, tail, valid in zip(*(b[c].to_pylist() for c in ("stream", "_chunk", "enters", "leaves", "_tail", "_valid"))):
            if name != stream:
                stream, at, known = name, tail or 0, tail is not None
            if enters is None:
                meets = at
                out.append((name, chunk, at, valid and not known))
                known = known or valid
            elif enters == meets:
                at = leaves
        cols = list(zip(*out)) or [()] * 4
        yield pa.record_batch([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["stream", "_chunk", "_meets", "_new"])


def _walk(rows: pa.Table) -> pa.Table:
    """Requests of a chunk of one stream, with the tail that each meets and how it compares; LATE is left open."""
    rows = rows.sort_by([(c, "ascending") for c in (*ORDER, "request_id", "request_hash")])
    at, new = rows["_meets"][0].as_py() or 0, bool(rows["_new"][0].as_py())
    tails, found, registers = [], [], []
    for valid, want, n in zip(*(rows[c].to_pylist() for c in ("_valid", "expected_sequence", "record_count"))):
        tails.append(at)
        registers.append(valid and new)
        new = new and not valid
        found.append("INVALID_ARGUMENT" if not valid else "SEQUENCE_AHEAD" if want > at else "LATE" if want < at else "OK")
        if found[-1] == "OK":
            at += n
    for name, col in (("_at", pa.array(tails, pa.int64())), ("_found", pa.array(found, pa.string())), ("registers", pa.array(registers, pa.bool_()))):
        rows = rows.append_column(name, col)
    return rows.drop_columns(["_chunk", "_valid", "_meets", "_new"])


def decide(requests: DataFrame, tails: DataFrame | None = None, batches: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Outcome of each request (arrival, stream, expected_sequence, request_id, request_hash, record_count): arrival,
    stream, outcome, first_sequence, next_sequence, record_count, deduplicated, registers.

    tails has stream and next_sequence; batches has stream, first_sequence, request_id, request_hash, record_count of
    stored batches. A stream without a tail is unknown; its first valid request registers it, whatever becomes of it. A
    request before the tail is a repeat if the batch that begins at its place has its id, hash and count.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    whole = (F.col("record_count") > 0) & (F.col("stream") != "") & (F.col("request_id") != "") & F.col("expected_sequence").isNotNull()
    rows = requests.select(long("arrival"), "stream", long("expected_sequence"), "request_id", "request_hash", long("record_count"))
    rows = rows.withColumn("_chunk", F.floor(F.col("arrival") / chunk)).withColumn("_valid", F.coalesce(whole, F.lit(False)))

    # The tails that chunks meet: an exit counts only where the first tail or an earlier chunk leads to it.
    exits = rows.where("_valid").select("stream", "_chunk", *ORDER).groupBy("stream", "_chunk").applyInArrow(_exits, "stream string, _chunk long, enters long, leaves long")
    chunks = rows.where("stream is not null").groupBy("stream", "_chunk").agg(F.max("_valid").alias("_valid"))
    led = exits.groupBy("stream", F.col("leaves").alias("enters")).agg(F.min("_chunk").alias("_from"))
    exits = exits.join(led, ["stream", "enters"], "left")
    if tails is None:
        exits, chunks = exits.withColumn("_tail", F.lit(0).cast("long")), chunks.withColumn("_tail", F.lit(None).cast("long"))
    else:
        ends = tails.groupBy("stream").agg(F.max("next_sequence").cast("long").alias("_tail"))
        exits, chunks = exits.join(ends, "stream", "left"), chunks.join(ends, "stream", "left")
    exits = exits.where((F.col("_from") < F.col("_chunk")) | (F.col("enters") == F.coalesce("_tail", F.lit(0)))).select("stream", "_chunk", "enters", "leaves")
    steps = chunks.unionByName(exits, allowMissingColumns=True).repartition("stream").sortWithinPartitions("stream", "_chunk", F.col("enters").asc_nulls_first())
    meets = steps.select("stream", "_chunk", "enters", "leaves", "_tail", "_valid").mapInArrow(_chain, "stream string, _chunk long, _meets long, _new boolean")

    own = ["arrival", "stream", "expected_sequence", "request_id", "request_hash", "record_count"]
    schema = T.StructType([rows.schema[c] for c in own] + [T.StructField("_at", T.LongType()), T.StructField("_found", T.StringType()), T.StructField("registers", T.BooleanType())])
    done = rows.join(meets, ["stream", "_chunk"], "left").select(*own, "_chunk", "_valid", "_meets", "_new").groupBy("stream", "_chunk").applyInArrow(_walk, schema)

    # A place is taken once, and before any request that comes late for it.
    what = ("request_id", "request_hash", "record_count")
    keys = ["stream", "expected_sequence"]
    held = done.where("_found = 'OK'").select(*keys, F.struct(*what).alias("_held"))
    done = done.join(held, keys, "left")
    if batches is not None:
        old = batches.dropDuplicates(["stream", "first_sequence"]).select("stream", F.col("first_sequence").alias("expected_sequence"), F.struct("request_id", "request_hash", long("record_count")).alias("_old"))
        done = done.join(old, keys, "left").withColumn("_held", F.coalesce("_held", "_old"))
    same = F.col("_held").isNotNull()
    for c in what:
        same &= F.col(c).eqNullSafe(F.col("_held")[c])
    again = (F.col("_found") == "LATE") & same
    ok = again | (F.col("_found") == "OK")
    return done.select(
        "arrival", "stream", F.when(ok, "OK").when(F.col("_found") == "LATE", "SEQUENCE_CONFLICT").otherwise(F.col("_found")).alias("outcome"),
        F.when(ok, F.col("expected_sequence")).alias("first_sequence"), F.when(ok, F.col("expected_sequence") + F.col("record_count")).otherwise(F.col("_at")).alias("next_sequence"),
        F.when(ok, F.col("record_count")).otherwise(0).alias("record_count"), again.alias("deduplicated"), "registers",
    )


def entry_ids(outcomes: DataFrame, last_entry_id: int = -1) -> DataFrame:
    """Add first_entry_id and last_entry_id of new batches; a request that registers a stream takes one id before them."""
    new = F.when((F.col("outcome") == "OK") & ~F.col("deduplicated"), F.col("record_count")).otherwise(0)
    df = outcomes.withColumn("_new", new).withColumn("_ids", F.col("_new") + F.col("registers").cast("long"))
    df = running(df, "_ids", "_end", "arrival", chunk=CHUNK)
    last = F.when(F.col("_new") > 0, F.col("_end") + last_entry_id)
    return df.withColumn("last_entry_id", last).withColumn("first_entry_id", last - F.col("_new") + 1).drop("_new", "_ids", "_end")

"""Queries and their SQL by name.

Each query starts from the records of the events table. Most bodies are plain SQL over a relation `rec` and run
unchanged in both engines: LEN(x) stands for a length in bytes and SHA(x) for a SHA-256 in hex. On the Spark side
`rec` and the reads, tails, registry and extents come from the operators; on the oracle's side from plain windows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import append, maintain, ordered, reads
from ..sources.tables import records
from . import streams

REC = """WITH base AS (
  SELECT 'events' AS namespace, event_type AS stream, event_id AS entry_id,
    epoch_us(ts) - (event_id * 7919 % 61) * 1000000 AS wall_us, 'r' || event_id AS request_id, 'user/' || user_id AS producer,
    props AS payload, event_id // 1000 AS segment_id,
    CAST(116 + strlen('r' || event_id) + strlen('user/' || user_id) + 8 + 4 + strlen(event_type) + strlen(props) AS BIGINT) AS frame_len FROM events),
rec AS (
  SELECT *, max(wall_us) OVER (ORDER BY entry_id) AS recorded_us,
    row_number() OVER (PARTITION BY stream ORDER BY entry_id) - 1 AS sequence,
    CAST(sum(frame_len) OVER (PARTITION BY stream ORDER BY entry_id) - frame_len AS BIGINT) AS byte_offset FROM base)
"""
TAILS = "SELECT namespace, stream, max(sequence) + 1 AS next_sequence, max(byte_offset + frame_len) AS next_byte_offset, max_by(recorded_us, sequence) AS last_recorded_us, max(entry_id) AS last_entry_id, count(*) AS record_count FROM rec GROUP BY namespace, stream"
INSPECT = "SELECT namespace, stream, CAST(0 AS BIGINT) AS head, max(sequence) + 1 AS next_sequence, count(*) AS record_count, min_by(recorded_us, sequence) AS first_us, max_by(recorded_us, sequence) AS last_us FROM rec GROUP BY namespace, stream"
REGISTRY = "SELECT namespace, stream, min(entry_id) AS created_entry_id, CAST(row_number() OVER (ORDER BY min(entry_id)) AS BIGINT) AS stream_id FROM rec GROUP BY namespace, stream"
EXTENTS = "SELECT segment_id, stream, min(sequence) AS first_sequence, max(sequence) + 1 AS next_sequence, min(byte_offset) AS first_byte_offset, max(byte_offset + frame_len) AS next_byte_offset, min(recorded_us) AS first_us, max(recorded_us) AS last_us, min(entry_id) AS first_entry_id, max(entry_id) AS last_entry_id, count(*) AS record_count FROM rec GROUP BY segment_id, stream"
COLUMNS = "namespace, stream, sequence, entry_id, wall_us, recorded_us, frame_len, byte_offset, request_id, producer, payload"
TARGETS = "SELECT stream, recorded_us + shift AS target_us FROM rec CROSS JOIN (SELECT CAST(-1 AS BIGINT) AS shift UNION ALL SELECT CAST(0 AS BIGINT)) s WHERE sequence % 97 = 0 AND sequence < 2000"
#: The query asks over whole streams. The SQL keeps TARGETS, which are the same in streams of up to 2037 records.
WHOLE = TARGETS.removesuffix(" AND sequence < 2000")
FAR = "SELECT stream, max(recorded_us) + 1 AS target_us FROM rec GROUP BY stream"
REQUESTS = "SELECT stream, from_sequence, max_bytes FROM (SELECT 'click' AS stream, CAST(0 AS BIGINT) AS from_sequence, CAST(1000 AS BIGINT) AS max_bytes UNION ALL SELECT 'click', 999999999, 1000 UNION ALL SELECT 'nowhere', 0, 1000 UNION ALL SELECT 'view', 3, 1 UNION ALL SELECT 'click', -1, 10) q"


def _resolve_sql(mode: str, targets: str) -> str:
    op, seq, by = (">=", "min", "min_by") if mode == "AT_OR_AFTER" else ("<=", "max", "max_by")
    return f"SELECT t.stream, t.target_us, {seq}(r.sequence) AS sequence, {by}(r.recorded_us, r.sequence) AS recorded_us, {seq}(r.sequence) IS NOT NULL AS found FROM ({targets}) t LEFT JOIN rec r ON r.stream = t.stream AND r.recorded_us {op} t.target_us GROUP BY t.stream, t.target_us"


#: Bodies that both engines run.
SHARED = {
    "read_outcomes": f"""SELECT q.stream, q.from_sequence, CASE WHEN q.from_sequence < 0 OR q.max_bytes <= 0 THEN 'INVALID_ARGUMENT' WHEN t.next_sequence IS NULL THEN 'STREAM_NOT_FOUND'
        WHEN q.from_sequence > t.next_sequence THEN 'SEQUENCE_AHEAD' WHEN r.frame_len > q.max_bytes THEN 'RECORD_TOO_LARGE' ELSE 'OK' END AS outcome, t.next_sequence AS current_next_sequence,
        CASE WHEN r.frame_len > q.max_bytes THEN r.frame_len END AS required_bytes
        FROM ({REQUESTS}) q LEFT JOIN ({TAILS}) t ON t.stream = q.stream LEFT JOIN rec r ON r.stream = q.stream AND r.sequence = q.from_sequence""",
    "stored_projection": "SELECT stream, sequence, recorded_us, request_id, producer, payload, entry_id AS storage_entry_id FROM rec",
    "record_get": "SELECT stream, sequence, entry_id, payload FROM rec WHERE sequence = 42",
    "registry_lookup": f"SELECT stream, stream_id FROM ({REGISTRY}) g WHERE namespace = 'events' AND stream = 'click'",
    "registry_reverse": f"SELECT stream, stream_id FROM ({REGISTRY}) g WHERE stream_id = 2",
    "registry_delta": f"SELECT stream, stream_id, created_entry_id FROM ({REGISTRY}) g WHERE created_entry_id > 1",
    "registry_blocks": f"SELECT block, min(producer) AS first_name, count(*) AS n FROM (SELECT producer, CAST(floor((row_number() OVER (ORDER BY producer) - 1) / {columns.NAMES_A_BLOCK}) AS BIGINT) AS block FROM (SELECT DISTINCT producer FROM rec) d) b GROUP BY block",
    "latest_recorded": "SELECT max_by(recorded_us, entry_id) AS recorded_us, max(entry_id) AS entry_id FROM rec",
    "log_bounds": "SELECT min(entry_id) AS earliest, max(entry_id) + 1 AS next_entry, count(*) > 0 AS present FROM rec",
    "log_point": "SELECT entry_id, SHA(payload) AS checksum FROM rec WHERE entry_id = 77",
    "segment_totals": "SELECT segment_id, min(entry_id) AS first_entry_id, max(entry_id) AS last_entry_id, count(*) AS record_count, CAST(sum(frame_len) AS BIGINT) AS data_bytes, count(DISTINCT stream) AS streams FROM rec GROUP BY segment_id",
    "manifest_count": "SELECT CAST(sum(n) AS BIGINT) AS record_count, max(e) AS last_entry_id FROM (SELECT segment_id, count(*) AS n, max(entry_id) AS e FROM rec GROUP BY segment_id) s",
    "locator_pages": f"SELECT stream, count(*) AS extents, CAST(ceil(count(*) / {columns.EXTENTS_A_PAGE}.0) AS BIGINT) AS pages FROM ({EXTENTS}) x GROUP BY stream",
    "dense_index": "SELECT r.stream, r.sequence, r.byte_offset - x.first_byte_offset AS relative_offset, r.recorded_us - x.first_us AS time_delta, r.frame_len FROM rec r JOIN (SELECT segment_id, stream, min(byte_offset) AS first_byte_offset, min(recorded_us) AS first_us FROM rec GROUP BY segment_id, stream) x ON r.segment_id = x.segment_id AND r.stream = x.stream",
    "batch_grouping": "SELECT stream, CAST(floor(sequence / 4) AS BIGINT) * 4 AS first_sequence, count(*) AS batch_count, min(entry_id) AS first_entry_id, max(entry_id) AS last_entry_id FROM rec GROUP BY stream, CAST(floor(sequence / 4) AS BIGINT)",
    "record_size": "SELECT stream, sequence, CAST(LEN('kind') + LEN(stream) + LEN(payload) AS BIGINT) AS size FROM rec",
    "admission_order": """SELECT entry_id, CASE WHEN entry_id % 11 = 0 THEN 'INVALID_ARGUMENT' WHEN entry_id % 7 = 0 THEN 'DURABILITY_UNAVAILABLE' WHEN producer = 'user/1' THEN 'PERMISSION_DENIED'
        WHEN LEN(payload) > 40 THEN 'RECORD_TOO_LARGE' ELSE 'OK' END AS outcome FROM rec""",
    "authz_prefix": "SELECT g.stream, p.operation, EXISTS (SELECT 1 FROM (SELECT 'c' AS prefix, 'READ' AS operation UNION ALL SELECT 'view', 'APPEND' UNION ALL SELECT 'p', 'READ') a WHERE substring(g.stream, 1, length(a.prefix)) = a.prefix AND a.operation = p.operation) AS allowed FROM (SELECT DISTINCT stream FROM rec) g CROSS JOIN (SELECT 'READ' AS operation UNION ALL SELECT 'APPEND' UNION ALL SELECT 'INSPECT') p",
    "producer_activity": "SELECT producer, stream, count(*) AS requests, CAST(sum(frame_len) AS BIGINT) AS bytes FROM rec GROUP BY producer, stream",
    "scrub_sequence": "SELECT stream, sequence FROM (SELECT stream, sequence, lag(sequence) OVER (PARTITION BY stream, CAST(floor(sequence / 100000) AS BIGINT) ORDER BY sequence) AS p FROM rec WHERE entry_id % 1001 <> 5) s WHERE p IS NOT NULL AND sequence <> p + 1",
    "scrub_offsets": "SELECT a.stream, a.sequence FROM rec a JOIN rec b ON a.stream = b.stream AND a.sequence = b.sequence + 1 WHERE a.byte_offset <> b.byte_offset + b.frame_len + CASE WHEN b.entry_id % 997 = 3 THEN 1 ELSE 0 END",
    "scrub_time": "SELECT a.stream, a.sequence FROM rec a JOIN rec b ON a.stream = b.stream AND a.sequence = b.sequence + 1 WHERE a.wall_us < b.wall_us",
    "scrub_extents": f"SELECT stream, first_sequence FROM (SELECT stream, first_sequence, lag(next_sequence) OVER (PARTITION BY stream ORDER BY first_sequence) AS p FROM ({EXTENTS}) x WHERE segment_id <> 4) y WHERE p <> first_sequence",
    "scrub_registry": f"SELECT count(*) AS streams, count(DISTINCT stream_id) AS ids, max(stream_id) AS last_id FROM ({REGISTRY}) g",
    "scrub_report": "SELECT count(DISTINCT segment_id) AS segments, count(*) AS records, count(DISTINCT stream) AS streams, CAST(sum(frame_len) AS BIGINT) AS bytes FROM rec",
    "chain_verify": "SELECT a.entry_id FROM rec a JOIN rec b ON a.entry_id = b.entry_id + 1 WHERE SHA(b.payload) <> CASE WHEN a.entry_id % 500 = 9 THEN 'damaged' ELSE SHA(b.payload) END",
    "compaction_choice": """SELECT run, min(segment_id) AS first_segment, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT segment_id, bytes, segment_id - row_number() OVER (ORDER BY segment_id) AS run
        FROM (SELECT segment_id, CAST(sum(frame_len) AS BIGINT) AS bytes FROM rec WHERE segment_id NOT IN (2, 5) GROUP BY segment_id) s) t GROUP BY run HAVING count(*) >= 2""",
    "merge_union": "SELECT stream, min(sequence) AS first_sequence, max(sequence) + 1 AS next_sequence, count(*) AS n, count(*) = max(sequence) + 1 - min(sequence) AS continuous FROM (SELECT * FROM rec WHERE segment_id = 0 UNION ALL SELECT * FROM rec WHERE segment_id = 1) u GROUP BY stream",
    "manifest_match": "SELECT coalesce(m.segment_id, l.segment_id) AS segment_id, m.n AS listed, l.n AS present FROM (SELECT segment_id, count(*) AS n FROM rec GROUP BY segment_id) m FULL OUTER JOIN (SELECT segment_id, count(*) AS n FROM rec WHERE segment_id <> 3 AND entry_id <> 10 GROUP BY segment_id) l ON m.segment_id = l.segment_id WHERE m.n IS DISTINCT FROM l.n",
    "artifact_replace": "SELECT segment_id, 'new' AS origin FROM rec WHERE segment_id IN (1, 2) GROUP BY segment_id UNION ALL SELECT segment_id, 'kept' FROM rec WHERE segment_id NOT IN (1, 2) GROUP BY segment_id",
    "layered_scan": "SELECT stream, count(*) AS n, max(sequence) AS last_sequence FROM (SELECT * FROM rec WHERE entry_id < 500 UNION ALL SELECT * FROM rec WHERE entry_id >= 500) u GROUP BY stream",
    "wal_gc_prefix": "SELECT f.segment_id FROM (SELECT segment_id, max(entry_id) AS last_entry FROM rec GROUP BY segment_id) f WHERE f.last_entry <= 4999 AND f.segment_id < (SELECT min(segment_id) FROM rec WHERE segment_id >= 3)",
    "committed_view": "SELECT stream, count(*) AS visible FROM rec WHERE entry_id <= 800 GROUP BY stream",
    "replica_diff": "SELECT a.entry_id FROM rec a LEFT JOIN (SELECT entry_id, CASE WHEN entry_id = 321 THEN 'x' ELSE payload END AS payload FROM rec WHERE entry_id < 900) b ON a.entry_id = b.entry_id WHERE b.entry_id IS NULL OR SHA(a.payload) <> SHA(b.payload)",
    "replica_plan": """SELECT name, CASE WHEN durable IS NULL AND earliest = 0 THEN 'INCREMENTAL' WHEN durable + 1 >= earliest THEN 'INCREMENTAL' WHEN snapshot IS NOT NULL THEN 'SNAPSHOT' ELSE 'ERROR' END AS plan,
        CASE WHEN durable IS NULL AND earliest = 0 THEN 0 WHEN durable + 1 >= earliest THEN durable + 1 WHEN snapshot IS NOT NULL THEN snapshot + 1 END AS start_entry
        FROM (SELECT 'empty' AS name, CAST(NULL AS BIGINT) AS durable, CAST(0 AS BIGINT) AS earliest, CAST(NULL AS BIGINT) AS snapshot UNION ALL SELECT 'behind', 4, 0, NULL UNION ALL SELECT 'collected', 2, 5, 7 UNION ALL SELECT 'lost', 2, 5, NULL) s""",
    "rejoin_decision": "SELECT name, CASE WHEN local_crc = primary_crc THEN 'INCREMENTAL' WHEN committed <= shared THEN 'SNAPSHOT' ELSE 'FAIL' END AS decision FROM (SELECT 'same' AS name, 7 AS local_crc, 7 AS primary_crc, 3 AS committed, 3 AS shared UNION ALL SELECT 'forked', 7, 8, 3, 4 UNION ALL SELECT 'lost', 7, 8, 5, 4) s",
    "lag": "SELECT name, greatest(coalesce(local_durable - replicated, 0), 0) AS replication_lag, greatest(coalesce(committed - applied, 0), 0) AS apply_lag FROM (SELECT 'a' AS name, 10 AS local_durable, 7 AS replicated, 7 AS committed, 5 AS applied UNION ALL SELECT 'b', 10, NULL, 9, NULL) s",
    "diagnostics_status": "SELECT name, CASE WHEN recovering THEN 'RECOVERING' WHEN fatal THEN 'FATAL' WHEN draining THEN 'DRAINING' WHEN critical THEN 'CAPACITY' ELSE 'READY' END AS status FROM (SELECT 'a' AS name, false AS recovering, true AS fatal, true AS draining, false AS critical UNION ALL SELECT 'b', true, true, false, false UNION ALL SELECT 'c', false, false, false, true UNION ALL SELECT 'd', false, false, false, false) s",
    "storage_by_kind": "SELECT CASE WHEN segment_id < 2 THEN 'segment' ELSE 'log' END AS kind, count(DISTINCT segment_id) AS files, CAST(sum(frame_len) AS BIGINT) AS bytes FROM rec GROUP BY CASE WHEN segment_id < 2 THEN 'segment' ELSE 'log' END",
    "bench_report": "SELECT stream, count(*) AS requests, CASE WHEN max(recorded_us) > min(recorded_us) THEN CAST(count(*) AS DOUBLE) * 1000000 / (max(recorded_us) - min(recorded_us)) END AS per_second FROM rec GROUP BY stream",
}


def _body(name: str):
    sql = re.sub(r"\brec\b", "{rec}", SHARED[name].replace("LEN(", "octet_length("))
    sql = re.sub(r"SHA\(([\w.]+)\)", r"sha2(\1, 256)", sql)
    return lambda spark, d: spark.sql(sql, rec=records(spark, d)) if "{rec}" in sql else spark.sql(sql)


def _oracle(name: str) -> str:
    sql = SHARED[name].replace("LEN(", "strlen(").replace("SHA(", "sha256(")
    return REC + sql if re.search(r"\brec\b", sql) else sql


def _targets(spark: SparkSession, rec: DataFrame, sql: str) -> DataFrame:
    return spark.sql(re.sub(r"\brec\b", "{rec}", sql), rec=rec).distinct()


def _resolve(mode: str, targets: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rec = records(spark, d)
        return reads.resolve(rec, _targets(spark, rec, targets), mode)

    return query


def _read(stream: str, start: int, n: int, size: int):
    return lambda spark, d: reads.read(records(spark, d), stream, start, n, size).select("stream", "sequence", "entry_id", "frame_len", "running_bytes")


def _read_sql(stream: str, start: int, n: int, size: int) -> str:
    return REC + f"SELECT * FROM (SELECT stream, sequence, entry_id, frame_len, CAST(sum(frame_len) OVER (ORDER BY sequence) AS BIGINT) AS running_bytes FROM rec WHERE stream = '{stream}' AND sequence >= {start} AND sequence < {start + n}) s WHERE running_bytes <= {size}"


def _tail_read(spark: SparkSession, d: str) -> DataFrame:
    rec = records(spark, d)
    ends = reads.tails(rec).select("stream", "next_sequence")
    return rec.join(ends, "stream").where("sequence >= next_sequence").select("stream", "sequence", "entry_id")


def _locate(spark: SparkSession, d: str) -> DataFrame:
    rec = records(spark, d)
    points = spark.sql("SELECT stream, sequence FROM {rec} WHERE sequence % 50 = 0 UNION ALL SELECT DISTINCT stream, CAST(999999999 AS BIGINT) FROM {rec}", rec=rec)
    return reads.locate(reads.extents(rec), points)


def _gap_fill(spark: SparkSession, d: str) -> DataFrame:
    slots = reads.registry(records(spark, d)).where("stream_id <> 3").select("stream_id", "stream")
    every = slots.agg(F.max("stream_id").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("stream_id"))
    return every.join(slots, "stream_id", "left").select("stream_id", "stream", F.col("stream").isNull().alias("empty"))


def _hash(spark: SparkSession, d: str) -> DataFrame:
    rec = records(spark, d)
    body = F.array(F.struct(F.create_map(F.lit("kind"), F.encode("stream", "utf-8")).alias("headers"), F.encode("payload", "utf-8").alias("payload")))
    return rec.select("entry_id", columns.request_hash(F.col("namespace"), F.col("stream"), F.col("sequence"), F.col("request_id"), body).alias("request_hash"))


def _hash_sql() -> str:
    le = lambda n: f"unhex({' || '.join(f'substr(lpad(hex({n}), 16, chr(48)), {k}, 2)' for k in range(15, 0, -2))})"
    put = lambda x: f"({le(f'octet_length({x})')} || {x})"
    text = lambda x: f"encode({x})"
    heads = put(text("'kind'")) + " || " + put(text("stream"))
    return REC + f"SELECT entry_id, sha256({put(text(chr(39) + columns.DOMAIN + chr(39)))} || {put(text('namespace'))} || {put(text('stream'))} || {put(text('CAST(sequence AS VARCHAR)'))} || {put(text('request_id'))} || {put(f'({heads})')} || {put(text('payload'))}) AS request_hash FROM rec"


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    rec = records(spark, d)
    text = lambda m: F.array_join(F.transform(columns.canonical(m), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return rec.select("entry_id", text(F.create_map(F.lit("z"), F.col("stream"), F.lit("a"), F.col("producer"))).alias("headers"))


def _compaction(spark: SparkSession, d: str) -> DataFrame:
    """What the merge of the compaction choice holds, whatever segments the table has."""
    rec = records(spark, d)
    return maintain.merged(rec, maintain.compaction_inputs(maintain.segments(rec)))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Append requests made from records: some repeat an earlier one, some conflict, some are ahead."""
    return records(spark, d).select(
        F.col("entry_id").alias("arrival"), "stream",
        (F.col("sequence") - F.when(F.col("sequence") % 10 == 9, 1).otherwise(0) + F.when(F.col("sequence") % 25 == 24, 50).otherwise(0)).alias("expected_sequence"),
        "request_id", F.sha2("payload", 256).alias("request_hash"), F.lit(1).cast("long").alias("record_count"),
    )


QUERIES = {name: _body(name) for name in SHARED} | {
    "records_assign": lambda s, d: records(s, d).select(*COLUMNS.split(", ")),
    "read_range": _read("click", 5, 100, 1 << 40),
    "read_budget": _read("click", 5, 100, 1000),
    "read_at_tail_empty": _tail_read,
    "inspect_stream": lambda s, d: reads.inspect(records(s, d)),
    "tails": lambda s, d: reads.tails(records(s, d)),
    "registry": lambda s, d: reads.registry(records(s, d)),
    "resolve_at_or_after": _resolve("AT_OR_AFTER", WHOLE),
    "resolve_at_or_before": _resolve("AT_OR_BEFORE", WHOLE),
    "resolve_not_found": _resolve("AT_OR_AFTER", FAR),
    "scrub_sequence": lambda s, d: reads.gaps(records(s, d).where("entry_id % 1001 <> 5")),
    "extents": lambda s, d: reads.extents(records(s, d)),
    "extent_lookup": _locate,
    "tail_gap_fill": _gap_fill,
    "time_clamp": lambda s, d: ordered.running(records(s, d).select("entry_id", "wall_us"), "wall_us", "clamped_us", "entry_id", how="max").withColumn("changed", F.col("clamped_us") != F.col("wall_us")),
    "byte_offset": lambda s, d: records(s, d).select("stream", "sequence", "byte_offset"),
    "request_hash": _hash,
    "canonical_headers": _canonical,
    "compaction_inputs": lambda s, d: maintain.compaction_inputs(maintain.segments(records(s, d))),
    "compaction_merge": _compaction,
    "append_outcomes": lambda s, d: append.entry_ids(append.decide(requests(s, d))),
}
ORACLE_SQL = {name: _oracle(name) for name in SHARED} | {
    "records_assign": REC + f"SELECT {COLUMNS} FROM rec",
    "read_range": _read_sql("click", 5, 100, 1 << 40),
    "read_budget": _read_sql("click", 5, 100, 1000),
    "read_at_tail_empty": REC + f"SELECT r.stream, r.sequence, r.entry_id FROM rec r JOIN ({TAILS}) t ON r.stream = t.stream WHERE r.sequence >= t.next_sequence",
    "inspect_stream": REC + INSPECT,
    "tails": REC + TAILS,
    "registry": REC + REGISTRY,
    "resolve_at_or_after": REC + _resolve_sql("AT_OR_AFTER", TARGETS),
    "resolve_at_or_before": REC + _resolve_sql("AT_OR_BEFORE", TARGETS),
    "resolve_not_found": REC + _resolve_sql("AT_OR_AFTER", FAR),
    "extents": REC + EXTENTS,
    "extent_lookup": REC + f"SELECT p.stream, p.sequence, x.segment_id FROM (SELECT stream, sequence FROM rec WHERE sequence % 50 = 0 UNION ALL SELECT DISTINCT stream, CAST(999999999 AS BIGINT) FROM rec) p LEFT JOIN ({EXTENTS}) x ON p.stream = x.stream AND p.sequence >= x.first_sequence AND p.sequence < x.next_sequence",
    "tail_gap_fill": REC + f"SELECT i.stream_id, g.stream, g.stream IS NULL AS empty FROM (SELECT unnest(range(0, (SELECT max(stream_id) + 1 FROM ({REGISTRY}) m WHERE stream_id <> 3))) AS stream_id) i LEFT JOIN (SELECT * FROM ({REGISTRY}) h WHERE stream_id <> 3) g ON i.stream_id = g.stream_id",
    "time_clamp": REC + "SELECT entry_id, wall_us, recorded_us AS clamped_us, recorded_us <> wall_us AS changed FROM rec",
    "byte_offset": REC + "SELECT stream, sequence, byte_offset FROM rec",
    "request_hash": _hash_sql(),
    "canonical_headers": REC + "SELECT entry_id, 'a=' || producer || ';z=' || stream AS headers FROM rec",
}
#: Where both name a query, its operator's form replaces the body shared by both engines.
QUERIES |= streams.QUERIES
ORACLE_SQL |= streams.oracle_sql(REC)

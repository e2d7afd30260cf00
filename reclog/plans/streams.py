"""Queries over the commit log, replication, validation, access, the registry and upkeep, and their SQL.

Inputs with faults are made from the records by INPUTS, plain SQL that both engines run; what is found in them comes
from the operators on one side and from SQL of its own on the other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import access, log, reads, recovery, registry, replicate, upkeep, validate
from ..sources.tables import stored

FILE = 100
PAGE = 4

#: The log and its files for the oracle, after its records.
LOG = f""", tl AS (SELECT stream, count(*) AS n FROM rec GROUP BY stream),
lg AS (SELECT r.entry_id, r.entry_id // {FILE} AS file_id, r.stream, r.sequence, r.sequence % 3 AS batch_index, least(3, tl.n - r.sequence + r.sequence % 3) AS batch_count, r.request_id, r.frame_len,
  r.recorded_us, CAST('0x' || substr(sha256(r.payload), 1, 8) AS BIGINT) AS checksum FROM rec r JOIN tl ON r.stream = tl.stream),
log AS (SELECT *, coalesce(lag(checksum) OVER (ORDER BY entry_id), 0) AS previous_checksum FROM lg),
files AS (SELECT file_id, min(entry_id) AS first_entry_id, max(entry_id) AS last_entry_id, count(*) AS entries, CAST(sum(frame_len) AS BIGINT) AS bytes, arg_min(previous_checksum, entry_id) AS previous_checksum, arg_max(checksum, entry_id) AS last_checksum FROM log GROUP BY file_id),
extents AS (SELECT segment_id, stream, min(sequence) AS first_sequence, max(sequence) + 1 AS next_sequence, min(byte_offset) AS first_byte_offset, max(byte_offset + frame_len) AS next_byte_offset, min(recorded_us) AS first_us, max(recorded_us) AS last_us, min(entry_id) AS first_entry_id, max(entry_id) AS last_entry_id, count(*) AS record_count
  FROM (SELECT * EXCLUDE (segment_id), entry_id // {FILE} AS segment_id FROM rec) r GROUP BY segment_id, stream),
registry AS (SELECT namespace, stream, min(entry_id) AS created_entry_id, CAST(row_number() OVER (ORDER BY min(entry_id)) AS BIGINT) AS stream_id FROM rec GROUP BY namespace, stream)
"""

#: Inputs by name. Both engines run them over rec, log, files, extents and registry.
INPUTS = {
    "damaged": "SELECT entry_id, file_id, stream, sequence, batch_index, batch_count, frame_len, recorded_us, checksum, CASE WHEN entry_id % 97 = 13 THEN previous_checksum + 1 ELSE previous_checksum END AS previous_checksum FROM log WHERE entry_id % 101 <> 50",
    "torn": "SELECT * FROM log WHERE entry_id <> 651",
    "footers": "SELECT file_id, entries + CASE WHEN file_id % 5 = 2 THEN 1 ELSE 0 END AS entries, bytes + CASE WHEN file_id % 5 = 3 THEN 1 ELSE 0 END AS bytes, last_checksum + CASE WHEN file_id % 7 = 4 THEN 1 ELSE 0 END AS last_checksum FROM files WHERE file_id % 5 <> 1 UNION ALL SELECT max(file_id) + 1, 0, 0, 0 FROM files",
    "shifted": "SELECT file_id, CASE WHEN file_id % 11 = 7 THEN first_entry_id - 5 ELSE first_entry_id END AS first_entry_id, last_entry_id, previous_checksum, CASE WHEN file_id % 13 = 5 THEN last_checksum + 1 ELSE last_checksum END AS last_checksum FROM files WHERE file_id % 17 <> 3",
    "sealed": "SELECT f.*, f.file_id < m.last AS sealed, f.file_id = 7 AS pinned FROM files f CROSS JOIN (SELECT max(file_id) AS last FROM files) m",
    "retained": "SELECT entry_id, checksum FROM log WHERE entry_id >= 200 AND entry_id % 301 <> 149",
    "asked": "SELECT entry_id FROM log WHERE entry_id % 50 = 0 UNION ALL SELECT max(entry_id) + 10 FROM log UNION ALL SELECT min(entry_id) FROM log WHERE entry_id % 301 = 149 AND entry_id > 200",
    "standby": "SELECT entry_id, checksum + CASE WHEN entry_id % 160 = 1 THEN 1 ELSE 0 END AS checksum FROM log WHERE entry_id <= 500 AND entry_id % 211 <> 7",
    "incoming": "SELECT entry_id, checksum, previous_checksum FROM log WHERE entry_id >= 450 AND entry_id <> 777",
    "suffix": "SELECT * FROM log WHERE entry_id > 700 AND entry_id % 89 <> 11",
    "status": """SELECT concat('n', file_id) AS name, CASE WHEN file_id % 2 = 0 THEN 'PRIMARY' ELSE 'STANDBY' END AS role, file_id % 5 AS term, last_entry_id - file_id % 3 AS local_durable, CASE WHEN file_id % 4 <> 1 THEN last_entry_id - file_id % 4 END AS replicated,
        last_entry_id - file_id % 6 AS committed, last_entry_id - file_id % 7 AS applied, CASE WHEN file_id % 3 = 0 THEN 0 ELSE last_entry_id + 2 - file_id % 4 END AS earliest, CASE WHEN file_id % 5 <> 2 THEN last_entry_id - file_id % 5 END AS snapshot, last_entry_id - file_id % 4 AS shared,
        file_id % 5 = 1 AS recovering, file_id % 7 = 2 AS fatal, file_id % 3 = 1 AS draining, file_id % 4 = 3 AS critical, file_id % 6 = 5 AS guarded FROM files""",
    "states": "SELECT file_id + 1 AS generation, concat('d', file_id) AS digest, CASE WHEN file_id % 9 = 4 THEN 'x' ELSE concat('d', file_id - 1) END AS previous_digest, last_entry_id AS committed, CASE WHEN file_id % 8 = 6 THEN first_entry_id - 200 ELSE last_entry_id - 1 END AS applied, file_id AS term, first_entry_id AS earliest FROM files WHERE file_id % 12 <> 10",
    "messages": "SELECT entry_id AS arrival, entry_id // 40 - CASE WHEN entry_id % 23 = 5 THEN 2 ELSE 0 END AS term FROM log",
    "acks": "SELECT entry_id AS arrival, CASE WHEN entry_id % 3 = 0 THEN 'standby' ELSE 'primary' END AS node, entry_id - CASE WHEN entry_id % 3 = 0 THEN 7 ELSE 1 END AS entry_id FROM log WHERE entry_id >= 10",
    "index": "SELECT r.entry_id // 100 AS segment_id, r.stream, r.sequence, r.byte_offset - x.first_byte_offset + CASE WHEN r.entry_id % 131 = 9 THEN 1 ELSE 0 END AS relative_offset, r.recorded_us - x.first_us - CASE WHEN r.entry_id % 143 = 17 THEN 1000000000 ELSE 0 END AS time_delta, r.frame_len FROM rec r JOIN extents x ON r.entry_id // 100 = x.segment_id AND r.stream = x.stream WHERE r.entry_id % 177 <> 44",
    "totals": "SELECT segment_id, CAST(sum(record_count) AS BIGINT) + CASE WHEN segment_id % 4 = 1 THEN 1 ELSE 0 END AS record_count, CAST(sum(next_byte_offset - first_byte_offset) AS BIGINT) + CASE WHEN segment_id % 3 = 2 THEN 5 ELSE 0 END AS data_bytes, min(first_entry_id) - CASE WHEN segment_id % 5 = 3 THEN 1 ELSE 0 END AS first_entry_id, max(last_entry_id) AS last_entry_id FROM extents GROUP BY segment_id UNION ALL SELECT max(segment_id) + 1, 0, 0, 0, 0 FROM extents",
    "holed": "SELECT segment_id, stream, CASE WHEN segment_id % 7 = 4 THEN first_sequence - 1 ELSE first_sequence END AS first_sequence, next_sequence FROM extents WHERE segment_id % 10 <> 8",
    "headers": f"SELECT stream, page, min(first_sequence) AS first_sequence, max(next_sequence) + CASE WHEN page % 3 = 1 THEN 1 ELSE 0 END AS next_sequence, count(*) AS extents FROM (SELECT h.*, CAST(floor((row_number() OVER (PARTITION BY stream ORDER BY first_sequence, segment_id) - 1) / {PAGE}) AS BIGINT) AS page FROM holed h) p WHERE page % 5 <> 2 GROUP BY stream, page UNION ALL SELECT stream, 999, 0, 0, 0 FROM registry",
    "references": "SELECT file_id AS position, file_id AS segment_id, entries AS record_count, CASE WHEN file_id % 6 = 4 THEN first_entry_id - 3 ELSE first_entry_id END AS first_entry_id, last_entry_id FROM files",
    "header": "SELECT count(*) AS segments, CAST(sum(entries) AS BIGINT) + 1 AS record_count, max(last_entry_id) AS last_entry_id FROM files",
    "artifacts": "SELECT CASE WHEN file_id % 4 = 0 THEN 'tails' ELSE concat('a', file_id) END AS type, last_entry_id + CASE WHEN file_id = 1 THEN 100000000 ELSE 0 END AS covers_entry_id FROM files",
    "people": "SELECT entry_id, CASE WHEN entry_id % 13 = 0 THEN '' ELSE concat('t', entry_id % 4) END AS tenant, CASE WHEN entry_id % 17 = 0 THEN 'a/b' ELSE concat('s', entry_id % 3) END AS service, CASE WHEN entry_id % 5 = 0 THEN concat('i', entry_id % 7) END AS instance FROM log",
    "certificates": "SELECT file_id AS certificate, concat('uri:', file_id % 6) AS uri FROM files UNION ALL SELECT file_id, concat('uri:', (file_id + file_id % 3) % 8) FROM files",
    "names": "SELECT DISTINCT concat('uri:', file_id % 6) AS uri, concat('p', file_id % 6 // 2) AS principal FROM files",
    "wishes": "SELECT entry_id, concat('t', entry_id % 3) AS tenant, 's' AS service, CASE WHEN entry_id % 2 = 0 THEN concat('i', entry_id % 5) END AS instance, 'events' AS namespace, stream, CASE WHEN entry_id % 4 = 0 THEN 'APPEND' WHEN entry_id % 4 = 1 THEN 'READ' ELSE 'INSPECT' END AS operation FROM log",
    "rules": "SELECT concat('t', stream_id % 3) AS tenant, 's' AS service, CASE WHEN stream_id % 2 = 0 THEN concat('i', stream_id % 5) END AS instance, 'events' AS namespace, substring(stream, 1, CAST(stream_id AS INT)) AS prefix, CASE WHEN stream_id % 2 = 0 THEN 'READ' ELSE 'APPEND' END AS operation FROM registry UNION ALL SELECT 't1', 's', NULL, 'events', '', 'INSPECT'",
    "requests": "SELECT entry_id, entry_id % 41 = 0 AS draining, 'events' AS namespace, CASE WHEN entry_id % 37 = 0 THEN '' ELSE stream END AS stream, CASE WHEN entry_id % 31 = 0 THEN '' ELSE request_id END AS request_id, CASE WHEN entry_id % 7 = 0 THEN 'STRICT' ELSE 'UNSPECIFIED' END AS durability, entry_id % 19 <> 0 AS allowed, entry_id % 23 * 60 AS record_count, frame_len * 200000 AS largest_record, frame_len * 1000000 AS bytes FROM log",
    "facts": "SELECT namespace, stream, stream_id, created_entry_id FROM registry UNION ALL SELECT namespace, concat(stream, '2'), stream_id + 100, created_entry_id + 7 FROM registry UNION ALL SELECT namespace, stream, stream_id + 50, created_entry_id FROM registry WHERE stream_id = 2 UNION ALL SELECT namespace, 'other', stream_id, created_entry_id FROM registry WHERE stream_id = 3",
    "known": "SELECT * FROM registry WHERE stream_id <= 3",
    "births": "SELECT namespace, producer AS stream, entry_id AS arrival FROM rec UNION ALL SELECT namespace, stream, entry_id FROM rec",
    "assignments": "SELECT file_id AS sequence, file_id + 1 + CASE WHEN file_id % 8 = 5 THEN 3 ELSE 0 END AS stream_id FROM files WHERE file_id % 9 <> 4",
    "catalog": "SELECT stream, max(sequence) + 1 AS next_sequence FROM rec WHERE entry_id < 600 AND stream <> 'view' GROUP BY stream",
    "active": "SELECT stream, max(sequence) + 1 AS next_sequence FROM rec WHERE entry_id >= 600 AND stream <> 'click' GROUP BY stream",
    "stored": "SELECT concat('f', file_id) AS path, CASE WHEN file_id % 5 = 0 THEN 'segment' WHEN file_id % 5 = 1 THEN 'log' WHEN file_id % 5 = 2 THEN 'odd' WHEN file_id % 5 = 3 THEN 'snapshot' ELSE 'strange' END AS kind, bytes FROM files",
    "samples": "SELECT entry_id AS tick, CAST(entry_id * 37 % 101 AS DOUBLE) / 100 AS used FROM log",
    "pending": "SELECT concat('n', file_id) AS name, bytes * 100 AS age_us, CASE WHEN file_id % 6 = 0 THEN 0 ELSE bytes END AS pending_bytes, bytes * (file_id % 4) AS log_bytes, file_id % 5 = 2 AS critical, file_id % 7 = 3 AS entered_high FROM files",
    "old_files": "SELECT concat('f', file_id) AS path, file_id AS generation, CASE WHEN file_id % 3 = 1 THEN file_id + 2 END AS dropped_generation FROM files",
    "live_files": "SELECT concat('f', file_id) AS path FROM files WHERE file_id % 3 <> 1",
    "pins": "SELECT file_id AS generation FROM files WHERE file_id IN (5, 6)",
    "snapshots": "SELECT concat('s', file_id) AS snapshot_id, last_entry_id AS covers_entry_id, file_id % 3 <> 0 AS verified FROM files",
    "wanted": "SELECT concat('f', file_id) AS path, bytes, concat('d', last_checksum) AS digest FROM files WHERE file_id % 9 <> 8",
    "present": "SELECT concat('f', file_id) AS path, bytes + CASE WHEN file_id % 6 = 1 THEN 1 ELSE 0 END AS bytes, concat('d', last_checksum + CASE WHEN file_id % 4 = 2 THEN 1 ELSE 0 END) AS digest FROM files WHERE file_id % 7 <> 5",
    "calls": "SELECT stream AS method, CASE WHEN entry_id % 9 = 0 THEN 'SEQUENCE_CONFLICT' ELSE 'OK' END AS code, entry_id * 7919 % 2000000 AS took_us FROM log",
    "groups": "SELECT file_id AS stage, entries % 64 + 1 AS requests, bytes, first_entry_id * 13 % 900 AS wait_us FROM files",
    "codes": "SELECT DISTINCT stream, CASE WHEN stream = 'click' THEN 'DATA_LOSS' WHEN stream = 'view' THEN 'RESOURCE_EXHAUSTED' ELSE 'SEQUENCE_AHEAD' END AS code FROM rec UNION ALL SELECT 'x', 'NOT_A_CODE'",
    "paths": "SELECT DISTINCT concat(CASE WHEN entry_id % 5 = 0 THEN '/' WHEN entry_id % 5 = 1 THEN '../' WHEN entry_id % 5 = 2 THEN './' ELSE '' END, stream, CASE WHEN entry_id % 3 = 0 THEN '/' WHEN entry_id % 3 = 1 THEN '/x' ELSE '/a/../b' END) AS path FROM rec",
    "faulty": "SELECT stream, sequence, entry_id, byte_offset + CASE WHEN entry_id % 199 = 7 THEN 1 ELSE 0 END AS byte_offset, frame_len, recorded_us - CASE WHEN entry_id % 211 = 9 THEN 1000000000 ELSE 0 END AS recorded_us FROM rec WHERE entry_id % 301 <> 5",
    "tiles": "SELECT * FROM extents WHERE segment_id % 6 <> 4",
    "reading": "SELECT entry_id AS request, CASE WHEN entry_id % 29 = 0 THEN 'nowhere' ELSE stream END AS stream, sequence + CASE WHEN entry_id % 31 = 0 THEN 1000000 ELSE 0 END AS from_sequence, entry_id % 7 AS max_records, CASE WHEN entry_id % 11 = 0 THEN 60 ELSE 400 + entry_id % 300 END AS max_bytes FROM rec",
}
VIEWS = ("log", "files", "extents", "registry", "rec")


class Tables:
    """The relations of one call, made as they are asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.store = spark, stored(spark, d)
        self.made = {"rec": self.store.scan()}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name == "log":
                self.made[name] = log.entries(self["rec"], FILE)
            elif name == "files":
                self.made[name] = log.files(self["log"])
            elif name == "extents":
                self.made[name] = reads.extents(self["rec"].withColumn("segment_id", F.expr(f"entry_id div {FILE}")))
            elif name == "registry":
                self.made[name] = reads.registry(self["rec"])
            else:
                sql = INPUTS[name].replace(" // ", " DIV ")
                used = [v for v in (*VIEWS, *INPUTS) if re.search(rf"(FROM|JOIN) {v}\b", sql)]
                sql = re.sub(rf"(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql)
                self.made[name] = self.spark.sql(sql, **{v: self[v] for v in used})
        return self.made[name]


def _rules(t: Tables) -> DataFrame:
    return t["rules"].withColumn("operations", F.array("operation")).drop("operation")


#: Queries over a Tables.
BODIES = {
    "log_entries": lambda t: t["log"].drop("request_id", "frame_len", "recorded_us"),
    "log_files": lambda t: t["files"],
    "log_broken": lambda t: log.broken(t["damaged"]),
    "log_valid_prefix": lambda t: log.valid_prefix(t["torn"]).select("entry_id", "checksum"),
    "log_replay": lambda t: log.replay(t["log"], 399, 900).select("entry_id", "stream", "sequence"),
    "log_leftovers": lambda t: log.leftovers(t["damaged"], 399),
    "log_footers": lambda t: log.footer_faults(t["log"], t["footers"]),
    "log_range": lambda t: log.history_range(t["log"], 300, 120, 9000),
    "log_points": lambda t: log.history_points(t["retained"], t["asked"]),
    "log_discovery": lambda t: log.discover(t["shifted"]),
    "log_collection": lambda t: log.collectable(t["sealed"], 920, 850).select("file_id", "collect"),
    "log_collection_report": lambda t: log.collection_report(t["sealed"], 920, 350, 10_000),
    "batch_grouping": lambda t: log.whole_batches(t["damaged"]),
    "chain_verify": lambda t: log.broken(t["damaged"]).where("fault = 'CHAIN'").select("entry_id"),
    "standby_receive": lambda t: replicate.receive(t["standby"], t["incoming"]),
    "committed_view": lambda t: replicate.visible(t["log"], 800).groupBy("stream").agg(F.count("*").alias("visible"), F.max("entry_id").alias("last_entry_id")),
    "replica_diff": lambda t: replicate.differences(t["log"], t["standby"]),
    "catch_up": lambda t: replicate.catch_up(t["log"], 500, 200, 12_000).select("entry_id", "checksum"),
    "terms": lambda t: replicate.terms(t["messages"]),
    "replica_plan": lambda t: replicate.planned(t["status"]).select("name", "plan", "start_entry"),
    "rejoin_decision": lambda t: replicate.rejoining(t["status"]).select("name", "decision"),
    "lag": lambda t: replicate.lags(t["status"]).select("name", "replication_lag", "apply_lag"),
    "acknowledged": lambda t: replicate.acknowledged(t["acks"]),
    "promotion_faults": lambda t: replicate.promotion_faults(t["suffix"], t["catalog"]),
    "promoted": lambda t: replicate.promoted(t["status"]),
    "recovery_task": lambda t: replicate.recovery_task(replicate.planned(t["status"])).select("name", "action", "task_id"),
    "replication_state_faults": lambda t: replicate.state_faults(t["status"]),
    "replication_state_chain": lambda t: replicate.state_chain_faults(t["states"]),
    "index_faults": lambda t: validate.index_faults(t["index"], t["extents"]),
    "layout_faults": lambda t: validate.layout_faults(t["extents"], t["totals"]),
    "page_faults": lambda t: validate.page_faults(validate.extent_pages(t["holed"], PAGE), t["headers"]),
    "manifest_faults": lambda t: validate.manifest_faults(t["references"], t["header"], t["artifacts"]),
    "diagnostics_status": lambda t: validate.diagnosed(t["status"]).select("name", "state", "ready"),
    "standby_diagnostics": lambda t: validate.standby_snapshot(t["status"]),
    "principals": lambda t: access.principals(t["people"]).select("entry_id", "valid", "producer"),
    "certificates": lambda t: access.certified(t["certificates"], t["names"]),
    "authz_prefix": lambda t: access.authorized(t["wishes"], _rules(t)).select("entry_id", "allowed"),
    "admission_order": lambda t: access.admitted(t["requests"]).select("entry_id", "outcome"),
    "rate_limit": lambda t: access.rate_limited(t["rec"].select(F.col("producer").alias("key"), F.col("entry_id").alias("arrival"), F.col("recorded_us").alias("time_us"), F.greatest(F.octet_length("payload"), F.lit(1)).alias("cost")), 0.01, 60.0),
    "registry_apply": lambda t: registry.applied(t["known"], t["facts"]),
    "registry_conflicts": lambda t: registry.conflicts(t["known"], t["facts"]),
    "registry_overlay": lambda t: registry.overlaid(t["registry"], t["known"].withColumn("created_entry_id", F.lit(0).cast("long"))),
    "registry_assign": lambda t: registry.assigned(t["known"], t["births"]),
    "registry_rebuild": lambda t: registry.rebuilt_faults(t["assignments"]),
    "layered_tails": lambda t: registry.layered_tails(t["catalog"], t["active"]),
    "storage_by_kind": lambda t: upkeep.storage_by_kind(t["stored"]),
    "capacity": lambda t: upkeep.capacity(t["samples"], 0.9, 0.5),
    "maintenance_due": lambda t: upkeep.due(t["pending"], 1_500_000, 16_500, 30_000),
    "segment_retire": lambda t: upkeep.retired(t["old_files"], t["live_files"], t["pins"]),
    "snapshot_retention": lambda t: upkeep.retention(t["snapshots"], 3),
    "snapshot_verify": lambda t: upkeep.snapshot_faults(t["wanted"], t["present"]),
    "snapshot_find": lambda t: upkeep.usable_snapshots(t["snapshots"], 400),
    "call_metrics": lambda t: upkeep.call_metrics(t["calls"]),
    "commit_stats": lambda t: upkeep.commit_stats(t["groups"]),
    "group_commit": lambda t: upkeep.grouped(t["log"].select(F.col("entry_id").alias("arrival"), "stream", F.col("frame_len").alias("bytes")), 64, 5000),
    "error_details": lambda t: t["codes"].select("stream", "code", kernels.error_detail(F.col("code"), "retryable").alias("retryable"), kernels.error_detail(F.col("code"), "uncertain").alias("uncertain")),
    "relative_paths": lambda t: t["paths"].select("path", kernels.relative_path(F.col("path")).alias("ok")),
    "arithmetic": lambda t: t["rec"].select("entry_id", kernels.saturating_multiply(F.col("recorded_us"), F.col("entry_id")).alias("product"), kernels.aligned(F.col("byte_offset"), 4096).alias("aligned")),
    "frame_crc": lambda t: t["rec"].select("entry_id", kernels.crc32c(F.encode("payload", "utf-8")).alias("crc")),
    "store_read": lambda t: t.store.read("click", 5, 100, 1000).select("stream", "sequence", "entry_id", "running_bytes"),
    "store_extents": lambda t: t.store.extents().groupBy("stream").agg(F.min("first_sequence").alias("first_sequence"), F.max("next_sequence").alias("next_sequence"), F.sum("record_count").alias("record_count")),
    "store_verify": lambda t: t.store.verify(),
    "scrub_all": lambda t: recovery.scrub(t["faulty"], t["tiles"]),
    "read_answers": lambda t: reads.answers(t["reading"], t["rec"]),
}

_BATCHES = "SELECT stream, sequence - batch_index AS first_sequence, max(batch_count) AS batch_count, count(DISTINCT batch_index) AS present, min(entry_id) AS first_entry_id, max(entry_id) AS last_entry_id, count(DISTINCT batch_index) = max(batch_count) AND count(*) = max(batch_count) AND max(batch_index) = max(batch_count) - 1 AND min(batch_count) = max(batch_count) AS complete FROM {} GROUP BY stream, sequence - batch_index"
_BROKEN = "SELECT entry_id, CASE WHEN p <> entry_id - 1 THEN 'GAP' WHEN c <> previous_checksum THEN 'CHAIN' END AS fault FROM (SELECT *, lag(entry_id) OVER (ORDER BY entry_id) AS p, lag(checksum) OVER (ORDER BY entry_id) AS c FROM {}) b WHERE p IS NOT NULL AND (p <> entry_id - 1 OR c <> previous_checksum)"
_PLAN = "SELECT *, CASE WHEN coalesce(local_durable + 1, 0) >= earliest THEN 'INCREMENTAL' WHEN snapshot + 1 >= earliest THEN 'SNAPSHOT' ELSE 'ERROR' END AS plan FROM status"
_COLLECT = "SELECT *, NOT EXISTS (SELECT 1 FROM sealed o WHERE o.first_entry_id <= f.first_entry_id AND NOT (o.sealed AND NOT o.pinned AND o.last_entry_id <= {})) AS collect FROM sealed f"
_PAGES = f"SELECT *, CAST(floor((row_number() OVER (PARTITION BY stream ORDER BY first_sequence, segment_id) - 1) / {PAGE}) AS BIGINT) AS page FROM holed"
_EVERY = "(SELECT namespace, stream, stream_id FROM known UNION SELECT namespace, stream, stream_id FROM facts)"
_CONFLICTS = f"SELECT namespace, stream, stream_id, CASE WHEN ids > 1 THEN 'NAME' ELSE 'ID' END AS fault FROM (SELECT *, (SELECT count(*) FROM {_EVERY} e WHERE e.namespace = f.namespace AND e.stream = f.stream) AS ids, (SELECT count(*) FROM {_EVERY} e WHERE e.stream_id = f.stream_id) AS ns FROM (SELECT DISTINCT namespace, stream, stream_id FROM facts) f) c WHERE ids > 1 OR ns > 1"

#: The oracle's own SQL; inputs are views of the same names.
SQL = {
    "log_entries": "SELECT entry_id, file_id, stream, sequence, batch_index, batch_count, checksum, previous_checksum FROM log",
    "log_files": "SELECT * FROM files",
    "log_broken": _BROKEN.format("damaged"),
    "log_valid_prefix": "SELECT entry_id, checksum FROM torn WHERE entry_id < 651",
    "log_replay": "SELECT entry_id, stream, sequence FROM (SELECT *, count(*) OVER (PARTITION BY stream, sequence - batch_index) AS n FROM log WHERE entry_id > 399 AND entry_id <= 900) w WHERE n = batch_count",
    "log_leftovers": f"SELECT stream, first_sequence, batch_count, present FROM ({_BATCHES.format('(SELECT * FROM damaged WHERE entry_id > 399) d')}) b WHERE NOT complete",
    "log_footers": "SELECT coalesce(o.file_id, f.file_id) AS file_id, CASE WHEN f.file_id IS NULL THEN 'UNSEALED' WHEN o.file_id IS NULL THEN 'MISSING' WHEN o.entries <> f.entries THEN 'COUNT' WHEN o.bytes <> f.bytes THEN 'BYTES' ELSE 'CHECKSUM' END AS fault FROM files o FULL JOIN footers f ON o.file_id = f.file_id WHERE o.entries IS DISTINCT FROM f.entries OR o.bytes IS DISTINCT FROM f.bytes OR o.last_checksum IS DISTINCT FROM f.last_checksum",
    "log_range": "SELECT * FROM (SELECT entry_id, checksum, frame_len, CAST(sum(frame_len) OVER (ORDER BY entry_id) AS BIGINT) AS running_bytes FROM log WHERE entry_id BETWEEN 300 AND 419) r WHERE running_bytes <= 9000",
    "log_points": "SELECT a.entry_id, CASE WHEN r.entry_id IS NOT NULL THEN 'PRESENT' WHEN a.entry_id > (SELECT max(entry_id) FROM retained) THEN 'AHEAD' WHEN a.entry_id < (SELECT min(entry_id) FROM retained) THEN 'COLLECTED' ELSE 'MISSING' END AS outcome, r.checksum FROM asked a LEFT JOIN retained r ON a.entry_id = r.entry_id",
    "log_discovery": "SELECT file_id, first_entry_id, last_entry_id, CASE WHEN e IS NULL THEN 'FIRST' WHEN first_entry_id <= e THEN 'FORK' WHEN first_entry_id > e + 1 THEN 'GAP' WHEN previous_checksum <> c THEN 'CHAIN' ELSE 'LINKED' END AS link FROM (SELECT *, max(last_entry_id) OVER (ORDER BY first_entry_id, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, lag(last_checksum) OVER (ORDER BY first_entry_id, file_id) AS c FROM shifted) s",
    "log_collection": f"SELECT file_id, collect FROM ({_COLLECT.format(850)}) c",
    "log_collection_report": f"SELECT CAST(coalesce(sum(bytes) FILTER (collect), 0) AS BIGINT) AS deleted_bytes, count(*) FILTER (collect) AS deleted_files, CAST(coalesce(sum(bytes) FILTER (NOT collect), 0) AS BIGINT) AS retained_bytes, count(*) FILTER (NOT collect) AS retained_files, min(first_entry_id) FILTER (NOT collect) AS earliest_entry_id, coalesce(bool_or(NOT collect AND sealed AND NOT pinned AND last_entry_id <= 920), false) AS needs_snapshot, coalesce(sum(bytes) FILTER (NOT collect), 0) > 10000 AS pressure FROM ({_COLLECT.format(350)}) c",
    "batch_grouping": _BATCHES.format("damaged"),
    "chain_verify": f"SELECT entry_id FROM ({_BROKEN.format('damaged')}) b WHERE fault = 'CHAIN'",
    "standby_receive": "SELECT i.entry_id, CASE WHEN i.entry_id <= 500 THEN CASE WHEN s.checksum = i.checksum THEN 'DUPLICATE' ELSE 'DIVERGED' END WHEN i.entry_id > 777 OR (SELECT checksum FROM standby WHERE entry_id = 500) <> (SELECT previous_checksum FROM incoming WHERE entry_id = 501) THEN 'GAP' ELSE 'ACCEPTED' END AS outcome FROM incoming i LEFT JOIN standby s ON i.entry_id = s.entry_id",
    "committed_view": "SELECT stream, count(*) AS visible, max(entry_id) AS last_entry_id FROM (SELECT *, max(entry_id) OVER (PARTITION BY stream, sequence - batch_index) AS e FROM log) w WHERE e <= 800 GROUP BY stream",
    "replica_diff": "SELECT l.entry_id, CASE WHEN s.entry_id IS NULL THEN 'MISSING' ELSE 'DIVERGED' END AS fault FROM log l LEFT JOIN standby s ON l.entry_id = s.entry_id WHERE l.entry_id <= (SELECT max(entry_id) FROM standby) AND s.checksum IS DISTINCT FROM l.checksum",
    "catch_up": "SELECT entry_id, checksum FROM (SELECT entry_id, checksum, sum(frame_len) OVER (ORDER BY entry_id) AS b FROM log WHERE entry_id BETWEEN 501 AND 700) r WHERE b <= 12000",
    "terms": "SELECT arrival, term, CASE WHEN m IS NULL OR term > m THEN 'NEWER' WHEN term < m THEN 'STALE' ELSE 'SAME' END AS verdict FROM (SELECT *, max(term) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM messages) t",
    "replica_plan": f"SELECT name, plan, CASE plan WHEN 'INCREMENTAL' THEN coalesce(local_durable + 1, 0) WHEN 'SNAPSHOT' THEN snapshot + 1 END AS start_entry FROM ({_PLAN}) p",
    "rejoin_decision": "SELECT name, CASE WHEN local_durable <= shared THEN 'INCREMENTAL' WHEN committed <= shared THEN 'SNAPSHOT' ELSE 'FAIL' END AS decision FROM status",
    "lag": "SELECT name, CASE WHEN replicated < local_durable THEN local_durable - replicated ELSE 0 END AS replication_lag, CASE WHEN applied < committed THEN committed - applied ELSE 0 END AS apply_lag FROM status",
    "acknowledged": "SELECT arrival, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN least(p, s) END AS committed FROM (SELECT arrival, max(entry_id) FILTER (node = 'primary') OVER (ORDER BY arrival) AS p, max(entry_id) FILTER (node = 'standby') OVER (ORDER BY arrival) AS s FROM acks) a",
    "promotion_faults": f"SELECT stream, first_sequence, fault FROM (SELECT b.stream, b.first_sequence, CASE WHEN NOT complete THEN 'PARTIAL' WHEN b.first_sequence <> coalesce(c.next_sequence, 0) AND NOT EXISTS (SELECT 1 FROM bs o WHERE o.stream = b.stream AND o.first_sequence + o.batch_count = b.first_sequence) THEN 'GAP' END AS fault FROM bs b LEFT JOIN catalog c ON b.stream = c.stream) f WHERE fault IS NOT NULL",
    "promoted": "SELECT name, term + 1 AS term, local_durable, local_durable AS replicated, local_durable AS committed, local_durable AS applied FROM status",
    "recovery_task": f"SELECT name, action, sha256(name || '|' || term || '|' || coalesce(CAST(local_durable AS VARCHAR), '-') || '|' || coalesce(CAST(snapshot AS VARCHAR), '-') || '|' || action) AS task_id FROM (SELECT *, CASE WHEN plan = 'INCREMENTAL' THEN 'COPY' WHEN snapshot + 1 >= earliest THEN 'INSTALL' ELSE 'CREATE_AND_INSTALL' END AS action FROM ({_PLAN}) p) a",
    "replication_state_faults": "SELECT name, 'applied_after_committed' AS rule FROM status WHERE applied > committed UNION ALL SELECT name, 'committed_after_durable' FROM status WHERE committed > local_durable UNION ALL SELECT name, 'committed_after_replicated' FROM status WHERE role = 'PRIMARY' AND committed > replicated UNION ALL SELECT name, 'replicated_after_durable' FROM status WHERE replicated > local_durable UNION ALL SELECT name, 'snapshot_covers_collected' FROM status WHERE earliest <> 0 AND (snapshot IS NULL OR snapshot + 1 < earliest) UNION ALL SELECT name, 'standby_has_no_replica' FROM status WHERE role = 'STANDBY' AND replicated IS NOT NULL UNION ALL SELECT name, 'term_is_set' FROM status WHERE term < 1",
    "replication_state_chain": "SELECT s.generation, CASE WHEN p.generation IS NULL THEN 'MISSING' WHEN p.digest <> s.previous_digest THEN 'DIGEST' ELSE 'FELL' END AS fault FROM states s LEFT JOIN states p ON p.generation = s.generation - 1 WHERE s.generation > 1 AND (p.generation IS NULL OR p.digest <> s.previous_digest OR s.committed < p.committed OR s.applied < p.applied OR s.term < p.term OR s.earliest < p.earliest)",
    "index_faults": """SELECT segment_id, stream, sequence, fault FROM (SELECT i.*, x.first_sequence, x.next_sequence, x.next_byte_offset - x.first_byte_offset AS whole, lag(i.sequence) OVER w AS ps, lag(i.relative_offset + i.frame_len) OVER w AS po, lag(i.time_delta) OVER w AS pt FROM "index" i JOIN extents x ON i.segment_id = x.segment_id AND i.stream = x.stream WINDOW w AS (PARTITION BY i.segment_id, i.stream ORDER BY i.sequence)) q
        CROSS JOIN LATERAL (SELECT unnest([CASE WHEN CASE WHEN ps = sequence - 1 THEN po <> relative_offset ELSE sequence <> first_sequence END THEN 'OFFSET' END, CASE WHEN time_delta < CASE WHEN ps = sequence - 1 THEN pt ELSE 0 END THEN 'TIME' END, CASE WHEN sequence = first_sequence AND relative_offset <> 0 THEN 'START' END, CASE WHEN sequence = next_sequence - 1 AND relative_offset + frame_len <> whole THEN 'END' END]) AS fault) f WHERE fault IS NOT NULL""",
    "layout_faults": "SELECT segment_id, fault FROM (SELECT t.*, x.n, x.b, x.a, x.z FROM totals t LEFT JOIN (SELECT segment_id, sum(record_count) AS n, sum(next_byte_offset - first_byte_offset) AS b, min(first_entry_id) AS a, max(last_entry_id) AS z FROM extents GROUP BY segment_id) x ON t.segment_id = x.segment_id) q CROSS JOIN LATERAL (SELECT unnest([CASE WHEN n IS NULL THEN 'NO_EXTENTS' END, CASE WHEN n <> record_count THEN 'RECORDS' END, CASE WHEN b <> data_bytes THEN 'BYTES' END, CASE WHEN a <> first_entry_id THEN 'FIRST' END, CASE WHEN z <> last_entry_id THEN 'LAST' END]) AS fault) f WHERE fault IS NOT NULL",
    "page_faults": f"""SELECT DISTINCT stream, page, fault FROM (SELECT stream, page, CASE WHEN first_sequence > p THEN 'GAP' WHEN first_sequence < p THEN 'OVERLAP' END AS fault FROM (SELECT *, lag(next_sequence) OVER (PARTITION BY stream, page ORDER BY first_sequence, segment_id) AS p FROM ({_PAGES}) a) b
        UNION ALL SELECT coalesce(o.stream, h.stream), coalesce(o.page, h.page), CASE WHEN h.page IS NULL THEN 'MISSING' WHEN o.page IS NULL THEN 'EXTRA' WHEN o.a <> h.first_sequence OR o.z <> h.next_sequence OR o.n <> h.extents THEN 'HEADER' END FROM (SELECT stream, page, min(first_sequence) AS a, max(next_sequence) AS z, count(*) AS n FROM ({_PAGES}) a GROUP BY stream, page) o FULL JOIN headers h ON o.stream = h.stream AND o.page = h.page) u WHERE fault IS NOT NULL""",
    "manifest_faults": 'SELECT \'header\' AS subject, \'RECORDS\' AS fault UNION ALL SELECT CAST(segment_id AS VARCHAR), \'ORDER\' FROM (SELECT *, lag(last_entry_id) OVER (ORDER BY position) AS p FROM "references") r WHERE first_entry_id <= p UNION ALL SELECT type, \'DUPLICATE\' FROM artifacts GROUP BY type HAVING count(*) > 1 UNION ALL SELECT type, \'BEYOND\' FROM artifacts WHERE covers_entry_id > (SELECT max(last_entry_id) FROM files)',
    "diagnostics_status": "SELECT name, CASE WHEN recovering THEN 'RECOVERING' WHEN fatal THEN 'FATAL' WHEN draining THEN 'DRAINING' WHEN critical THEN 'CAPACITY' WHEN guarded THEN 'NOT_LEADER' ELSE 'READY' END AS state, NOT (recovering OR fatal OR draining OR critical OR guarded) AS ready FROM status",
    "standby_diagnostics": "SELECT name, term, CASE WHEN recovering THEN 'RECOVERING' WHEN fatal THEN 'FATAL' ELSE 'STANDBY' END AS state, false AS ready, local_durable, committed, applied, CASE WHEN applied < committed THEN committed - applied ELSE 0 END AS apply_lag FROM status",
    "principals": "SELECT entry_id, tenant <> '' AND service <> 'a/b' AS valid, CASE WHEN tenant <> '' AND service <> 'a/b' THEN concat_ws('/', tenant, service, instance) END AS producer FROM people",
    "certificates": "SELECT c.certificate, CASE WHEN count(DISTINCT n.principal) = 1 THEN min(n.principal) END AS principal, CASE count(DISTINCT n.principal) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS outcome FROM certificates c LEFT JOIN names n ON c.uri = n.uri GROUP BY c.certificate",
    "authz_prefix": "SELECT w.entry_id, EXISTS (SELECT 1 FROM rules r WHERE r.tenant = w.tenant AND r.service = w.service AND r.namespace = w.namespace AND r.operation = w.operation AND starts_with(w.stream, r.prefix) AND (r.instance IS NULL OR r.instance = w.instance)) AS allowed FROM wishes w",
    "admission_order": "SELECT entry_id, CASE WHEN draining THEN 'REPLICA_UNAVAILABLE' WHEN stream = '' OR request_id = '' THEN 'INVALID_ARGUMENT' WHEN durability = 'STRICT' THEN 'DURABILITY_UNAVAILABLE' WHEN NOT allowed THEN 'PERMISSION_DENIED' WHEN record_count < 1 THEN 'INVALID_ARGUMENT' WHEN record_count > 1024 THEN 'RESOURCE_EXHAUSTED' WHEN largest_record > 16777216 THEN 'RECORD_TOO_LARGE' WHEN bytes > 67108864 THEN 'RESOURCE_EXHAUSTED' ELSE 'OK' END AS outcome FROM requests",
    "registry_apply": f"SELECT namespace, stream, stream_id, created_entry_id FROM known UNION ALL SELECT namespace, stream, stream_id, min(created_entry_id) FROM facts f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.namespace = f.namespace AND k.stream = f.stream) AND NOT EXISTS (SELECT 1 FROM ({_CONFLICTS}) c WHERE c.stream = f.stream AND c.stream_id = f.stream_id) GROUP BY namespace, stream, stream_id",
    "registry_conflicts": _CONFLICTS,
    "registry_overlay": "SELECT namespace, stream, stream_id, CASE WHEN stream_id <= 3 THEN 0 ELSE created_entry_id END AS created_entry_id FROM registry",
    "registry_assign": "SELECT b.namespace, b.stream, coalesce(k.stream_id, (SELECT max(stream_id) FROM known) + row_number() OVER (PARTITION BY k.stream_id IS NULL ORDER BY b.arrival, b.namespace, b.stream)) AS stream_id, k.stream_id IS NULL AS new FROM (SELECT namespace, stream, min(arrival) AS arrival FROM births GROUP BY namespace, stream) b LEFT JOIN known k ON b.namespace = k.namespace AND b.stream = k.stream",
    "registry_rebuild": "SELECT sequence, CASE WHEN sequence > 0 AND coalesce(p, -1) <> sequence - 1 THEN 'GAP' ELSE 'ID' END AS fault FROM (SELECT *, lag(sequence) OVER (ORDER BY sequence) AS p FROM assignments) a WHERE (sequence > 0 AND coalesce(p, -1) <> sequence - 1) OR stream_id <> sequence + 1",
    "layered_tails": "SELECT coalesce(a.stream, c.stream) AS stream, coalesce(a.next_sequence, c.next_sequence) AS next_sequence, CASE WHEN a.stream IS NULL THEN 'catalog' ELSE 'active' END AS source FROM catalog c FULL JOIN active a ON a.stream = c.stream",
    "storage_by_kind": "SELECT CASE WHEN kind IN ('odd', 'strange') THEN 'other' ELSE kind END AS kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM stored GROUP BY 1",
    "capacity": "SELECT tick, used, coalesce(max(tick) FILTER (used >= 0.9) OVER w, -1) > coalesce(max(tick) FILTER (used <= 0.5) OVER w, -1) AS critical FROM samples WINDOW w AS (ORDER BY tick)",
    "maintenance_due": "SELECT name, CASE WHEN pending_bytes = 0 THEN NULL WHEN entered_high THEN 'CAPACITY' WHEN pending_bytes >= 16500 THEN 'BYTES' WHEN log_bytes >= 30000 THEN 'LOG' WHEN age_us >= 1500000 THEN 'AGE' END AS reason, NOT critical AS writes FROM pending",
    "segment_retire": "SELECT o.path, CASE WHEN l.path IS NOT NULL THEN 'LIVE' WHEN o.dropped_generation > (SELECT min(generation) FROM pins) THEN 'PINNED' ELSE 'TRASH' END AS fate FROM old_files o LEFT JOIN live_files l ON o.path = l.path",
    "snapshot_retention": "SELECT snapshot_id, CASE WHEN verified AND r = 1 THEN 'ANCHOR' WHEN verified AND r <= 3 THEN 'KEPT' WHEN NOT verified AND covers_entry_id > (SELECT max(covers_entry_id) FROM snapshots WHERE verified) THEN 'PENDING' ELSE 'EXPIRED' END AS fate FROM (SELECT *, row_number() OVER (PARTITION BY verified ORDER BY covers_entry_id DESC, snapshot_id DESC) AS r FROM snapshots) s",
    "snapshot_verify": "SELECT coalesce(m.path, l.path) AS path, CASE WHEN l.path IS NULL THEN 'MISSING' WHEN m.path IS NULL THEN 'EXTRA' WHEN m.bytes <> l.bytes THEN 'SIZE' ELSE 'DIGEST' END AS fault FROM wanted m FULL JOIN present l ON m.path = l.path WHERE m.bytes IS DISTINCT FROM l.bytes OR m.digest IS DISTINCT FROM l.digest",
    "snapshot_find": "SELECT snapshot_id, covers_entry_id, CAST(row_number() OVER (ORDER BY covers_entry_id DESC, snapshot_id DESC) AS INT) AS rank FROM snapshots WHERE verified AND covers_entry_id >= 399",
    "call_metrics": "SELECT method, code, count(*) AS requests, CAST(sum(took_us) AS BIGINT) AS total_us, " + ", ".join(f"count(*) FILTER (took_us <= {b}) AS le_{b}" for b in upkeep.BUCKETS_US) + " FROM calls GROUP BY method, code",
    "commit_stats": "SELECT count(*) AS groups, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, max(requests) AS largest_group, CAST(sum(wait_us) AS BIGINT) AS wait_us, max(wait_us) AS longest_wait_us, CAST(sum(requests) AS DOUBLE) / count(*) AS mean_group FROM groups",
    "group_commit": "SELECT arrival, stream, bytes, (n - 1) // 64 AS count_group, (b - bytes) // 5000 AS bytes_group FROM (SELECT entry_id AS arrival, stream, frame_len AS bytes, row_number() OVER (ORDER BY entry_id) AS n, CAST(sum(frame_len) OVER (ORDER BY entry_id) AS BIGINT) AS b FROM log) g",
    "error_details": "SELECT stream, code, CASE code WHEN 'NOT_A_CODE' THEN NULL ELSE code = 'RESOURCE_EXHAUSTED' END AS retryable, CASE code WHEN 'NOT_A_CODE' THEN NULL ELSE code = 'DATA_LOSS' END AS uncertain FROM codes",
    "relative_paths": "SELECT path, NOT regexp_matches(path, '(^|/)(\\.{0,2})(/|$)') AS ok FROM paths",
    "arithmetic": "SELECT entry_id, CAST(least(CAST(recorded_us AS HUGEINT) * entry_id, 9223372036854775807) AS BIGINT) AS product, (byte_offset + 4095) // 4096 * 4096 AS aligned FROM rec",
    "store_read": "SELECT * FROM (SELECT stream, sequence, entry_id, CAST(sum(frame_len) OVER (ORDER BY sequence) AS BIGINT) AS running_bytes FROM rec WHERE stream = 'click' AND sequence BETWEEN 5 AND 104) r WHERE running_bytes <= 1000",
    "store_extents": "SELECT stream, min(sequence) AS first_sequence, max(sequence) + 1 AS next_sequence, count(*) AS record_count FROM rec GROUP BY stream",
    "store_verify": "SELECT CAST(entry_id AS VARCHAR) AS path, producer AS fault FROM rec WHERE false",
    "scrub_all": """SELECT stream, sequence, fault FROM (SELECT *, lag(sequence) OVER w AS ps, lag(byte_offset + frame_len) OVER w AS po, lag(recorded_us) OVER w AS pt FROM faulty WINDOW w AS (PARTITION BY stream ORDER BY sequence)) q
        CROSS JOIN LATERAL (SELECT unnest([CASE WHEN (ps IS NULL AND sequence <> 0) OR ps <> sequence - 1 THEN 'GAP' END, CASE WHEN ps = sequence - 1 AND po <> byte_offset THEN 'OFFSET' END, CASE WHEN ps = sequence - 1 AND recorded_us < pt THEN 'TIME' END]) AS fault) f WHERE fault IS NOT NULL
        UNION ALL SELECT stream, first_sequence, 'EXTENT' FROM (SELECT *, coalesce(lag(next_sequence) OVER w, 0) AS s, coalesce(lag(next_byte_offset) OVER w, 0) AS b FROM tiles WINDOW w AS (PARTITION BY stream ORDER BY first_sequence)) e WHERE s <> first_sequence OR b <> first_byte_offset""",
    "read_answers": """SELECT request, outcome, current_next_sequence, required_bytes, records, next_sequence FROM (SELECT q.request, q.from_sequence, t.n AS current_next_sequence,
        CASE WHEN q.max_records < 1 OR q.max_bytes < 1 OR q.from_sequence < 0 THEN 'INVALID_ARGUMENT' WHEN t.n IS NULL THEN 'STREAM_NOT_FOUND' WHEN q.from_sequence > t.n THEN 'SEQUENCE_AHEAD' WHEN f.frame_len > q.max_bytes THEN 'RECORD_TOO_LARGE' ELSE 'OK' END AS outcome,
        CASE WHEN q.max_records >= 1 AND f.frame_len > q.max_bytes THEN f.frame_len END AS required_bytes, coalesce(a.n, 0) AS records, CASE WHEN q.max_records >= 1 AND t.n IS NOT NULL AND q.from_sequence <= t.n AND coalesce(f.frame_len, 0) <= q.max_bytes THEN q.from_sequence + coalesce(a.n, 0) END AS next_sequence
        FROM reading q LEFT JOIN tl t ON q.stream = t.stream LEFT JOIN rec f ON q.stream = f.stream AND q.from_sequence = f.sequence
        LEFT JOIN (SELECT request, count(*) AS n FROM (SELECT q.request, q.max_bytes, sum(r.frame_len) OVER (PARTITION BY q.request ORDER BY r.sequence) AS b FROM reading q JOIN rec r ON q.stream = r.stream AND r.sequence >= q.from_sequence AND r.sequence < q.from_sequence + q.max_records) w WHERE b <= max_bytes GROUP BY request) a ON q.request = a.request) z""",
}


def _query(name: str):
    return lambda spark, d: BODIES[name](Tables(spark, d))


def _oracle(name: str, rec: str) -> str:
    sql, need = SQL[name], []
    extra = {"bs": _BATCHES.format("suffix")}

    def add(text: str) -> None:
        for v in [*INPUTS, *extra]:
            if re.search(rf'(FROM|JOIN) "?{v}\b', text) and v not in need:
                add((INPUTS | extra)[v])
                need.append(v)

    add(sql)
    return rec + LOG + "".join(f', "{v}" AS ({(INPUTS | extra)[v]})' for v in need) + "\n" + sql


QUERIES = {name: _query(name) for name in BODIES}


def oracle_sql(rec: str) -> dict[str, str]:
    return {name: _oracle(name, rec) for name in SQL}

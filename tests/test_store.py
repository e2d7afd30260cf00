"""Stored records: appends, generations, reads, compaction, snapshots; and operators without SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reclog import config, tool
from reclog.functions import kernels
from reclog.operators import access, log, reads, recovery
from reclog.sources.store import RecordStore, StoreError

SCHEMA = "stream string, sequence long, entry_id long, byte_offset long, frame_len long, recorded_us long, payload string"


def rows(first, n):
    return [(s, i // 2, i, 10 * (i // 2), 10, i, f"p{i}") for i in range(first, first + n) for s in ["ab"[i % 2]]]


@pytest.fixture
def store(spark, tmp_path):
    s = RecordStore(spark, f"file://{tmp_path}/store")
    for k in range(4):
        s.append(spark.createDataFrame(rows(20 * k, 20), SCHEMA), f"batch{k}")
    return s


def test_append_read_and_compact(spark, store):
    before = sorted(map(tuple, store.scan().collect()))
    assert len(before) == 80 and store.append(spark.createDataFrame(rows(60, 20), SCHEMA), "batch3")["generation"] == 4
    with pytest.raises(StoreError):
        store.append(spark.createDataFrame(rows(70, 20), SCHEMA), "late")
    assert [r.sequence for r in store.read("a", 8, 5, 35).orderBy("sequence").collect()] == [8, 9, 10]
    assert store.read("none", 0, 5, 100).count() == 0
    new = store.compact(3)
    assert len(new["segments"]) == 2 and new["generation"] == 5 and sorted(map(tuple, store.scan().collect())) == before
    assert sorted(map(tuple, store.scan(4).collect())) == before and store.verify_chain() == 5
    assert len(store.vacuum([4])) == 1  # what the refused append wrote
    assert len(store.vacuum()) == 3 and sorted(map(tuple, store.scan().collect())) == before
    assert store.verify().count() == 0 and store.verify(4).groupBy("fault").count().collect()[0]["count"] == 3


def test_of_two_publishers_one_wins(store):
    now = store.manifest()
    store.publish(now, now["segments"], now["last_entry_id"], "one")
    with pytest.raises(StoreError):
        store.publish(now, now["segments"], now["last_entry_id"], "two")
    assert store.manifest()["batches"][-1] == "one"


def test_a_gap_stops_compaction(spark, store):
    store.append(spark.createDataFrame([("a", 41, 80, 410, 10, 80, "x")], SCHEMA), "gap")
    with pytest.raises(StoreError):
        store.compact()
    assert store.manifest()["generation"] == 5


def test_snapshot(spark, store, tmp_path):
    copy = store.snapshot(f"file://{tmp_path}/copy")
    assert sorted(map(tuple, copy.scan().collect())) == sorted(map(tuple, store.scan().collect())) and copy.verify().count() == 0
    with pytest.raises(StoreError):
        store.snapshot(f"file://{tmp_path}/copy")
    (tmp_path / "store" / "extents").rename(tmp_path / "store" / "gone")
    assert store.extents().count() == 8


def test_crc32c(spark):
    data = [b"123456789", b"", None, b"a" * 1000, bytes(range(256)), b"x"]
    got = [r.c for r in spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").coalesce(1).select("i", kernels.crc32c(F.col("d")).alias("c")).orderBy("i").collect()]
    assert got == [None if d is None else kernels.crc32c_bytes(d) for d in data] and got[0] == 0xE3069283


def test_kernels(spark):
    r = spark.range(1).select(kernels.le64(F.lit(258)).alias("le"), kernels.from_nanos(F.lit(1_700_000_000_123_456_789)).cast("string").alias("t"), kernels.saturating_multiply(F.lit(1 << 40), F.lit(1 << 40)).alias("m"), kernels.aligned(F.lit((1 << 63) - 5), 4096).alias("none")).first()
    assert bytes(r.le) == (258).to_bytes(8, "little") and r.t.endswith(".123456") and r.m == (1 << 63) - 1 and r.none is None


def test_rate_limit(spark):
    random.seed(5)
    asked = [(f"k{random.randrange(3)}", i, i * 1000 + random.randrange(900), float(random.randrange(1, 9))) for i in range(400)]
    buckets, want = {}, {}
    for k, i, t, c in asked:
        tokens, last = buckets.get(k, (20.0, t))
        tokens = min(20.0, tokens + (t - last) * 900 / 1e6)
        want[i] = c <= tokens
        buckets[k] = (tokens - c if want[i] else tokens, t)
    df = spark.createDataFrame(asked, "key string, arrival long, time_us long, cost double").repartition(4)
    assert {r.arrival: r.admitted for r in access.rate_limited(df, 900, 20).collect()} == want and 0 < sum(want.values()) < 400


def test_install_and_tool(spark, store, tmp_path):
    copy, fresh, other = (f"file://{tmp_path}/{n}" for n in ("copy", "fresh", "other"))
    assert tool.run(spark, ["snapshot", store.root, copy]) == (0, {"last_entry_id": 79}) and tool.run(spark, ["verify-snapshot", copy])[0] == 0
    assert tool.run(spark, ["install-snapshot", fresh, copy]) == (0, {"generation": 1}) and RecordStore(spark, fresh).scan().count() == 80
    assert tool.run(spark, ["scrub", fresh])[0] == 0 and tool.run(spark, ["resume-install", fresh]) == (0, {"generation": 1})
    store.append(spark.createDataFrame(rows(80, 4), SCHEMA), "more")
    with pytest.raises(StoreError):
        store.install(copy)  # it would take back what is committed
    late = RecordStore(spark, other)
    late._create("install", json.dumps({"source": copy, "after": 0, "segments": RecordStore(spark, copy).manifest()["segments"], "last_entry_id": 79}))
    assert late.resume_install()["record_count"] == 80 and late.identity("one") == late.identity() == "one"
    with pytest.raises(StoreError):
        late.identity("two")


def test_scrub_finds_faults(spark):
    good = rows(0, 40)
    bad = [(s, q, e, o + (1 if e == 13 else 0), n, t - (30 if e == 21 else 0), p) for s, q, e, o, n, t, p in good if e != 30] + [good[5]]
    df = spark.createDataFrame(bad, SCHEMA)
    found = {tuple(r) for r in recovery.scrub(df, reads.extents(df.withColumn("segment_id", F.expr("entry_id div 20")))).collect()}
    assert found == {("a", 16, "GAP"), ("b", 6, "OFFSET"), ("b", 7, "OFFSET"), ("b", 10, "TIME"), ("b", 2, "TWICE")}


def test_recovery(spark):
    df = spark.createDataFrame([(*r, f"r{r[2]}") for r in rows(0, 60)], SCHEMA + ", request_id string")
    ext = reads.extents(df.where("entry_id < 24").withColumn("segment_id", F.lit(0)))
    full = log.entries(df)
    got = {r.stream: (r.next_sequence, r.next_byte_offset, r.replayed) for r in recovery.recovered(ext, full, 23).collect()}
    assert got == {"a": (30, 300, 18), "b": (30, 300, 18)}
    for part in (full.where("entry_id <> 40"), full.where("entry_id > 25"), full.where("entry_id <= 30"), full.withColumn("previous_checksum", F.col("previous_checksum") + (F.col("entry_id") == 44).cast("int"))):
        with pytest.raises(recovery.RecoveryError):
            recovery.recovered(ext, part, 23)


def test_config():
    assert config.parsed('{"root": "r", "batch_records": 5}').batch_records == 5
    for text in ("[]", '{"root": ""}', '{"root": "r", "other": 1}', '{"root": "r", "root": "s"}', '{"root": "r", "batch_records": 0}', '{"root": "r", "node": "' + "x" * (4 << 20) + '"}'):
        with pytest.raises(ValueError):
            config.parsed(text)

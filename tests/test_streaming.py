"""Streams of appends into a store, and subscriptions that follow it, against a sequential model."""

import random

import pytest

from reclog.sources.store import RecordStore
from reclog.streaming.ingest import ingest
from reclog.streaming.subscribe import Cursor, StreamNotFoundError

SCHEMA = "arrival long, stream string, expected_sequence long, request_id string, request_hash string, record_count long, frame_len long, wall_us long"


def test_ingest_and_follow(spark, tmp_path):
    random.seed(2)
    tails, seen, want, rows = {}, {}, [], []
    for i in range(120):
        s = random.choice("abc")
        at, n = tails.get(s, 0), random.randrange(1, 4)
        ask = at if random.random() < 0.7 else max(0, at + random.randrange(-2, 3))
        key = f"r{i}"
        if (s, ask) in seen and random.random() < 0.5:
            key, n = seen[s, ask]  # the same request again
        rows.append((i, s, ask, key, f"h{key}", n, 10 + i % 7, 1000 + i * 5 - i % 4 * 9))
        if ask == at:
            seen[s, at], tails[s] = (key, n), at + n
            want += [(s, at + k, key) for k in range(n)]
    store = RecordStore(spark, f"file://{tmp_path}/store")
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = ingest(store, live, str(tmp_path / "check"))  # started again each time
        query.processAllAvailable()
        query.stop()
    found = store.scan().collect()
    assert sorted((r.stream, r.sequence, r.request_id) for r in found) == sorted(want)
    assert len({r.entry_id for r in found}) == len(found)
    by_id = sorted(found, key=lambda r: r.entry_id)
    assert all(a.recorded_us <= b.recorded_us for a, b in zip(by_id, by_id[1:]))
    for s in "abc":
        own = sorted((r for r in found if r.stream == s), key=lambda r: r.sequence)
        assert all(a.byte_offset + a.frame_len == b.byte_offset for a, b in zip(own, own[1:])) and own[0].byte_offset == 0

    cursor, got = Cursor(store, "a", 3, max_records=20, max_bytes=150), []

    def take(df):
        part = [r.sequence for r in df.collect()]
        assert 0 < len(part) <= 20
        got.extend(part)

    def fail(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        cursor.step(fail)
    assert cursor.sequence == 3
    while cursor.step(take):
        pass
    assert got == list(range(3, tails["a"])) and cursor.step(take) == 0
    cursor.drain()
    with pytest.raises(ValueError):
        cursor.step(take)
    with pytest.raises(ValueError):
        Cursor(store, "a", 0, max_bytes=5).step(take)
    with pytest.raises(StreamNotFoundError):
        Cursor(store, "nowhere")

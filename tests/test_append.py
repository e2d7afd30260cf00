"""Compare-and-append against a sequential model, and manifest generations."""

import json
import os
import random

import pytest

from reclog.operators import append
from reclog.operators.manifest import Manifest, ManifestError

SCHEMA = "arrival long, stream string, expected_sequence long, request_id string, request_hash string, record_count long"


def model(rows):
    """One request after the other, with ids as they are given out."""
    tails, stored, out, last = {}, {}, [], -1
    for arrival, stream, want, rid, digest, n in sorted(rows):
        if stream not in tails:
            tails[stream] = 0
            last += 1
        at = tails[stream]
        if want > at:
            out.append((arrival, "SEQUENCE_AHEAD", None, None))
        elif want < at:
            same = stored.get((stream, want)) == (rid, digest, n)
            out.append((arrival, "OK" if same else "SEQUENCE_CONFLICT", want if same else None, None))
        else:
            stored[stream, at] = (rid, digest, n)
            tails[stream] += n
            out.append((arrival, "OK", at, last + 1))
            last += n
    return out


def test_matches_sequential_model(spark):
    random.seed(11)
    rows = []
    for i in range(400):
        rows.append((i, random.choice("abcd"), random.randrange(0, 12), f"r{random.randrange(6)}", f"h{random.randrange(2)}", random.randrange(1, 3)))
    got = append.entry_ids(append.decide(spark.createDataFrame(rows, SCHEMA))).orderBy("arrival").collect()
    assert [(r.arrival, r.outcome, r.first_sequence, r.first_entry_id) for r in got] == model(rows)


def test_against_stored_tails(spark):
    tails = spark.createDataFrame([("a", 3)], "stream string, next_sequence long")
    stored = spark.createDataFrame([("a", 0, "r1", "h1", 3)], "stream string, first_sequence long, request_id string, request_hash string, record_count long")
    rows = [(0, "a", 0, "r1", "h1", 3), (1, "a", 0, "r1", "h2", 3), (2, "a", 3, "r2", "h", 1), (3, "b", 2, "r", "h", 1), (4, "a", 9, "", "h", 1)]
    got = append.decide(spark.createDataFrame(rows, SCHEMA), tails, stored).orderBy("arrival").collect()
    assert [(r.outcome, r.deduplicated, r.registers) for r in got] == [("OK", True, False), ("SEQUENCE_CONFLICT", False, False), ("OK", False, False), ("SEQUENCE_AHEAD", False, True), ("INVALID_ARGUMENT", False, False)]


def test_manifest(tmp_path):
    m = Manifest(str(tmp_path))
    assert m.current() is None
    m.publish([{"id": "s1", "record_count": 2}], 1, "b1")
    m.publish([{"id": "s1", "record_count": 2}], 1, "b1")
    assert m.publish([{"id": "s2", "record_count": 3}], 4, "b2")["generation"] == 2 and m.verify_chain() == 2
    with pytest.raises(ManifestError):
        m.publish([], 3)
    first = tmp_path / f"manifest-{1:020d}.json"
    first.write_text(json.dumps(json.loads(first.read_text()) | {"record_count": 9}))
    with pytest.raises(ManifestError):
        m.verify_chain()
    os.remove(tmp_path / "CURRENT")
    with pytest.raises(ManifestError):
        m.current()


def test_subscription(spark, tmp_path):
    from reclog.streaming.subscribe import StreamNotFoundError, subscribe

    path = str(tmp_path / "records")
    spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "stream string, sequence long").write.parquet(path)
    with pytest.raises(StreamNotFoundError):
        subscribe(spark, path, "c", 0)
    q = subscribe(spark, path, "a", 1).writeStream.format("memory").queryName("sub").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 2)], "stream string, sequence long").write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.sequence for r in spark.table("sub").collect()) == [1, 2]


def test_chunks_of_arrivals_match_the_sequential_model(spark):
    random.seed(12)
    rows, tails = [], dict.fromkeys("abcd", 0)
    for i in range(900):
        stream, n = random.choice("abcd"), random.randrange(1, 3)
        at = tails[stream]
        want = random.choice((at, at, at - 1, at - 2, at + 1, at + 3, 5))
        tails[stream] += n if want == at else 0
        rows.append((3 * i, stream, want, f"r{random.randrange(2)}", "h", n))
    rows += [(2703, "a", (1 << 63) - 1, "r", "h", 2), (2706, "e", 5, "r", "h", 1), (2709, "e", 0, "r", "h", 1)]
    random.shuffle(rows)
    got = append.entry_ids(append.decide(spark.createDataFrame(rows, SCHEMA), chunk=50)).orderBy("arrival").collect()
    assert [(r.arrival, r.outcome, r.first_sequence, r.first_entry_id) for r in got] == model(rows)
    assert len({r.outcome for r in got}) == 3 and sum(r.deduplicated for r in got) > 30 and max(r.next_sequence for r in got) > 60 and [r.arrival for r in got if r.registers and r.stream == "e"] == [2706]


def test_a_worker_holds_one_chunk_of_a_stream(spark, monkeypatch):
    monkeypatch.setattr(append, "_exits", _bounded(append._exits))
    monkeypatch.setattr(append, "_walk", _bounded(append._walk))
    rows = spark.range(4000).selectExpr("id AS arrival", "'a' AS stream", "id AS expected_sequence", "concat('r', id) AS request_id", "'h' AS request_hash", "1L AS record_count")
    got = append.decide(rows, chunk=100).agg({"next_sequence": "max", "arrival": "count"}).first()
    assert tuple(got) in {(4000, 4000)}


def _bounded(work):
    def small(rows):
        assert rows.num_rows <= 100
        return work(rows)

    return small


def test_invalid_requests_and_missing_streams_by_chunks(spark):
    tails = spark.createDataFrame([("a", 3), ("z", 9)], "stream string, next_sequence long")
    stored = spark.createDataFrame([("a", 0, "r1", None, 3)], "stream string, first_sequence long, request_id string, request_hash string, record_count long")
    rows = [(0, None, 0, "r", "h", 1), (1, "b", 0, None, "h", 1), (2, "b", 0, "r", "h", 0), (3, "b", 0, "r", "h", None), (4, "b", 1, "r", "h", 1), (5, "b", 0, "r", "h", 2), (6, "a", 0, "r1", None, 3), (7, "a", -1, "r", "h", 1), (8, "a", 3, "q", "h", 2), (9, "", 0, "r", "h", 1), (10, "a", 3, "q", "h", 2), (11, "b", None, "r", "h", 1)]
    got = append.decide(spark.createDataFrame(rows, SCHEMA), tails, stored, chunk=2).orderBy("arrival").collect()
    bad = "INVALID_ARGUMENT"
    assert [(r.outcome, r.next_sequence, r.deduplicated, r.registers) for r in got] == [
        (bad, 0, False, False), (bad, 0, False, False), (bad, 0, False, False), (bad, 0, False, False), ("SEQUENCE_AHEAD", 0, False, True), ("OK", 2, False, False),
        ("OK", 3, True, False), ("SEQUENCE_CONFLICT", 3, False, False), ("OK", 5, False, False), (bad, 0, False, False), ("OK", 5, True, False), (bad, 2, False, False),
    ]

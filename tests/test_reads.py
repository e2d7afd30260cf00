"""Lookups in time and gaps over whole streams, against plain Python."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from reclog.operators import ordered, reads, recovery
from reclog.plans import catalogue

RECORDS = "stream string, sequence long, recorded_us long"


def test_resolve_by_chunks_of_time(spark):
    random.seed(6)
    rows, t = [], 0
    for i in range(300):
        t += random.choice((0, 1, 40))
        rows.append(("ab"[i % 2], i // 2, t))
    targets = [(s, x) for s in "abc" for x in range(-3, t + 9, 7)] + [("a", None), ("a", rows[8][2])]
    for mode, pick in (("AT_OR_AFTER", min), ("AT_OR_BEFORE", max)):
        fits = (lambda r, x: r >= x) if pick is min else (lambda r, x: r <= x)
        want = {(s, x): pick([(q, r) for z, q, r in rows if z == s and x is not None and fits(r, x)], default=(None, None)) for s, x in targets}
        got = reads.resolve(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(targets, "stream string, target_us long"), mode, chunk_us=100).collect()
        assert len(got) == len(want) and {(r.stream, r.target_us): (r.sequence, r.recorded_us) for r in got} == want
        assert all(r.found == (r.sequence is not None) for r in got)


def test_resolve_asks_over_whole_streams(spark):
    found = catalogue.QUERIES["resolve_at_or_after"](spark, "/root/testdata/sf0.1")
    assert found.agg({"sequence": "max"}).first()[0] > 19000


@pytest.mark.parametrize("mode", ["AT_OR_AFTER", "AT_OR_BEFORE"])
def test_resolve_differs_from_its_sql_by_the_cut_only(spark, mode):
    sf, name = "/root/testdata/sf0.1", f"resolve_{mode.lower()}"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    ours = {tuple(r) for r in catalogue.QUERIES[name](spark, sf).collect()}
    asked = set(duck.execute(catalogue.REC + catalogue.TARGETS).fetchall())
    assert {r for r in ours if r[:2] in asked} == set(duck.execute(catalogue.ORACLE_SQL[name]).fetchall())
    assert ours == set(duck.execute(catalogue.REC + catalogue._resolve_sql(mode, catalogue.WHOLE)).fetchall())


def test_gaps_at_borders_of_chunks(spark):
    held = {"a": set(range(60)) - {9, 20, *range(30, 40), 55}, "b": set(range(3, 25)) - {10}}
    rows = spark.createDataFrame([(s, q) for s, x in held.items() for q in x], "stream string, sequence long")
    want = {(s, q) for s, x in held.items() for q in x if q - 1 not in x and q != min(x)}
    assert {tuple(r) for r in reads.gaps(rows, chunk=10).collect()} == want


def test_scrub_reports_a_gap_at_a_hundred_thousand(spark, monkeypatch):
    few = spark.range(99990, 100010).where("id <> 100000").selectExpr("'a' AS stream", "id AS sequence", "0L AS entry_id")
    monkeypatch.setattr(catalogue, "records", lambda s, d: few)
    assert [tuple(r) for r in catalogue.QUERIES["scrub_sequence"](spark, "").collect()] == [("a", 100001)]


def test_scrub_by_chunks_and_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 100)
    rows = spark.range(1200).selectExpr("if(id < 700, 'a', 'b') AS stream", "id % 700 AS sequence", "id AS entry_id", "10 * (id % 700) + if(id % 99 = 7, 1, 0) AS byte_offset", "10L AS frame_len", "id - if(id % 83 = 9, 50, 0) AS recorded_us")
    rows = rows.unionByName(rows.where("entry_id % 211 = 3")).where("entry_id % 71 <> 4 AND NOT sequence BETWEEN 120 AND 160").persist()
    tiles = reads.extents(rows.withColumn("namespace", F.lit("n")).withColumn("segment_id", F.expr("entry_id div 7"))).persist()
    fine, one = recovery.scrub(rows, tiles, chunk=20), recovery.scrub(rows, tiles, chunk=1 << 20)
    assert sorted(map(tuple, fine.collect())) == sorted(map(tuple, one.collect()))
    assert {r.fault for r in one.collect()} == {"GAP", "OFFSET", "TIME", "TWICE", "EXTENT"}
    plan = fine._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(stream#\d+, sequence#\d+L, {rows.count() // 100 + 1}\), REPARTITION_BY_NUM", plan)) >= 2
    held = {(r.stream, r.sequence) for r in rows.collect()}
    assert {(r.stream, r.sequence) for r in one.where("fault = 'GAP'").collect()} == {(s, q) for s, q in held if q and (s, q - 1) not in held}

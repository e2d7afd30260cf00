"""Compaction choice and merge against plain Python."""

import random

from reclog.operators import maintain
from reclog.plans import catalogue


def chosen(rows, most, size):
    rows = sorted(rows, key=lambda r: r[1:3])
    for start in range(len(rows)):
        taken, total = [], 0
        for r in rows[start:]:
            if len(taken) == most or (taken and r[1] != taken[-1][2] + 1) or total + r[3] > size:
                break
            taken.append(r)
            total += r[3]
        if len(taken) >= 2:
            return {r[0] for r in taken}
    return set()


def test_compaction_inputs(spark):
    random.seed(8)
    for _ in range(4):
        rows, at = [], 0
        for k in range(20):
            at += random.choice((0, 0, 5))
            rows.append((k, at, at + 9, random.randrange(1, 9)))
            at += 10
        found = maintain.compaction_inputs(spark.createDataFrame(rows, "segment_id long, first_entry_id long, last_entry_id long, bytes long"), 3, 10)
        assert {r.segment_id for r in found.collect()} == chosen(rows, 3, 10)


def test_merge_takes_what_the_choice_takes(spark):
    d = "/root/testdata/sf0.01"
    got = catalogue.QUERIES["compaction_merge"](spark, d).collect()
    assert all(r.continuous and r.n == r.next_sequence - r.first_sequence for r in got)
    assert sum(r.n for r in got) == catalogue.records(spark, d).where("segment_id < 8").count() > 2000
    rec = catalogue.records(spark, d)
    torn = maintain.merged(rec.where("segment_id <> 1"), rec.select("segment_id").where("segment_id < 3").distinct())
    assert {r.continuous for r in torn.collect()} == {False}

"""Every query with SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from reclog.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(found, names):
    key = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(key(r[n]) for n in names) for r in found), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, DATA)
    theirs = duck.sql(catalogue.ORACLE_SQL[name]).df().astype(object)
    theirs = theirs.where(theirs.notna(), None).to_dict("records")
    names = sorted(ours.columns)
    assert names == sorted(theirs[0]) if theirs else True
    assert rows([r.asDict() for r in ours.collect()], names) == rows(theirs, names)

"""Every registered query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from shelfmark.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
    assert got == want

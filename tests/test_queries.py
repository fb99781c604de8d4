"""Every registered query of the marker, window, join, load, outlier, log and source operators against its SQL."""

import duckdb
import pytest

from tests.conftest import SF, SMALL
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows(found):
    return sorted([tuple(map(plain, r)) for r in found], key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = rows(tuple(r[c] for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert registry.QUERIES[name](spark, SF).count() > 0
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == rows(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())

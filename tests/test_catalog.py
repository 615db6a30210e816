"""Every catalogued query against its SQL."""

import duckdb
import pytest

from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(0.0 if v == 0 and isinstance(v, float) else v for v in r)) for r in got.select(*cols).collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()
    assert rows == sorted(repr(tuple(0.0 if v == 0 and isinstance(v, float) else v for v in r)) for r in want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

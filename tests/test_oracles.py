"""Every query that has SQL against DuckDB, at the smallest size."""

import duckdb
import pytest

from linkweave.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or x != x else round(float(x), 5) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in row) for row in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=str)
    assert len(got) == len(want)
    assert got == want


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())

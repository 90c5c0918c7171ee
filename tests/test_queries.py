"""Every query of the library itself against its SQL in DuckDB."""

import decimal
import os

import duckdb
import pytest

from sparkloom import plans
from sparkloom.sources.tables import NAMES
from tests.conftest import DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        return [plain(x) for x in v] if isinstance(v, list) else v

    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    found = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    """These are held against plain Python in test_library."""
    assert plans.QUERIES[name](spark, DATA).count() > 0

"""Every catalogue query with a SQL twin must give the same rows in DuckDB."""

import os

import duckdb
import pytest

from tidemark.plans.catalog import CATALOG
from tidemark.sources.tables import SCHEMAS

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", [n for n, s in CATALOG.items() if s.sql])
def test_matches_sql(name, spark, duck):
    spec = CATALOG[name]
    columns = [c for c, _ in spec.columns]
    got = canonical(spec.run(spark, FOLDER).select(columns).collect())
    want = canonical(duck.execute(f"SELECT {', '.join(columns)} FROM ({spec.oracle()}) AS x").fetchall())
    assert got == want
    assert want, "an empty result proves nothing"


@pytest.mark.parametrize("name", [n for n, s in CATALOG.items() if not s.sql])
def test_runs_without_sql(name, spark):
    assert CATALOG[name].run(spark, FOLDER).count() > 0

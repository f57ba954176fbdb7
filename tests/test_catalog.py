"""Every query against its SQL in DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from oddsmill.operators import strength
from oddsmill.plans.catalog import ORACLE_SQL, QUERIES
from oddsmill.sources.testdata import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module", autouse=True)
def all_passes():
    """The SQL makes all ten passes of the fixpoint; with the few teams of this scale the plan would stop before."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(strength, "TOLERANCE", -1.0)
        yield


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 5) + 0.0)
    return str(v)[:10] if type(v).__name__ in ("date", "datetime") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, con, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark, con):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"market", "probability"} <= set(__spark_entry__.entry(spark).columns)

"""Every registered query against its DuckDB oracle SQL (sf0.001), the way
the driver compares: row count, column names, order-free value hash."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, digest
from tests.conftest import SF_SMALL

from bootlens.plans import registry  # noqa: E402

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows, "a query without SQL must give rows"
        return
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    h1, c1, _ = digest(df.columns, rows)
    h2, c2, _ = digest(cols, res.fetchall())
    assert c1 == c2
    assert h1 == h2


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["bmc_id", "phase", "n_closed", "n_open", "total_sec", "avg_sec"]

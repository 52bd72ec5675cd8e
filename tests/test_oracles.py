"""A sample of the registered queries against their DuckDB oracles at sf0.001
(the full sweep is tools/oracle_check.py at sf0.01)."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as E
from codeaudit.sources.tables import TABLES
from tools.oracle_check import rows_of

SAMPLE = ["secret_findings", "source_risk", "risk_grade", "vuln_join", "license_findings", "readiness_score",
          "surface_headers", "manifest_packages", "tree_scan", "spdx_packages"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())

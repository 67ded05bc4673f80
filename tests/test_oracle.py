"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    if name not in entry.oracle_sql():
        pytest.skip("no SQL: compared with plain Python elsewhere")
    text, _, good = compare(spark, con, name, SF)
    assert good, text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

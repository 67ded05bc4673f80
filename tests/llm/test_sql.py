"""Queries with SQL give the SQL's rows."""

from pathlib import Path

import duckdb
import pytest

from wakeline.llm import bindings

SF = "/root/testdata/sf0.01"
#: What rows are sorted by before they are compared.
KEYS = ("doc_id", "conv_id", "page_id", "query_id", "rank", "part", "filter_order", "step")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the bundled tables")


@pytest.mark.parametrize("name", bindings.SQL)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.execute(bindings.SQL[name]).df()
    got = bindings.QUERIES[name](spark, SF).toPandas()[list(expected.columns)]
    key = [c for c in expected.columns if c in KEYS] or list(expected.columns[:1])
    expected, got = (d.sort_values(key, ignore_index=True).astype(object).where(d.sort_values(key, ignore_index=True).notna(), None)
                     for d in (expected, got))
    assert (expected == got).where(expected.notna(), got.isna()).all().all()

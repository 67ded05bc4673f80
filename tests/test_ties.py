"""Lines of one price in an order: the SQL leaves their places open; here they go by course or by lane."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

import __spark_entry__ as entry
from bindings import history, tables
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
#: What decides in the queries that read courses, and in the others.
DECIDES = {
    "l_shipdate": ["labels", "encode_interactions", "history_features", "history_features_strict", "feature_set_select"],
    "l_linenumber": ["prior_counts", "prior_counts_chunked", "prior_counts_strict", "global_prior", "shrunk_rate"],
}
NAMES = [name for names in DECIDES.values() for name in names]
FINISH = "ORDER BY l_extendedprice DESC"


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The given tables; in every order the price of each odd place is that of the place before."""
    folder = tmp_path_factory.mktemp("tied")
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    places = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC)"
    # lines of one number or one date would leave lanes and courses open too
    duckdb.execute(f"""COPY (
      SELECT * EXCLUDE (p, n, d) REPLACE (CASE WHEN n = 1 AND d = 1 THEN max(l_extendedprice) OVER (PARTITION BY l_orderkey, p // 2, n = 1 AND d = 1)
                                         ELSE l_extendedprice END AS l_extendedprice)
      FROM (SELECT *, {places} - 1 AS p, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n,
              count(*) OVER (PARTITION BY l_orderkey, l_shipdate) AS d FROM '{SF}/lineitem.parquet')
    ) TO '{folder}/lineitem.parquet'""")
    return str(folder)


@pytest.fixture(scope="module")
def con(tied):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tied}/{t}.parquet'")
    return con


@pytest.mark.parametrize("column, name", [(c, n) for c, names in DECIDES.items() for n in names])
def test_tied_prices_have_one_order(spark, con, tied, monkeypatch, column, name):
    ties = con.execute("SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_extendedprice HAVING count(*) > 1)")
    assert ties.fetchone()[0] > 500
    sql = entry.oracle_sql()[name]
    assert FINISH in sql
    # the SQL with its open place closed; queries share a session, so written members must not matter
    tables.members(spark, tied)
    monkeypatch.setattr(entry, "oracle_sql", lambda: {name: sql.replace(FINISH, f"{FINISH}, {column}")})
    text, _, good = compare(spark, con, name, tied)
    assert good, text


def test_histories_are_made_from_few_columns(spark, monkeypatch):
    monkeypatch.setattr(tables, "_STAGED", {})
    for name in NAMES:
        history.QUERIES[name](spark, SF)
    assert {label for _, _, label in tables._STAGED} == {"results_lane_rank", "results_course_rank"}
    assert len(tables.results(spark, SF, tables.BY_COURSE).columns) == 10


def test_attributes_need_kept_keys_only(spark):
    with pytest.raises(ValueError, match="score"):
        tables.attributes("age", "score")


def test_half_way_rates_are_rounded_as_in_sql(spark, monkeypatch):
    values = [0.21333749999999999, 0.2133375, 0.2133374, 1.0, 0.0, None]
    rows = spark.createDataFrame([(i, i, i, v, v) for i, v in enumerate(values)],
                                 "race_no INT, lane INT, racer_win_n INT, racer_win_rate DOUBLE, racer_win_raw DOUBLE")
    monkeypatch.setattr(history, "results_prepared", lambda *_: rows)
    monkeypatch.setattr(history, "shrunk_rates", lambda df, *_, **__: df)
    got = [r["racer_win_rate"] for r in history.shrunk_rate(spark, SF).orderBy("race_no").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert got[0] == 0.213338

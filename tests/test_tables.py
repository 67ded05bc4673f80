"""Build of the tables behind the queries."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bindings import history, joins, tables
from wakeline.operators.quality import assert_rows
from wakeline.session import INITIAL_PARTITIONS, shuffle_partitions

SF = "/root/testdata/sf0.001"
QUERIES = {**history.QUERIES, **joins.QUERIES}


def test_lines_are_shuffled_by_order_only(spark):
    plan = tables.build_members(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    outer = next(line for line in plan.splitlines() if "Join" in line)
    assert "l_orderkey" in outer and "c_custkey" not in outer


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    before = spark.conf.get(INITIAL_PARTITIONS, None)
    monkeypatch.setattr(tables, "LINES_A_PARTITION", 100)
    try:
        tables.sized(spark, SF)
        assert shuffle_partitions(spark) == 60
    finally:
        spark.conf.unset(INITIAL_PARTITIONS) if before is None else spark.conf.set(INITIAL_PARTITIONS, before)


def test_rows_that_break_a_rule_stop_the_job(rows):
    df = rows("k int, n int", (1, 1), (2, 2))
    assert assert_rows(df, F.col("n") < 3, ["k"], "n of").count() == 2
    for bad in (F.col("n") < 2, F.lit(None).cast("boolean")):
        with pytest.raises(PySparkException, match='n of .*"k":'):
            assert_rows(df, bad, ["k"], "n of").select(F.lit(1)).collect()


def test_keys_of_prices_are_checked_without_a_shuffle(spark):
    for build in (tables.build_payouts, tables.build_odds):
        plan = build(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["labels", "event_ts_default", "encode_interactions", "constraint_report"])
def test_queries_that_read_members_once_do_not_write_them(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "_STAGED", {})
    passing = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    assert not tables._STAGED
    tables.members(spark, SF)
    assert passing == sorted(map(tuple, QUERIES[name](spark, SF).collect()))

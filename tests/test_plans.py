"""Physical plans: what is pushed down, what is never shuffled to one task."""

import re

import pytest

from bindings import history, pricing, scoring, tables
from wakeline.operators.groups import complete_groups
from wakeline.operators.pricing import load_dividends

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    """Plans as they are when no side is small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(load_dividends(tables.payouts(spark, SF), before="1998-01-01"))
    assert "PushedFilters: [IsNotNull(bet_type)" in text and "EqualTo(bet_type,trifecta)" in text
    assert "LessThan(race_date," in text
    narrow = plan(tables.members(spark, SF).groupBy("racer_id").count())
    assert "ReadSchema: struct<racer_id:bigint>" in narrow


@pytest.mark.parametrize("name", ["history_features", "history_features_strict", "prior_counts",
                                  "prior_counts_chunked"])
def test_no_fact_table_meets_in_one_task(spark, name):
    lines = plan(history.QUERIES[name](spark, SF)).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            # only totals per calendar day, never rows
            assert any(re.search(r"HashAggregate\(keys=\[(_cut0|true)#\d+, _chunk0_race_date", x) for x in lines[i + 1 : i + 4])


def test_families_of_one_key_share_a_shuffle(spark):
    """Eleven rates: shuffles by racer, by motor, by venue, and the two of the global prefix."""
    text = plan(history.QUERIES["history_features"](spark, SF))
    rows = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(rows) <= 7


def test_ticket_explosion_needs_no_further_shuffle(spark, shuffled_joins):
    """Groups are placed once before they explode; then only the price side moves."""
    scored, exploded = scoring.scored(spark, SF), scoring.tickets(spark, SF)
    priced = pricing._priced(spark, SF)
    assert plan(exploded).count("Exchange") == plan(scored).count("Exchange") + 1
    assert plan(priced).count("Exchange") == plan(exploded).count("Exchange") + 1
    assert "BroadcastHashJoin" not in plan(priced)


def test_windows_after_completeness_reuse_the_partitioning(spark, shuffled_joins):
    complete = complete_groups(history.prepared(spark, SF))
    assert plan(scoring.scored(spark, SF)).count("Exchange") == plan(complete).count("Exchange")


def test_rollup_has_no_cross_join(spark):
    text = plan(pricing.QUERIES["threshold_rollup"](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

"""Steps that grew faster than the input, or read and moved rows more often than needed."""

import re

import pytest
from pyspark.sql import functions as F

from bindings import joins, modelling, pricing, scoring, tables
from wakeline.operators import pricing as operators
from wakeline.operators import rules
from wakeline.operators.groups import complete_groups
from wakeline.schema import RACE_KEYS

SF = "/root/testdata/sf0.001"
QUERIES = {**joins.QUERIES, **modelling.QUERIES, **pricing.QUERIES, **scoring.QUERIES}
KEYS = "race_date DATE, stadium_id INT, race_no BIGINT"


def lines(df, optimized=False):
    execution = df._jdf.queryExecution()
    return (execution.optimizedPlan() if optimized else execution.executedPlan()).toString().splitlines()


@pytest.mark.parametrize("name", ["validations", "odds_price_join", "roi_alert", "yearly_rollup", "max_drawdown",
                                  "reliability_table", "latest_price", "threshold_rollup", "gbt_invariants"])
def test_wide_members_are_not_written_for_a_few_columns(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "_STAGED", {})
    monkeypatch.setattr(modelling, "_PREDICTED", {})
    QUERIES[name](spark, SF)
    assert not {"members", "odds"} & {label for _, _, label in tables._STAGED}


def test_prices_are_not_shuffled_ticket_by_ticket(spark):
    """A task that reads narrow prices holds very many of them in its shuffle; groups are 120 times fewer."""
    plan = lines(pricing._priced(spark, SF))
    assert not any("combination:" in line for line in plan if "FileScan" in line)
    for i, line in enumerate(plan):
        if "Exchange" in line:
            assert not any("Generate" in below for below in plan[i + 1:i + 3])


def test_completeness_reads_rows_once_and_few_of_a_large_group(spark, rows):
    data = [(None, 1, 1, i == 0) for i in range(6)] + [(None, 2, 2, False)] * 6 + [(None, 3, 3, i == 0) for i in range(90)]
    df = rows("race_date STRING, stadium_id INT, race_no BIGINT, won BOOLEAN", *data)
    df = df.select(F.lit("2000-01-01").cast("date").alias("race_date"), "stadium_id", "race_no", F.col("won").cast("long").alias("won"))
    kept = complete_groups(df)
    assert {(r["race_no"], r["won"]) for r in kept.collect()} == {(1, 0), (1, 1)} and kept.columns == df.columns
    assert sum("LogicalRDD" in line or "LocalRelation" in line for line in lines(kept, optimized=True)) == 1
    assert any("WindowGroupLimit" in line and "7" in line for line in lines(kept))


def test_only_bought_tickets_reach_the_curves(spark):
    text = "\n".join(lines(operators.threshold_rollup(pricing.settled(spark, SF))))
    assert re.search(r"Filter \(\(_place#\d+ = 1\) OR", text)


def test_drawdown_folds_tickets_where_they_lie(spark, rows):
    df = rows(f"{KEYS}, combination STRING, pnl DOUBLE").repartition(4, *RACE_KEYS)
    plan = lines(operators.max_drawdown(df, [], "pnl"))
    moved = [i for i, line in enumerate(plan) if "Exchange" in line]
    # the exchange by block stands above the totals per group
    below = plan[moved[-2] + 1:moved[-1]]
    assert any("Aggregate" in line and "race_no" in line for line in below)


def test_validations_read_members_once(spark, rows):
    day = "race_date DATE, stadium_id INT"
    races = rows(f"{day}, race_no BIGINT, has_k BOOLEAN", *[(None, 1, 1, True), (None, None, 2, True), (None, 1, 3, False)])
    races = races.withColumn("race_date", F.lit("2000-01-01").cast("date"))
    entries = rows(f"{day}, race_no BIGINT, lane INT, course INT, finish_position INT",
                   *[(None, 1, 1, i, None if i == 6 else 7 - i, i) for i in range(1, 7)], *[(None, None, 2, i, i, i) for i in range(1, 7)])
    entries = entries.withColumn("race_date", F.lit("2000-01-01").cast("date"))
    payouts = rows(f"{day}, race_no BIGINT, bet_type STRING", (None, 1, 1, "trifecta"), (None, None, 2, "trifecta"), (None, 1, 1, "win"))
    payouts = payouts.withColumn("race_date", F.lit("2000-01-01").cast("date"))
    table = rules.validations(races, entries, payouts)
    found = {r["check"]: (r["metric"], r["hard"], r["passed"]) for r in table.collect()}
    # a key that holds a NULL meets nothing, on either side
    assert found == {
        "races": (3, False, True), "entries": (12, False, True), "groups not of six": (2, True, False),
        "no course": (1, False, True), "course is not lane": (5, False, True),
        "results without trifecta": (1, True, False), "venues": (2, False, True), "payout types": (2, False, True),
        "summary years": (1, False, True), "course 1 years": (1, False, True)}
    assert sum("finish_position#" in line for line in lines(table, optimized=True) if "LogicalRDD" in line or "LocalRelation" in line) == 1

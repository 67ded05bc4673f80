"""A day scored from kept sums equals the build over all history."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators.history import DEPLOYABLE_RATES, shrunk_rates
from wakeline.operators.history_state import HistoryState
from wakeline.operators.quality import history_differences
from wakeline.functions.encode import with_labels
from wakeline.plans import features

from members import DDL, DEFAULTS

START = date(2024, 1, 1)
RATE_COLUMNS = [f"{r.name}_{s}" for r in DEPLOYABLE_RATES for s in ("n", "rate", "raw")]


@pytest.fixture(scope="module")
def prepared(spark):
    rng = random.Random(2)
    rows = []
    for d in range(8):
        for race in range(1, 4):
            for lane, racer in enumerate(rng.sample(range(14), 6), 1):
                rows.append({**DEFAULTS, "race_date": START + timedelta(days=d), "race_no": race, "lane": lane, "course": rng.choice([None, lane]),
                             "racer_id": racer, "motor_no": rng.choice([None, racer]), "finish_position": rng.randint(1, 6),
                             "deadline_time": f"{9 + race}:00:00", "start_timing": rng.choice([None, 0.125])})
    return features.prepare(spark.createDataFrame([tuple(r.values()) for r in rows], DDL))


def rates_of(df):
    return sorted((r["race_no"], r["lane"], *[None if r[c] is None else round(float(r[c]), 9) for c in RATE_COLUMNS]) for r in df.collect())


def full(prepared, day):
    return shrunk_rates(prepared.filter(F.col("race_date") <= F.lit(day)), DEPLOYABLE_RATES).filter(F.col("race_date") == F.lit(day))


def test_state_equals_the_full_build(spark, prepared, tmp_path):
    day = lambda n: START + timedelta(days=n)
    card = lambda n: prepared.filter(F.col("race_date") == F.lit(day(n)))
    state = HistoryState(spark, str(tmp_path / "state"), DEPLOYABLE_RATES)
    # nothing is kept yet
    assert rates_of(state.rates_for(card(0), day(0))) == rates_of(full(prepared, day(0)))
    state.create(prepared, day(3))
    assert rates_of(state.rates_for(card(4), day(4))) == rates_of(full(prepared, day(4)))
    for n in (4, 5, 5, 6):  # a repeated day replaces itself
        state.advance(prepared, day(n))
    for n in (7, 5):  # the state can be read as of an earlier day
        assert rates_of(state.rates_for(card(n), day(n))) == rates_of(full(prepared, day(n)))
    state.compact(day(5))
    assert [p.rsplit("/", 1)[-1] for p in state._parts(day(7))] == [f"through={day(5)}", f"day={day(6)}"]
    assert rates_of(state.rates_for(card(7), day(7))) == rates_of(full(prepared, day(7)))


def test_unfinished_folders_are_not_there(spark, prepared, tmp_path):
    state = HistoryState(spark, str(tmp_path / "state"), DEPLOYABLE_RATES)
    state.create(prepared, START)
    state.advance(prepared, START + timedelta(days=1))
    (tmp_path / "state" / "delta" / f"day={START + timedelta(days=1)}" / "_SUCCESS").unlink()
    assert len(state._parts(START + timedelta(days=3))) == 1


def test_a_day_reads_no_history(spark, prepared, tmp_path):
    state = HistoryState(spark, str(tmp_path / "state"), DEPLOYABLE_RATES)
    state.create(prepared, START)
    day = START + timedelta(days=1)
    card = spark.createDataFrame(prepared.filter(F.col("race_date") == F.lit(day)).collect(), prepared.schema)
    plan = state.rates_for(card, day)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
    assert scans and all("state" in line for line in scans)


def test_differences_find_a_planted_leak(prepared):
    outcome = {"finish_position": F.lit(1), "start_timing": F.lit(0.99), "course": F.col("lane")}
    cut = START + timedelta(days=7)
    check = lambda build: history_differences(build, prepared, DEPLOYABLE_RATES, "race_date", cut, outcome, with_labels).first()
    strict = check(lambda df, rates: shrunk_rates(df, rates, mode="strict"))
    assert strict["rows_compared"] == 7 * 18 and strict["rows_changed"] == 0

    def leaky(df, rates):
        """Each rate is the mean over all rows."""
        means = df.agg(*[F.avg(r.value).alias(f"{r.name}_rate") for r in rates]).first().asDict()
        return df.withColumns({c: F.lit(v) for c, v in means.items()})

    assert check(leaky)["rows_changed"] == 7 * 18

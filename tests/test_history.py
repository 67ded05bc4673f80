"""History features: hand-computed values and leak proofs."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from members import DEFAULTS, day, frame, six_boats
from wakeline.operators.history import DEPLOYABLE_RATES, REALISED_RATES
from wakeline.operators.quality import assert_point_in_time, point_in_time_violations
from wakeline.plans import features
from wakeline.schema import MEMBER_KEYS, feature_columns


def by_day(df, column):
    return [r[column] for r in df.orderBy("race_date", "race_no", "lane").collect()]


@pytest.mark.parametrize("mode", ["rows", "strict"])
def test_prior_rate_of_one_racer(spark, mode):
    places = [1, 1, 1, 6, 6, 6]
    built = features.build(
        frame(spark, [{"race_date": day(i), "finish_position": p} for i, p in enumerate(places)]),
        mode=mode,
    )
    assert by_day(built, "racer_win_n") == [0, 1, 2, 3, 4, 5]
    assert by_day(built, "racer_win_raw") == [None, 1.0, 1.0, 1.0, 0.75, 0.6]
    assert by_day(built, "racer_win_rate")[0] is None


def test_shrunk_rate_lies_between_field_and_racer(spark):
    built = features.build(frame(spark, six_boats(40)))
    rates = [r["racer_win_rate"] for r in built.filter("lane = 1").orderBy("race_date").collect()]
    assert rates[0] is None and all(1 / 6 < r < 1 for r in rates[2:])
    assert all(a < b for a, b in zip(rates[2:], rates[3:]))


def test_order_inside_a_day_is_by_deadline(spark):
    rows = [{"race_no": n, "deadline_time": t}
            for n, t in ((1, "11:00:00"), (2, "15:00:00"), (3, "13:00:00"))]
    built = features.build(frame(spark, rows)).collect()
    assert {r["race_no"]: r["racer_win_n"] for r in built} == {1: 0, 3: 1, 2: 2}


@pytest.mark.parametrize("missing", [None, "25:99:00", ""])
def test_missing_deadline_counts_as_noon(spark, missing):
    rows = [{"race_no": 1, "deadline_time": missing}, {"race_no": 2, "deadline_time": "10:00:00"}]
    built = features.build(frame(spark, rows)).collect()
    assert {r["race_no"]: r["racer_win_n"] for r in built} == {1: 1, 2: 0}


def test_null_timing_counts_nowhere(spark):
    rows = [{"race_date": day(i), "start_timing": t} for i, t in enumerate((0.20, None, 0.20))]
    built = features.build(frame(spark, rows))
    assert by_day(built, "racer_st_n") == [0, 1, 1]
    assert by_day(built, "racer_st_raw") == [None, 0.20, 0.20]


def test_motor_history_is_per_venue(spark):
    rows = [{"race_date": day(i), "stadium_id": s} for i, s in enumerate((1, 2, 2))]
    assert by_day(features.build(frame(spark, rows)), "motor_hist_n") == [0, 0, 1]


def test_labels_and_unknown_categories(spark):
    rows = [{"finish_position": None, "weather": "?", "wind_direction": "?", "grade": None, "course": None}]
    row = features.build(frame(spark, rows)).first()
    assert (row["won"], row["top2"], row["top3"]) == (0, 0, 0)
    assert (row["weather_code"], row["wind_dir_code"], row["grade_code"]) == (None, None, None)
    assert row["goes_inside"] is None and row["stadium_course"] == 10


def test_wind_terms(spark):
    row = features.build(frame(spark, [{"lane": 1, "course": 2, "wind_speed_m": 3}])).first()
    assert (row["wind_x_lane"], row["wind_x_course"], row["head_wind_x_lane1"]) == (3.0, 6.0, 3.0)


def test_members_of_one_group_do_not_see_each_other_when_strict(spark):
    rows = six_boats(2)
    strict = features.build(frame(spark, rows), mode="strict").filter(F.col("race_date") == day(1))
    assert len({round(r["racer_win_rate"] - (r["lane"] == 1) / 31, 9) for r in strict.collect()}) == 1


@pytest.mark.parametrize("mode", ["rows", "strict"])
def test_editing_the_last_day_changes_nothing_before(spark, mode):
    df = frame(spark, six_boats(6))
    outcome = {"finish_position": F.lit(7) - F.col("lane"), "start_timing": F.lit(0.9)}
    assert_point_in_time(lambda d: features.build(d, mode=mode), df, MEMBER_KEYS, "race_date",
                         day(5), outcome)


def test_appending_days_restates_nothing(spark):
    columns = ["race_date", "lane", *[c for c in feature_columns("morning") if c != "lane"]]
    short = features.build(frame(spark, six_boats(4))).select(columns)
    longer = features.build(frame(spark, six_boats(7))).filter(F.col("race_date") < day(4)).select(columns)
    assert short.exceptAll(longer).count() == 0 and longer.exceptAll(short).count() == 0


def test_a_leaking_build_is_caught(spark):
    def leaking(df):
        total = df.agg(F.avg("finish_position").alias("m"), F.lit(1).alias("j"))
        return df.withColumn("j", F.lit(1)).join(total, "j").drop("j")

    row = point_in_time_violations(
        leaking, frame(spark, six_boats(3)), MEMBER_KEYS, "race_date", day(2),
        {"finish_position": F.lit(6)},
    ).first()
    assert (row["rows_compared"], row["rows_changed"]) == (12, 12)


def test_row_count_is_kept_and_sets_nest(spark):
    assert features.build(frame(spark, six_boats(3))).count() == 18
    sizes = [len(feature_columns(s)) for s in ("morning", "prerace", "realised")]
    assert sizes == [27, 36, 41]
    assert set(feature_columns("morning")) < set(feature_columns("prerace")) < set(feature_columns("realised"))
    with pytest.raises(ValueError, match="unknown feature set"):
        feature_columns("evening")
    with pytest.raises(ValueError, match="columns missing"):
        features.select_features(frame(spark, six_boats(1)), "morning")


def test_chunked_history_equals_plain(spark):
    df = frame(spark, six_boats(12))
    plain = features.build(df, mode="rows").drop("race_ts")
    chunked = features.build(df, mode="rows", hot_rows=4).drop("race_ts")
    key = ["race_date", "lane"]
    a, b = (sorted(map(tuple, d.select(*key, "racer_win_n", "stadium_lane_win_n", "motor_hist_n",
            F.round("racer_win_rate", 9), F.round("racer_st_rate", 9)).collect())) for d in (plain, chunked))
    assert a == b


def test_both_feeds_filter_and_date_range(spark):
    entries = frame(spark, six_boats(3)).select("race_date", "stadium_id", "race_no", "lane")
    races = spark.createDataFrame(
        [(day(i), 1, 1, True, i != 1) for i in range(3)],
        "race_date DATE, stadium_id INT, race_no INT, has_b BOOLEAN, has_k BOOLEAN")
    assert features.base_entries(entries, races).count() == 12
    assert features.base_entries(entries, races, require_both_feeds=False).count() == 18
    assert features.base_entries(entries, races, end=str(day(0))).count() == 6
    assert features.base_entries(entries, races, start=str(day(0) + timedelta(days=1))).count() == 6
    assert DEFAULTS["lane"] == 1


def test_venues_share_the_shuffle_of_the_overall_means():
    """A few venues must neither be the shuffle key nor cost a pass over all rows."""
    assert {r.anchor for r in (*DEPLOYABLE_RATES, *REALISED_RATES)} == {(), ("racer_id",), ("stadium_id", "motor_no")}

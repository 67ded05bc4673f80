"""Fitted models: properties, not values."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators import models
from wakeline.operators.groups import group_softmax, sum_to_one
from wakeline.plans import daily, report
from wakeline.plans.backtest import score_split
from wakeline.plans.features import build
from wakeline.session import staged
from wakeline.sources.tables import write_report

from members import DDL, DEFAULTS


@pytest.fixture(scope="module")
def season(spark):
    """Two racers are good; the field is random otherwise. 2015 to early 2024."""
    rng = random.Random(3)
    rows = []
    for d in range(150):
        racers = rng.sample(range(12), 6)
        order = sorted(racers, key=lambda r: rng.random() + (0.0 if r < 2 else 0.6))
        day = date(2015, 1, 1) + timedelta(days=22 * d)
        for lane, racer in enumerate(racers, 1):
            rows.append({**DEFAULTS, "race_date": day, "lane": lane, "course": lane, "racer_id": racer,
                         "motor_no": racer, "finish_position": order.index(racer) + 1,
                         "age": None if racer == 5 else 30})
    return staged(build(spark.createDataFrame([tuple(r.values()) for r in rows], DDL)), "season")


@pytest.fixture(scope="module")
def model(season):
    cut = F.lit("2022-01-01").cast("date")
    small = {"maxIter": 6, "maxDepth": 3, "minInstancesPerNode": 5}
    return models.train_calibrated(season.filter(F.col("race_date") < cut),
                                   season.filter(F.col("race_date") >= cut), params=small)


def test_probabilities_sum_to_one_and_beat_the_constant(model, season):
    scored = model.predict(season)
    check = sum_to_one(scored).first()
    assert (check["min_total"], check["max_total"]) == pytest.approx((1.0, 1.0))
    row = models.evaluate(model, season, optimistic=True).first()
    assert row["optimistic"] and row["brier"] < 5 / 36 and row["roc_auc"] > 0.6
    assert dict(model.importances())["racer_win_rate"] > 0


def test_score_is_the_logit(model, season):
    both = model.pipeline.transform(season).select("probability", "race_date", "lane")
    joined = both.join(model.score(season).select("race_date", "lane", "score"), ["race_date", "lane"])
    for r in joined.limit(20).collect():
        import math

        assert r["probability"][1] == pytest.approx(1 / (1 + math.exp(-r["score"])))


def test_save_and_load(model, season, spark, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = models.TrainedModel.load(spark, str(tmp_path / "m"))
    assert loaded.feature_names == model.feature_names
    assert loaded.calibrator.knots.exceptAll(model.calibrator.knots).count() == 0
    key = ["race_date", "lane", "p_win"]
    assert model.predict(season).select(key).exceptAll(loaded.predict(season).select(key)).count() == 0


def test_calibrator_is_monotone_and_bounded(spark):
    rng = random.Random(7)
    data = []
    for race in range(300):
        scores = [rng.gauss(0, 1) for _ in range(6)]
        weights = [pow(2.718, s) for s in scores]
        winner = rng.choices(range(6), weights)[0]
        data += [(date(2024, 1, 1), 1, race, i, 1.8 * s, int(i == winner)) for i, s in enumerate(scores)]
    df = group_softmax(spark.createDataFrame(
        data, "race_date DATE, stadium_id INT, race_no INT, lane INT, score DOUBLE, won INT"))
    calibrator = models.fit_calibrator(df)
    knots = calibrator.knots.orderBy("x").collect()
    assert [k["y"] for k in knots] == sorted(k["y"] for k in knots)
    assert 0 <= knots[0]["y"] and knots[-1]["y"] <= 1
    after = calibrator.apply(df)
    gap = lambda d: d.agg(F.avg((F.col("p_win") - F.col("won")) ** 2)).first()[0]
    assert gap(after) <= gap(df) + 1e-9


def test_guards(model, season):
    model.feature_set, kept = "realised", model.feature_set
    with pytest.raises(ValueError, match="published after the card"):
        models.require_deployable(model)
    model.feature_set = kept
    with pytest.raises(ValueError, match="columns that are not there"):
        model.score(season.drop("age"))
    with pytest.raises(RuntimeError, match="final"):
        score_split(model, season, "test")
    assert score_split(model, season).count() % 6 == 0


def test_walk_forward(season):
    out = models.walk_forward(season, 2021, 2022, min_past_rows=100,
                              params={"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 5})
    assert [r["eval_year"] for r in out] == [2021, 2022] and all(0 < r["brier"] < 0.2 for r in out)


def test_daily_run(model, season, spark, tmp_path):
    raw = season.select(*DEFAULTS)
    day = season.agg(F.max("race_date")).first()[0]
    card = raw.filter(F.col("race_date") == day)
    scored = staged(daily.score_day(model, raw, card, day), "scored")
    assert scored.count() == 6 and sum_to_one(scored).first()["max_total"] == pytest.approx(1.0)
    dividends = raw.filter("finish_position = 1").select(
        "race_date", "stadium_id", "race_no", F.lit("1-2-3").alias("combination"),
        F.lit(5000.0).alias("payout_yen"))
    priced = daily.price_day(scored, dividends, day)
    text = report.daily_report(str(day), scored, priced, 0.2, "morning")
    write_report(text, str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[0] == f"# 買い目レポート {day}" and "- 対象レース数: **1**" in lines
    assert sum(line.startswith("| 桐生 | 1 | 1-2-3 |") for line in lines) == int(
        priced.filter("ev >= 0.2").count())
    assert sum(line.startswith("- **桐生 1R**: 1号艇") for line in lines) == 1
    none = report.daily_report(str(day), scored, priced, 99.0, "morning").collect()
    assert any(r["text"] == "## 買い目なし" for r in none)

"""Group probabilities, triples, calibration, metrics and splits."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions.numeric import implied_probability, interp, kelly_fraction
from wakeline.operators import metrics, splits
from wakeline.operators.groups import complete_groups, group_softmax, renormalise_group, sum_to_one
from wakeline.operators.triples import race_tickets

DAY = date(2024, 1, 1)
KEYS = "race_date DATE, stadium_id INT, race_no INT, lane INT"


def race(rows, name, *values, race_no=1):
    data = [(DAY, 1, race_no, i, v) for i, v in enumerate(values, 1)]
    return rows(f"{KEYS}, {name} DOUBLE", *data)


def p_of(df):
    return [r["p_win"] for r in df.orderBy("race_no", "lane").collect()]


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("scores,want", [
    ((2.0,) * 6, [1 / 6] * 6),
    ((float("nan"),) * 6, [1 / 6] * 6),
    ((None,) * 6, [1 / 6] * 6),
    ((1.0, float("-inf"), 1.0), [0.5, 0.0, 0.5]),
    ((1000.0, 1000.0, float("nan")), [0.5, 0.5, 0.0]),
])
def test_softmax(rows, scores, want, bounded):
    assert p_of(group_softmax(race(rows, "score", *scores), bounded=bounded)) == pytest.approx(want)


def test_softmax_is_shift_invariant_and_sums_to_one(rows):
    a = race(rows, "score", 0.3, -1.0, 2.0, 0.0, 1.1, -2.0)
    shifted = a.withColumn("score", F.col("score") + 1000)
    assert p_of(group_softmax(a)) == pytest.approx(p_of(group_softmax(shifted)))
    check = sum_to_one(group_softmax(a)).first()
    assert (check["min_total"], check["max_total"]) == pytest.approx((1.0, 1.0))


def test_renormalise_keeps_order_and_falls_back(rows):
    assert p_of(renormalise_group(race(rows, "p_win", 0.2, 0.1, 0.1))) == pytest.approx([0.5, 0.25, 0.25])
    assert p_of(renormalise_group(race(rows, "p_win", 0.0, 0.0))) == pytest.approx([1 / 6] * 2)


def test_uniform_group_gives_equal_triples(rows):
    got = race_tickets(race(rows, "p_win", *[1 / 6] * 6)).collect()
    assert len({r["combination"] for r in got}) == 120
    assert [r["p_model"] for r in got] == pytest.approx([1 / 120] * 120)


def test_triples_have_the_right_marginals(rows):
    p = np.array([0.4, 0.25, 0.15, 0.1, 0.06, 0.04])
    got = race_tickets(race(rows, "p_win", *p.tolist())).collect()
    first = [sum(r["p_model"] for r in got if r["combination"][0] == str(i)) for i in range(1, 7)]
    assert first == pytest.approx(p.tolist())
    one = {r["combination"]: r["p_model"] for r in got}["3-1-2"]
    assert one == pytest.approx(0.15 * 0.4 / 0.85 * 0.25 / 0.45)


def test_certain_winner_has_no_negative_triples(rows):
    got = race_tickets(race(rows, "p_win", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)).collect()
    assert {r["p_model"] for r in got} == {0.0}


def test_malformed_groups(rows):
    assert race_tickets(race(rows, "p_win", *[0.2] * 5)).count() == 0
    seven = race(rows, "p_win", *[1 / 7] * 7)
    assert race_tickets(seven).count() == 0
    twice = race(rows, "p_win", *[1 / 6] * 6).withColumn("lane", F.greatest("lane", F.lit(2)))
    assert race_tickets(twice).count() == 0
    for bad in ((-0.1, 0.3, 0.2, 0.2, 0.2, 0.2), (0.0,) * 6, (None, *[0.2] * 5)):
        with pytest.raises(Exception, match="non-negative"):
            race_tickets(race(rows, "p_win", *bad)).collect()


def test_complete_groups(rows):
    data = []
    for race_no, wins in ((1, [1, 0, 0, 0, 0, 0]), (2, [1, 0, 0, 0, 0]), (3, [0] * 6), (4, [1, 1, 0, 0, 0, 0])):
        data += [(DAY, 1, race_no, i, w) for i, w in enumerate(wins, 1)]
    kept = complete_groups(rows(f"{KEYS}, won INT", *data))
    assert {r["race_no"] for r in kept.collect()} == {1} and kept.count() == 6


@pytest.mark.parametrize("knots", [1, 2, 7, 400])
def test_interp_equals_numpy(rows, knots):
    rng = np.random.default_rng(knots)
    xs, ys = np.sort(rng.random(knots)), np.sort(rng.random(knots))
    points = [*rng.random(50).tolist(), -1.0, 0.0, 1.0, 2.0, float(xs[0]), float(xs[-1])]
    df = rows("i INT, v DOUBLE", *enumerate(points)).select("i", interp(F.col("v"), xs, ys).alias("y"))
    got = [r["y"] for r in df.orderBy("i").collect()]
    assert got == pytest.approx(np.interp(points, xs, ys).tolist())


def test_kelly_and_implied(rows):
    cases = [(0.5, 100.0, 0.0), (0.5, 300.0, 0.02), (0.35, 300.0, 0.00625), (0.1, 200.0, 0.0),
             (None, 300.0, 0.0), (float("nan"), 300.0, 0.0), (0.5, float("nan"), 0.0)]
    df = rows("p DOUBLE, y DOUBLE, want DOUBLE", *cases)
    for r in df.select(kelly_fraction(F.col("p"), F.col("y")).alias("k"), "want").collect():
        assert r["k"] == pytest.approx(r["want"])
    got = rows("o DOUBLE", (7.5,), (0.0,), (None,)).select(implied_probability(F.col("o")).alias("q"))
    assert [r["q"] for r in got.collect()] == [0.1, None, None]


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_auc_and_brier_against_brute_force(rows, hot_rows):
    rng = random.Random(5)
    data = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(400)]
    df = rows("p DOUBLE, y INT", *data)
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "p", "y", hot_rows=hot_rows).first()[0] == pytest.approx(want)
    brier = df.agg(metrics.brier("p", "y")).first()[0]
    assert brier == pytest.approx(sum((p - y) ** 2 for p, y in data) / len(data))


def test_reliability_bins_are_half_open(rows):
    df = rows("p DOUBLE, y INT", (0.1, 1), (0.099, 0), (0.3, 0), (1.0, 1))
    got = {r["bin"]: r["n"] for r in metrics.reliability_table(df, "p", "y").collect()}
    assert got == {"0.0-0.1": 1, "0.1-0.2": 1, "0.3-0.4": 1, "0.9-1.0": 1}


def test_splits(spark, rows):
    df = rows("race_date DATE, x INT", *[(date(y, 6, 1), y) for y in range(2015, 2027)])
    fit, valid = splits.train_valid(df)
    assert fit.count() == 9 and [r["x"] for r in valid.collect()] == [2024]
    with pytest.raises(RuntimeError, match="final"):
        splits.hold_out(df)
    assert splits.hold_out(df, final_evaluation=True).count() == 2
    parts = {r["race_date"]: r["part"] for r in splits.chronological(df).collect()}
    assert [parts[d] for d in sorted(parts)] == ["train"] * 8 + ["valid"] * 2 + ["test"] * 2
    folds = splits.walk_forward_folds(df, 2015, 2019, min_past_rows=3).collect()
    assert {r["eval_year"]: r["skipped"] for r in folds} == {
        2015: "no rows to stop on", 2016: "no rows to fit", 2017: "fewer than 3 past rows", 2018: None, 2019: None}
    late = splits.walk_forward_folds(df, 2028, 2028, min_past_rows=3).first()
    assert late["skipped"] == "no rows to evaluate" and late["train_rows"] == 12

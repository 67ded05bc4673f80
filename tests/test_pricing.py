"""Prices, settlement, roll-ups and drawdown: hand-computed values and brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators import pricing
from wakeline.plans.backtest import backtest, price_tickets

D0 = date(2024, 1, 1)
DIV = "race_date DATE, stadium_id INT, race_no INT, combination STRING, payout_yen DOUBLE"
SETTLED = (
    "race_date DATE, stadium_id INT, race_no INT, combination STRING, p_model DOUBLE, "
    "expected_payout DOUBLE, ev DOUBLE, hit BOOLEAN, payout_yen DOUBLE"
)


def divs(rows, *values, combo="1-2-3"):
    return rows(DIV, *[(D0 + timedelta(days=i), 1, 1, combo, float(v)) for i, v in enumerate(values)])


def expected(df, **kw):
    out = pricing.expected_dividends(df, **kw).orderBy("race_date").collect()
    return [r["expected_payout"] for r in out], [r["expected_payout_n"] for r in out]


@pytest.mark.parametrize("hot_rows", [1_000_000, 7])
def test_last_dividend_is_not_in_its_own_price(rows, hot_rows):
    df = divs(rows, *[1000] * 40, 99_999)
    prices, n = expected(df, hot_rows=hot_rows)
    assert prices[0] is None and prices[-1] == 1000.0 and n == list(range(41))
    assert pricing.price_table(df).first()["expected_payout"] == 1000.0


@pytest.mark.parametrize("sent", [100_000, 0])
def test_every_combination_has_its_price(rows, monkeypatch, sent):
    """Lanes of two digits and other texts are combinations too, whether the table is sent or not."""
    monkeypatch.setattr(pricing, "SENT_PRICES", sent)
    prices = rows("combination STRING, expected_payout DOUBLE", ("10-1-2", 500.0), ("x", 100.0), ("x", 200.0))
    tickets = rows("combination STRING, p_model DOUBLE", ("10-1-2", 0.5), ("x", 0.5), ("1-2-3", 0.5))
    got = {r["combination"]: r["ev"] for r in pricing.attach_expected_payout(tickets, prices).collect()}
    assert got == {"10-1-2": 2.5, "x": 1.0, "1-2-3": None}


def test_rare_combinations_fall_back_to_the_overall_mean(rows):
    prices, _ = expected(divs(rows, 1000, 2000, 3000))
    assert prices == [None, 1000.0, 1500.0]


def test_a_later_dividend_changes_no_earlier_price(rows):
    a, _ = expected(divs(rows, 100, 200, 300, 400))
    b, _ = expected(divs(rows, 100, 200, 300, 9999))
    assert a == b


def test_prior_price_uses_earlier_dates_only(rows):
    dividends = divs(rows, 1000, 2000, 3000)
    tickets = rows("race_date DATE, stadium_id INT, race_no INT, combination STRING, p_model DOUBLE",
                   *[(D0 + timedelta(days=i), 9, 9, c, 0.1) for i in range(5) for c in ("1-2-3", "6-5-4")])
    got = pricing.attach_prior_payout(tickets, dividends, min_n=2).collect()
    by = {((r["race_date"] - D0).days, r["combination"]): r["expected_payout"] for r in got}
    assert [by[i, "1-2-3"] for i in range(5)] == [None, 1000.0, 1500.0, 2000.0, 2000.0]
    assert [by[i, "6-5-4"] for i in range(5)] == [None, 1000.0, 1500.0, 2000.0, 2000.0]


def test_frequencies(rows):
    r = pricing.combination_frequencies(divs(rows, 100, 100, 400, 1000)).first()
    assert (r["wins"], r["mean_payout"], r["median_payout"]) == (4, 400.0, 250.0)


@pytest.fixture
def bare(rows):
    return rows("race_date DATE, stadium_id INT, race_no INT, combination STRING, p_model DOUBLE",
                *[(D0, 1, n, c, 0.1) for n in (1, 2) for c in ("1-2-3", "1-3-2", "2-1-3")])


def test_settlement_pays_both_of_a_dead_heat(rows, bare):
    dividends = rows(DIV, (D0, 1, 1, "1-2-3", 900.0), (D0, 1, 1, "1-3-2", 1500.0))
    got = {r["combination"]: (r["hit"], r["payout_yen"]) for r in pricing.settle_tickets(bare, dividends).collect()}
    assert got == {"1-2-3": (True, 900.0), "1-3-2": (True, 1500.0), "2-1-3": (False, 0.0)}
    with pytest.raises(ValueError, match="more than one row"):
        pricing.settle_tickets(bare, dividends.unionByName(dividends))


def test_real_odds(rows, bare):
    odds = rows("race_date DATE, stadium_id INT, race_no INT, combination STRING, odds DOUBLE",
                (D0, 1, 1, "1-2-3", 15.0))
    row = pricing.attach_odds(bare, odds).collect()
    assert len(row) == 1 and (row[0]["ev"], row[0]["expected_payout"]) == (1.5, 1500.0)
    with pytest.raises(ValueError, match="missing"):
        pricing.attach_odds(bare, odds.drop("odds"))
    with pytest.raises(ValueError, match="more than one row"):
        pricing.attach_odds(bare, odds.unionByName(odds))
    cover = pricing.price_coverage(bare, odds).first()
    assert (cover["groups_ticketed"], cover["groups_priced"], cover["coverage"]) == (2, 1, 0.5)
    with pytest.raises(ValueError, match="needs an odds"):
        price_tickets(bare, odds, None, "odds")


def ticket(i, ev, payout=0.0, day=0, p=0.1, price=1500.0):
    return (D0 + timedelta(days=day), 1, i, "1-2-3", p, price, ev, payout > 0, payout)


def one(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df.first()


def test_rollup_counts_only_what_clears_the_threshold(rows):
    df = rows(SETTLED, ticket(1, 1.5, 1600.0), ticket(2, 1.05), ticket(3, 0.9, 5000.0), ticket(4, 1.25))
    table = pricing.threshold_rollup(df)
    assert table.count() == 8
    r = one(table, threshold=1.0, staking="flat")
    assert (r["bets"], r["purchase_rate"], r["races_bet"], r["hit_rate"]) == (3, 0.75, 0.75, pytest.approx(1 / 3))
    assert (r["roi"], r["staked_yen"], r["returned_yen"]) == (pytest.approx(1600 / 300), 300.0, 1600.0)
    assert one(table, threshold=1.3, staking="flat")["bets"] == 1
    alert = pricing.roi_alert(table).first()
    assert alert["suspect_leak"] and alert["threshold"] == 1.3


def test_strategies_without_bets_are_kept(rows):
    r = one(pricing.threshold_rollup(rows(SETTLED, ticket(1, 0.2))), threshold=1.0, staking="flat")
    assert (r["bets"], r["roi"], r["max_dd_yen"]) == (0, 0.0, 0.0)
    with pytest.raises(ValueError, match="unknown staking"):
        pricing.threshold_rollup(rows(SETTLED, ticket(1, 0.2)), stakings=("all-in",))


def test_yearly(rows):
    df = rows(SETTLED, ticket(1, 1.5, 300.0), ticket(2, 1.5, 0.0, day=400))
    got = {r["year"]: r["roi"] for r in pricing.threshold_rollup(df, (1.2,), ("flat",), by_year=True).collect()}
    assert got == {2024: 3.0, 2025: 0.0}


def test_losses_from_the_start_are_a_drawdown(rows):
    df = rows(SETTLED, *[ticket(i, 1.5) for i in range(5)])
    assert one(pricing.threshold_rollup(df), threshold=1.0, staking="flat")["max_dd_yen"] == 500.0


@pytest.mark.parametrize("seed", range(4))
def test_drawdown_equals_the_loop(rows, seed):
    rng = random.Random(seed)
    data = [(D0 + timedelta(days=rng.randrange(9)), rng.randrange(1, 4), rng.randrange(1, 20_000),
             f"c{i:03d}", float(rng.randrange(-100, 101))) for i in range(300)]
    df = rows("race_date DATE, stadium_id INT, race_no INT, combination STRING, pnl DOUBLE", *data)
    total = peak = worst = 0.0
    for row in sorted(data):
        total += row[4]
        peak = max(peak, total)
        worst = max(worst, peak - total)
    assert pricing.max_drawdown(df, [], "pnl").first()["max_dd_yen"] == worst


def test_backtest_end_to_end(rows):
    scored = rows("race_date DATE, stadium_id INT, race_no INT, lane INT, p_win DOUBLE",
                  *[(D0 + timedelta(days=d), 1, 1, lane, p) for d in range(3)
                    for lane, p in enumerate((0.4, 0.2, 0.15, 0.1, 0.1, 0.05), 1)])
    payouts = divs(rows, 1000, 3000, 8000).withColumn("bet_type", F.lit("trifecta"))
    result = backtest(scored, payouts)
    assert result.settled.count() == 240  # the first day has no earlier dividend
    flat = one(result.table, threshold=1.0, staking="flat")
    assert 0 < flat["bets"] < 240 and result.table.count() == 8

"""Threshold back-test: score, explode, price, settle, roll up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import pricing
from wakeline.operators.groups import complete_groups
from wakeline.operators.models import TrainedModel
from wakeline.operators.splits import hold_out, years
from wakeline.operators.triples import race_tickets
from wakeline.schema import DEFAULT_THRESHOLDS, STAKINGS, VALID_YEARS
from wakeline.session import staged

#: ``odds``: the group's own price; ``prior``: mean dividend of earlier dates;
#: ``latest``: one price per combination for all time, which sees the period priced.
PRICE_MODES = ("odds", "prior", "latest")


@dataclass(frozen=True)
class Backtest:
    settled: DataFrame
    table: DataFrame
    yearly: DataFrame
    alert: DataFrame


def price_tickets(
    tickets: DataFrame, dividends: DataFrame, odds: DataFrame | None, mode: str
) -> DataFrame:
    if mode == "odds":
        if odds is None:
            raise ValueError("price mode 'odds' needs an odds table")
        return pricing.attach_odds(tickets, odds)
    if mode == "prior":
        return pricing.attach_prior_payout(tickets, dividends)
    if mode == "latest":
        return pricing.attach_expected_payout(tickets, pricing.price_table(dividends))
    raise ValueError(f"unknown price mode {mode!r}; choose from {list(PRICE_MODES)}")


def backtest(
    scored: DataFrame,
    payouts: DataFrame,
    *,
    odds: DataFrame | None = None,
    mode: str | None = None,
    thresholds=DEFAULT_THRESHOLDS,
    stakings=STAKINGS,
    yearly_threshold: float = 1.20,
) -> Backtest:
    """Back-test scored members (``lane``, ``p_win``) against dividends."""
    mode = mode or ("odds" if odds is not None else "prior")
    dividends = pricing.load_dividends(payouts)
    priced = price_tickets(race_tickets(scored), dividends, odds, mode)
    settled = pricing.settle_tickets(priced, dividends).filter(F.col("ev").isNotNull())
    # a few rows, written so that the alert does not run the back-test again
    table = staged(pricing.threshold_rollup(settled, thresholds, stakings), "rollup")
    yearly = pricing.threshold_rollup(settled, (yearly_threshold,), ("flat",), by_year=True)
    return Backtest(settled, table, yearly, pricing.roi_alert(table))


def score_split(
    model: TrainedModel, features: DataFrame, split: str = "valid", *, final: bool = False
) -> DataFrame:
    """Scored complete groups of the validation years or, once, of the hold-out."""
    if split not in ("valid", "test"):
        raise ValueError(f"unknown split {split!r}")
    rows = hold_out(features, final_evaluation=final) if split == "test" else years(
        features, *VALID_YEARS
    )
    return model.predict(complete_groups(rows), bounded=True)

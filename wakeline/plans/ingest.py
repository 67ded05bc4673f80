"""Ingest: both feeds of a batch of days to merged groups, members and payouts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.merge import keyed_merge, latest_by, two_feed_merge
from wakeline.schema import ENTRIES, MEMBER_KEYS, PAYOUTS, RACE_KEYS, RACES
from wakeline.sources.feeds import parse_card_feed, parse_result_feed
from wakeline.sources.tables import conform

PAYOUT_KEYS = [*RACE_KEYS, "bet_type", "combination"]


@dataclass(frozen=True)
class DayTables:
    races: DataFrame
    entries: DataFrame
    payouts: DataFrame
    card_outcomes: DataFrame
    result_outcomes: DataFrame


def _one_row(df: DataFrame, keys: list[str], pick: Callable[..., Column]) -> DataFrame:
    """One row per key where a feed repeats it: per column the first (``F.min_by``) or last
    (``F.max_by``) value that is not null, in the order of files and lines."""
    rest = [c for c in df.columns if c not in (*keys, "at")]
    filled = {c: F.when(F.col(c).isNotNull(), F.col("at")) for c in rest}
    return df.groupBy(*keys).agg(*[pick(c, at).alias(c) for c, at in filled.items()])


def ingest(card_files: DataFrame, result_files: DataFrame) -> DayTables:
    """Parse and merge. Group columns prefer the card, member columns the result.

    Of repeated groups the first values count, of repeated members the last.
    """
    card, result = parse_card_feed(card_files), parse_result_feed(result_files)
    races = two_feed_merge(
        _one_row(card.races, RACE_KEYS, F.min_by), _one_row(result.races, RACE_KEYS, F.min_by), RACE_KEYS,
        card_wins=["title", "distance_m"],
    ).withColumn("fixed_course", F.coalesce("fixed_course", F.lit(False)))
    entries = two_feed_merge(
        _one_row(card.entries.filter(F.col("lane").isNotNull()), MEMBER_KEYS, F.max_by),
        _one_row(result.entries, MEMBER_KEYS, F.max_by), MEMBER_KEYS,
        result_wins=["racer_id", "racer_name", "motor_no", "boat_no"],
    )
    return DayTables(
        conform(races, RACES), conform(entries, ENTRIES), conform(result.payouts, PAYOUTS),
        card.outcomes, result.outcomes,
    )


def upsert(stored: DayTables, fresh: DayTables) -> DayTables:
    """Merge a batch into stored tables; the same batch twice changes nothing."""
    races = keyed_merge(
        stored.races, fresh.races, RACE_KEYS, either=["fixed_course", "has_b", "has_k"]
    )
    entries = keyed_merge(stored.entries, fresh.entries, MEMBER_KEYS)
    once = latest_by(fresh.payouts, PAYOUT_KEYS, ["payout_yen", "popularity"])
    payouts = keyed_merge(stored.payouts, once, PAYOUT_KEYS, replace=["payout_yen"])
    return DayTables(
        races, entries, payouts,
        stored.card_outcomes.unionByName(fresh.card_outcomes),
        stored.result_outcomes.unionByName(fresh.result_outcomes),
    )

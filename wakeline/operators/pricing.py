"""Prices, settlement and threshold roll-ups of tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.numeric import kelly_fraction
from wakeline.operators.history import GROUPS_PER_BLOCK, blocked, expanding_mean
from wakeline.operators.prefix import HOT_ROWS
from wakeline.operators.quality import assert_unique
from wakeline.schema import (
    BANKROLL,
    DEFAULT_THRESHOLDS,
    MIN_PRIOR_OBSERVATIONS,
    RACE_KEYS,
    STAKINGS,
    TICKET_KEYS,
    TICKET_YEN,
)
from wakeline.session import staged

#: Rows of a price table that is sent to every task.
SENT_PRICES = 100_000
_DAY_LEVELS = [["race_date"], ["stadium_id", "race_block"]]


def load_dividends(payouts: DataFrame, *, bet_type: str = "trifecta", before=None) -> DataFrame:
    """Dividend rows of one type, optionally only before a date. Both filters push down."""
    if "bet_type" in payouts.columns:
        payouts = payouts.filter(F.col("bet_type") == bet_type)
    if before is not None:
        payouts = payouts.filter(F.col("race_date") < F.lit(before))
    return payouts.select(*TICKET_KEYS, "payout_yen")


def expected_dividends(dividends: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean dividend of the combination over earlier rows, from 30 rows on; else overall."""
    ordered = blocked(dividends)
    return expanding_mean(
        ordered, "payout_yen", ["combination"], RACE_KEYS, _DAY_LEVELS, "expected_payout",
        hot_rows=hot_rows,
    ).drop("race_block")


def price_table(dividends: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Latest expected dividend per combination (the last dividend itself is not in it)."""
    order = F.struct(*RACE_KEYS)
    known = F.col("expected_payout").isNotNull()
    return (
        expected_dividends(dividends, hot_rows=hot_rows)
        .filter(known)
        .groupBy("combination")
        .agg(F.max_by("expected_payout", order).alias("expected_payout"))
    )


def combination_frequencies(dividends: DataFrame) -> DataFrame:
    """Count, mean and exact median per combination.

    Equal payouts are counted before the shuffle, so the median sees one row per
    distinct payout.
    """
    counted = dividends.groupBy("combination", F.col("payout_yen").cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    return counted.groupBy("combination").agg(
        F.sum("c").alias("wins"),
        F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum("c")).alias("mean_payout"),
        F.percentile("v", 0.5, F.col("c")).alias("median_payout"),
    )


def attach_expected_payout(tickets: DataFrame, prices: DataFrame) -> DataFrame:
    """One price per combination, at most one row of each being read.

    The prices are written first. Tickets stay where they are while the table has few enough rows to
    be sent to them; beyond SENT_PRICES both sides are shuffled.
    """
    latest = staged(prices.groupBy("combination").agg(F.max("expected_payout").alias("expected_payout")), "prices")
    if latest.count() <= SENT_PRICES:
        latest = F.broadcast(latest)
    return tickets.join(latest, "combination", "left").withColumn(
        "ev", F.col("p_model") * F.col("expected_payout") / TICKET_YEN
    )


def attach_prior_payout(
    tickets: DataFrame, dividends: DataFrame, *, min_n: int = MIN_PRIOR_OBSERVATIONS
) -> DataFrame:
    """Price each ticket with dividends of strictly earlier dates only.

    The price depends on combination and date alone, so it is worked out on that
    small grid (combinations x calendar) and joined to the tickets.
    """
    day = ["combination", "race_date"]
    daily = dividends.groupBy(*day).agg(
        F.sum(F.col("payout_yen").cast("double")).alias("s"), F.count("payout_yen").alias("n")
    )
    wanted = tickets.select(*day).distinct().withColumns(
        {"s": F.lit(0.0), "n": F.lit(0).cast("long")}
    )
    grid = daily.unionByName(wanted).groupBy(*day).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    before = Window.partitionBy("combination").orderBy("race_date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    own = grid.select(*day, F.sum("s").over(before).alias("s"), F.sum("n").over(before).alias("n"))
    # one row per calendar day
    all_before = Window.partitionBy(F.lit(0)).orderBy("race_date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    overall = grid.groupBy("race_date").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(
        "race_date",
        F.sum("s").over(all_before).alias("all_s"),
        F.sum("n").over(all_before).alias("all_n"),
    )
    price = F.when(F.col("n") >= min_n, F.try_divide("s", "n")).when(
        F.col("all_n") > 0, F.try_divide("all_s", "all_n")
    )
    prices = own.join(overall, "race_date").select(*day, price.alias("expected_payout"))
    return tickets.join(prices, day, "left").withColumn(
        "ev", F.col("p_model") * F.col("expected_payout") / TICKET_YEN
    )


def attach_odds(tickets: DataFrame, odds: DataFrame, *, check: bool = True) -> DataFrame:
    """Price tickets with the odds of their own group; unpriced tickets are dropped."""
    missing = sorted({*TICKET_KEYS, "odds"} - set(odds.columns))
    if missing:
        raise ValueError(f"odds are missing columns: {missing}")
    if check:
        assert_unique(odds, TICKET_KEYS, "odds")
    # Size estimates do not see the explosion behind the tickets, so the join strategy
    # is stated: merge, on tickets that are already placed by group.
    prices = odds.select(*TICKET_KEYS, "odds").hint("merge")
    priced = tickets.join(prices, TICKET_KEYS, "inner")
    return priced.withColumns(
        {
            "expected_payout": F.col("odds") * TICKET_YEN,
            "ev": F.col("p_model") * F.col("odds"),
        }
    )


def settle_tickets(tickets: DataFrame, dividends: DataFrame, *, check: bool = True) -> DataFrame:
    """Pay each ticket its own dividend or nothing; groups without a dividend drop out.

    Settling on (group, combination) pays both tickets of a dead heat.
    """
    if check:
        assert_unique(dividends, TICKET_KEYS, "dividends")
    eligible = tickets.join(dividends.select(*RACE_KEYS).hint("merge"), RACE_KEYS, "left_semi")
    paid = dividends.select(*TICKET_KEYS, F.col("payout_yen").cast("double").alias("payout_yen"))
    return eligible.join(paid.hint("merge"), TICKET_KEYS, "left").withColumns(
        {
            "hit": F.col("payout_yen").isNotNull(),
            "payout_yen": F.coalesce("payout_yen", F.lit(0.0)),
        }
    )


# ---------------------------------------------------------------------------
# Drawdown and roll-ups
# ---------------------------------------------------------------------------

def fold_curve(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()
) -> DataFrame:
    """Fold consecutive pieces of a P&L curve into one summary per key.

    A piece is (total, high, low, drawdown) with the curve starting at 0 before it.
    Folding is associative, so pieces are folded chunk by chunk, then chunks by day,
    then days; no window holds more than the children of one parent.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_off", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    peaked = placed.withColumn(
        "_peak",
        F.greatest(F.coalesce(F.max(F.col("_off") + F.col("high")).over(before), F.lit(0.0)),
                   F.lit(0.0)),
    )
    return peaked.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        F.max(F.col("_off") + F.col("high")).alias("high"),
        F.min(F.col("_off") + F.col("low")).alias("low"),
        F.max(F.greatest(F.col("drawdown"), F.col("_peak") - F.col("_off") - F.col("low")))
        .alias("drawdown"),
        *[F.sum(c).alias(c) for c in sums],
    )


def as_curve(df: DataFrame, pnl) -> DataFrame:
    """Each row as a piece of curve."""
    return df.withColumn("total", pnl).withColumns(
        {
            "high": F.greatest(F.col("total"), F.lit(0.0)),
            "low": F.col("total"),
            "drawdown": F.greatest(-F.col("total"), F.lit(0.0)),
        }
    )


def _fold_days(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], sums) -> DataFrame:
    """Pieces to blocks, blocks to days, days to one curve per key."""
    block = [*keys, "race_date", "stadium_id", "race_block"]
    by_block = fold_curve(pieces, block, order, sums)
    by_day = fold_curve(by_block, [*keys, "race_date"], ["stadium_id", "race_block"], sums)
    if keys:
        return fold_curve(by_day, keys, ["race_date"], sums)
    return fold_curve(by_day.withColumn("_all", F.lit(0)), ["_all"], ["race_date"], sums)


def max_drawdown(df: DataFrame, keys: Sequence[str], pnl: str, sums: Sequence[str] = ()) -> DataFrame:
    """Largest fall below the running peak (at least 0) per key, plus plain sums.

    Rows are ordered by group keys, then combination, which makes ties definite.
    """
    # tickets are folded where they lie; one small row per group moves on
    pieces = fold_curve(as_curve(df, F.col(pnl)), [*keys, *RACE_KEYS], ["combination"], sums)
    folded = _fold_days(blocked(pieces, size=GROUPS_PER_BLOCK), keys, ["race_no"], sums)
    return folded.select(*keys, *sums, F.col("drawdown").alias("max_dd_yen"))


def _group_curves(
    settled: DataFrame, strategies: Sequence[tuple[float, str]], bankroll: float
) -> DataFrame:
    """One row per group with its ticket count and each strategy's piece of curve.

    Tickets lie together by group and are sorted by combination after settlement, so
    all strategies are run over them side by side without moving a ticket again. A
    group has at most as many tickets as combinations. Tickets that no strategy buys
    repeat the curve's last value: they are counted, and only a group's first one stays.
    """
    stakes = {
        "flat": F.lit(TICKET_YEN),
        "quarter_kelly": kelly_fraction(F.col("p_model"), F.col("expected_payout")) * bankroll,
    }
    unknown = sorted({s for _, s in strategies} - set(stakes))
    if unknown:
        raise ValueError(f"unknown staking scheme {unknown}; choose from {list(STAKINGS)}")
    schemes = list(dict.fromkeys(s for _, s in strategies))
    group = Window.partitionBy(*RACE_KEYS)
    counted = settled.withColumns({
        "_place": F.row_number().over(group.orderBy("combination")),
        "tickets": F.count(F.lit(1)).over(group),
    })
    lowest = min(t for t, _ in strategies)
    bought = counted.filter((F.col("_place") == 1) | (F.col("ev") >= lowest))
    staked = bought.withColumns({f"_stake_{s}": stakes[s] for s in schemes})
    rows = staked.selectExpr(
        *RACE_KEYS, "combination", "hit", "tickets",
        *[
            f"CASE WHEN ev >= {t}D THEN _stake_{s} ELSE 0.0D END AS st{i}"
            for i, (t, s) in enumerate(strategies)
        ],
        *[
            f"CASE WHEN hit AND ev >= {t}D THEN _stake_{s} / {TICKET_YEN}D * payout_yen "
            f"ELSE 0.0D END AS rt{i}"
            for i, (t, s) in enumerate(strategies)
        ],
        *[f"coalesce(ev >= {t}D, false) AS in{i}" for i, (t, _) in enumerate(strategies)],
    )
    over = (
        f"OVER (PARTITION BY {', '.join(RACE_KEYS)} ORDER BY combination "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    each = range(len(strategies))
    curve = rows.selectExpr("*", *[f"sum(rt{i} - st{i}) {over} AS c{i}" for i in each])
    fallen = curve.selectExpr(
        "*", *[f"greatest(0.0D, max(c{i}) {over}) - c{i} AS d{i}" for i in each]
    )
    pieces = ", ".join(
        f"named_struct('strategy', {i}, 'bets', count_if(in{i}), "
        f"'hits', count_if(in{i} AND hit), 'staked', sum(st{i}), 'returned', sum(rt{i}), "
        f"'total', sum(rt{i} - st{i}), 'high', greatest(0.0D, max(c{i})), 'low', min(c{i}), "
        f"'drawdown', max(d{i}))"
        for i in each
    )
    return fallen.groupBy(*RACE_KEYS).agg(
        F.max("tickets").alias("tickets"), F.expr(f"array({pieces})").alias("_pieces")
    )


def threshold_rollup(
    settled: DataFrame,
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
    stakings: Sequence[str] = STAKINGS,
    *,
    by_year: bool = False,
    bankroll: float = BANKROLL,
) -> DataFrame:
    """Every threshold and staking scheme in one pass; strategies without bets are kept."""
    strategies = [(float(t), s) for s in stakings for t in thresholds]
    groups = blocked(_group_curves(settled, strategies, bankroll))
    by = ["year"] if by_year else []
    pieces = groups.select(
        *RACE_KEYS, "race_block", "tickets", F.lit(1).cast("long").alias("groups"),
        *([F.year("race_date").alias("year")] if by_year else []),
        F.inline("_pieces"),
    ).withColumn("groups_bet", (F.col("bets") > 0).cast("long"))
    # strategies are keyed by number: grouping and windows on a double would be
    # normalised differently and shuffle twice
    keys = ["strategy", *by]
    sums = ("tickets", "groups", "bets", "groups_bet", "hits", "staked", "returned")
    rolled = _fold_days(pieces, keys, ["race_no"], sums)

    def ratio(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    numbered = [
        F.array(*[F.lit(x) for x in column])[F.col("strategy")].alias(name)
        for name, column in zip(("threshold", "staking"), zip(*strategies))
    ]
    return rolled.select(
        *by,
        *numbered,
        "bets",
        ratio("bets", "tickets").alias("purchase_rate"),
        ratio("groups_bet", "groups").alias("races_bet"),
        ratio("hits", "bets").alias("hit_rate"),
        ratio("returned", "staked").alias("roi"),
        F.col("drawdown").alias("max_dd_yen"),
        F.col("staked").alias("staked_yen"),
        F.col("returned").alias("returned_yen"),
    )


def roi_alert(rollup: DataFrame) -> DataFrame:
    """Best flat-stake threshold; a return above 1 is reported as a suspected leak."""
    flat = rollup.filter(F.col("staking") == "flat")
    return flat.agg(
        F.max_by("threshold", F.struct("roi", -F.col("threshold"))).alias("threshold"),
        F.max("roi").alias("roi"),
        (F.max("roi") > 1).alias("suspect_leak"),
    )


def price_coverage(tickets: DataFrame, odds: DataFrame) -> DataFrame:
    """How many groups have any price. ``tickets`` may be any rows with the group's keys, so
    scored members do and nothing has to be exploded."""
    groups = tickets.select(*RACE_KEYS).distinct().withColumn("ticketed", F.lit(1))
    priced = odds.select(*RACE_KEYS).distinct().withColumn("priced", F.lit(1))
    return groups.join(priced, RACE_KEYS, "left").agg(
        F.count("ticketed").alias("groups_ticketed"),
        F.count("priced").alias("groups_priced"),
        F.try_divide(F.count("priced").cast("double"), F.count("ticketed")).alias("coverage"),
    )

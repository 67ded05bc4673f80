"""Queries on prices, settlement and roll-ups, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.scoring import TICKETS_SQL, scored, tickets
from bindings.tables import DIVIDENDS_SQL, MEMBERS_SQL, ODDS_SQL, dividends, odds, payouts
from wakeline.functions.numeric import implied_probability, kelly_fraction
from wakeline.operators import pricing
from wakeline.operators.triples import wide_groups
from wakeline.plans import report
from wakeline.schema import RACE_KEYS

QUERIES = {}
SQL = {}

#: Everything behind a settled ticket. Both chains start with the members CTE.
ALL_SQL = DIVIDENDS_SQL + ",\n" + TICKETS_SQL.removeprefix(MEMBERS_SQL + ",\n").lstrip(",\n") + ",\n" + ODDS_SQL

EXPECTED_SQL = """,
expected AS (
  SELECT *, CASE WHEN n >= 30 THEN s / n WHEN an > 0 THEN asum / an END AS expected_payout
  FROM (SELECT *, count(*) OVER g AS n, sum(payout_yen) OVER g AS s,
          count(*) OVER a AS an, sum(payout_yen) OVER a AS asum
        FROM dividends
        WINDOW g AS (PARTITION BY combination ORDER BY race_date, stadium_id, race_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               a AS (ORDER BY race_date, stadium_id, race_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
prices AS (
  SELECT combination, arg_max(expected_payout, row(race_date, stadium_id, race_no)) AS expected_payout
  FROM expected WHERE expected_payout IS NOT NULL GROUP BY combination)"""

SETTLED_SQL = ALL_SQL + """,
priced AS (
  SELECT t.*, odds, odds * 100 AS expected_payout, p_model * odds AS ev
  FROM tickets t JOIN odds USING (race_date, stadium_id, race_no, combination)),
settled AS (
  SELECT p.*, coalesce(d.payout_yen, 0) AS payout_yen, d.payout_yen IS NOT NULL AS hit
  FROM (SELECT * FROM priced SEMI JOIN dividends USING (race_date, stadium_id, race_no)) p
  LEFT JOIN dividends d USING (race_date, stadium_id, race_no, combination))"""

_KELLY = """least(greatest(CASE WHEN expected_payout / 100.0e0 - 1 > 0
  THEN (p_model * (expected_payout / 100.0e0 - 1) - (1 - p_model)) / (expected_payout / 100.0e0 - 1)
  ELSE 0 END / 4.0e0, 0), 0.02e0)"""


def rollup_sql(thresholds: str, stakings: str, year: bool) -> str:
    y, using = ("year, ", "year, ") if year else ("", "")
    on = "USING (threshold, staking, year)" if year else "USING (threshold, staking)"
    base = "SELECT *, CAST(year(race_date) AS INT) AS year FROM settled" if year else "SELECT * FROM settled"
    group = "GROUP BY year" if year else ""
    return f"""WITH {SETTLED_SQL},
base AS ({base}),
totals AS (SELECT {y}count(*) AS tt, count(DISTINCT race_no) AS tr FROM base {group}),
grid AS (SELECT * FROM totals, (VALUES {thresholds}) a(threshold), (VALUES {stakings}) b(staking)),
bought AS (
  SELECT *, CASE WHEN hit THEN stake / 100 * payout_yen ELSE 0 END AS returned
  FROM (SELECT *, CASE WHEN staking = 'flat' THEN 100.0e0 ELSE {_KELLY} * 1000000 END AS stake
        FROM base, (VALUES {thresholds}) a(threshold), (VALUES {stakings}) b(staking) WHERE ev >= threshold)),
curve AS (
  SELECT *, sum(returned - stake) OVER (PARTITION BY {y}threshold, staking
    ORDER BY race_date, stadium_id, race_no, combination) AS c FROM bought),
peaks AS (
  SELECT *, greatest(0, max(c) OVER (PARTITION BY {y}threshold, staking
    ORDER BY race_date, stadium_id, race_no, combination)) AS peak FROM curve),
rolled AS (
  SELECT {y}threshold, staking, count(*) AS bets, count(DISTINCT race_no) AS gb,
    count(*) FILTER (WHERE hit) AS hits, sum(stake) AS staked, sum(returned) AS returned, max(peak - c) AS dd
  FROM peaks GROUP BY {y}threshold, staking)
SELECT {y}threshold, staking, coalesce(bets, 0) AS bets, round(coalesce(bets / tt, 0), 6) AS purchase_rate,
  round(coalesce(gb / tr, 0), 6) AS races_bet, round(coalesce(hits / bets, 0), 6) AS hit_rate,
  round(coalesce(returned / staked, 0), 6) AS roi, round(coalesce(dd, 0), 2) AS max_dd_yen,
  round(coalesce(staked, 0), 2) AS staked_yen, round(coalesce(returned, 0), 2) AS returned_yen
FROM grid LEFT JOIN rolled {on}"""


_THRESHOLDS = "(1.0e0), (1.1e0), (1.2e0), (1.3e0)"
_STAKINGS = "('flat'), ('quarter_kelly')"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def _priced(spark, sf):
    # the keys of both tables are checked where they are made
    return pricing.attach_odds(tickets(spark, sf), odds(spark, sf, place=True), check=False)


def settled(spark, sf):
    return pricing.settle_tickets(_priced(spark, sf), dividends(spark, sf), check=False)


def _rolled(df):
    return df.select(
        *[c for c in ("year", "threshold", "staking", "bets") if c in df.columns],
        *_r("purchase_rate", "races_bet", "hit_rate", "roi"),
        *_r("max_dd_yen", "staked_yen", "returned_yen", digits=2),
    )


@query("expanding_mean_fallback", f"""WITH {DIVIDENDS_SQL}{EXPECTED_SQL}
SELECT race_no, combination, n AS expected_payout_n, round(expected_payout, 6) AS expected_payout FROM expected""")
def expanding_mean_query(spark, sf):
    return pricing.expected_dividends(dividends(spark, sf)).select(
        "race_no", "combination", "expected_payout_n", *_r("expected_payout")
    )


@query("latest_price", f"WITH {DIVIDENDS_SQL}{EXPECTED_SQL} SELECT combination, round(expected_payout, 6) AS expected_payout FROM prices")
def latest_price_query(spark, sf):
    return pricing.price_table(dividends(spark, sf)).select("combination", *_r("expected_payout"))


@query("combination_frequencies", f"""WITH {DIVIDENDS_SQL}
SELECT combination, count(*) AS wins, round(avg(payout_yen), 6) AS mean_payout, median(payout_yen) AS median_payout
FROM dividends GROUP BY combination""")
def frequencies_query(spark, sf):
    return pricing.combination_frequencies(dividends(spark, sf)).select(
        "combination", "wins", *_r("mean_payout"), "median_payout"
    )


@query("count_by_type", f"WITH {DIVIDENDS_SQL} SELECT bet_type, count(*) AS n FROM payouts GROUP BY bet_type")
def count_by_type_query(spark, sf):
    return payouts(spark, sf).groupBy("bet_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("proxy_price_join", f"""WITH {ALL_SQL}{EXPECTED_SQL}
SELECT race_no, combination, round(expected_payout, 6) AS expected_payout, round(p_model * expected_payout / 100, 6) AS ev
FROM tickets LEFT JOIN prices USING (combination)""")
def proxy_query(spark, sf):
    prices = pricing.price_table(dividends(spark, sf))
    return pricing.attach_expected_payout(tickets(spark, sf), prices).select(
        "race_no", "combination", *_r("expected_payout", "ev")
    )


@query("asof_price_join", f"""WITH {ALL_SQL},
want AS (SELECT DISTINCT race_date, combination FROM tickets),
priced AS (
  SELECT w.race_date, w.combination,
    (SELECT count(*) FROM dividends d WHERE d.race_date < w.race_date AND d.combination = w.combination) AS n,
    (SELECT sum(payout_yen) FROM dividends d WHERE d.race_date < w.race_date AND d.combination = w.combination) AS s
  FROM want w),
overall AS (
  SELECT w.race_date, (SELECT count(*) FROM dividends d WHERE d.race_date < w.race_date) AS an,
    (SELECT sum(payout_yen) FROM dividends d WHERE d.race_date < w.race_date) AS asum
  FROM (SELECT DISTINCT race_date FROM want) w)
SELECT race_no, combination, round(x, 6) AS expected_payout, round(p_model * x / 100, 6) AS ev
FROM (SELECT t.race_no, t.combination, p_model, CASE WHEN n >= 30 THEN s / n WHEN an > 0 THEN asum / an END AS x
      FROM tickets t JOIN priced USING (race_date, combination) JOIN overall USING (race_date))""")
def asof_price_query(spark, sf):
    return pricing.attach_prior_payout(tickets(spark, sf), dividends(spark, sf)).select(
        "race_no", "combination", *_r("expected_payout", "ev")
    )


@query("odds_price_join", f"""WITH {SETTLED_SQL}
SELECT race_no, combination, odds, round(expected_payout, 6) AS expected_payout, round(ev, 6) AS ev FROM priced""")
def odds_query(spark, sf):
    return _priced(spark, sf).select(
        "race_no", "combination", "odds", *_r("expected_payout", "ev")
    )


@query("settle_tickets", f"WITH {SETTLED_SQL} SELECT race_no, combination, hit, payout_yen FROM settled")
def settle_query(spark, sf):
    return settled(spark, sf).select("race_no", "combination", "hit", "payout_yen")


@query("implied_probability", f"""WITH {ALL_SQL}
SELECT race_no, combination, round(0.75e0 / odds, 9) AS p_market FROM odds WHERE odds > 0""")
def implied_query(spark, sf):
    return (
        odds(spark, sf)
        .withColumn("p_market", implied_probability(F.col("odds")))
        .filter(F.col("p_market").isNotNull())
        .select("race_no", "combination", *_r("p_market", digits=9))
    )


@query("kelly_stake", f"WITH {SETTLED_SQL} SELECT race_no, combination, round({_KELLY}, 9) AS stake FROM priced")
def kelly_query(spark, sf):
    priced = _priced(spark, sf)
    stake = kelly_fraction(F.col("p_model"), F.col("expected_payout"))
    return priced.select("race_no", "combination", F.round(stake, 9).alias("stake"))


@query("threshold_rollup", rollup_sql(_THRESHOLDS, _STAKINGS, False))
def rollup_query(spark, sf):
    return _rolled(pricing.threshold_rollup(settled(spark, sf)))


@query("yearly_rollup", rollup_sql("(1.2e0)", "('flat')", True))
def yearly_query(spark, sf):
    rows = pricing.threshold_rollup(settled(spark, sf), (1.2,), ("flat",), by_year=True)
    return _rolled(rows)


@query("max_drawdown", f"""WITH {SETTLED_SQL},
curve AS (SELECT *, sum(CASE WHEN hit THEN payout_yen ELSE 0 END - 100) OVER (
    ORDER BY race_date, stadium_id, race_no, combination) AS c FROM settled),
peaks AS (SELECT *, greatest(0, max(c) OVER (ORDER BY race_date, stadium_id, race_no, combination)) AS peak FROM curve)
SELECT round(max(peak - c), 2) AS max_dd_yen FROM peaks""")
def drawdown_query(spark, sf):
    rows = settled(spark, sf).withColumn(
        "pnl", F.when(F.col("hit"), F.col("payout_yen")).otherwise(0.0) - 100.0
    )
    return pricing.max_drawdown(rows, [], "pnl").select(*_r("max_dd_yen", digits=2))


@query("roi_alert", f"""SELECT arg_max(threshold, row(roi, -threshold)) AS threshold, max(roi) AS roi, max(roi) > 1 AS suspect_leak
FROM ({rollup_sql(_THRESHOLDS, "('flat')", False)})""")
def alert_query(spark, sf):
    rolled = _rolled(pricing.threshold_rollup(settled(spark, sf), stakings=("flat",)))
    return pricing.roi_alert(rolled)


_PICKS_ORDER = "ev DESC, race_date, stadium_id, race_no, combination"


@query("top_picks", f"""WITH {SETTLED_SQL}
SELECT race_no, combination, round(ev, 6) AS ev, row_number() OVER (ORDER BY {_PICKS_ORDER}) AS place,
  count(*) OVER () AS picks
FROM priced WHERE ev >= 1.2e0 ORDER BY {_PICKS_ORDER} LIMIT 80""")
def picks_query(spark, sf):
    priced = _priced(spark, sf)
    return report.top_picks(priced, 1.2).select(
        "race_no", "combination", *_r("ev"), F.col("place").cast("long").alias("place"), "picks"
    )


@query("favourites_topk", f"""WITH {ALL_SQL}
SELECT race_no, combination, odds, round(0.75e0 / odds, 9) AS p_market
FROM odds ORDER BY odds, race_date, stadium_id, race_no, combination LIMIT 10""")
def favourites_query(spark, sf):
    return report.favourites(odds(spark, sf)).select(
        "race_no", "combination", "odds", *_r("p_market", digits=9)
    )


@query("report_lines", f"""WITH {ALL_SQL}
SELECT race_no, string_agg(concat(lane, ' ', printf('%.3f', p_win)), ' ' ORDER BY lane) AS line
FROM scored GROUP BY race_no""")
def lines_query(spark, sf):
    return report.member_lines(scored(spark, sf)).select("race_no", "line")


@query("price_coverage", f"""WITH {ALL_SQL}
SELECT count(*) AS groups_ticketed, count(o.race_no) AS groups_priced, round(count(o.race_no) / count(*), 6) AS coverage
FROM (SELECT DISTINCT race_no FROM tickets) t LEFT JOIN (SELECT DISTINCT race_no FROM odds) o USING (race_no)""")
def coverage_query(spark, sf):
    groups = wide_groups(scored(spark, sf), RACE_KEYS, "lane", "p_win", 6)
    return pricing.price_coverage(groups, odds(spark, sf)).select(
        "groups_ticketed", "groups_priced", *_r("coverage")
    )

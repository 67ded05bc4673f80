"""Queries on merges, joins and data quality, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.history import PREPARED_SQL
from bindings.tables import DIVIDENDS_SQL, MEMBERS_SQL, members, members_in_passing, payouts, read
from wakeline.functions.text import race_key_text
from wakeline.operators import merge, quality, rules
from wakeline.operators.asof import asof_join
from wakeline.operators.history import Rate, shrunk_rates
from wakeline.operators.pricing import load_dividends
from wakeline.operators.prefix import Family, Measure, carry_forward, running
from wakeline.plans import features
from wakeline.plans.daily import resolve_names, select_groups
from wakeline.schema import GRADES, RACE_KEYS

QUERIES = {}
SQL = {}

#: The dividends without the members they start from.
DIVIDENDS_ONLY_SQL = DIVIDENDS_SQL.removeprefix(MEMBERS_SQL + ",\n").lstrip(",\n")


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def events(spark, sf):
    return read(spark, sf, "events").withColumn("day", F.to_date("ts"))


# --- scans and the base join ------------------------------------------------

_RACE_COLUMNS = [
    "deadline_time", "fixed_course", "weather", "wind_direction", "wind_speed_m",
    "wave_height_cm", "series_day", "distance_m", "has_b", "has_k",
]


def races(spark, sf):
    first = members(spark, sf).groupBy(*RACE_KEYS)
    return first.agg(*[F.first(c).alias(c) for c in _RACE_COLUMNS])


def entries(spark, sf):
    return members(spark, sf).drop(*_RACE_COLUMNS)


@query("scan_project", """SELECT l_orderkey AS race_no, CAST(l_suppkey AS INT) AS racer_id, l_extendedprice AS price, 'line' AS kind
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 40""")
def scan_project(spark, sf):
    lines = read(spark, sf, "lineitem")
    return lines.filter(
        (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
        & (F.col("l_quantity") > 40)
    ).select(
        F.col("l_orderkey").alias("race_no"), F.col("l_suppkey").cast("int").alias("racer_id"),
        F.col("l_extendedprice").alias("price"), F.lit("line").alias("kind"),
    )


@query("base_entry_query", f"""WITH {MEMBERS_SQL}
SELECT race_no, lane, racer_id, weather, deadline_time FROM members
WHERE has_b AND has_k AND race_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def base_entries(spark, sf):
    joined = features.base_entries(
        entries(spark, sf), races(spark, sf), start="1996-01-01", end="1999-12-31"
    )
    return joined.select("race_no", "lane", "racer_id", "weather", "deadline_time")


@query("left_join_preserving", f"""WITH {MEMBERS_SQL}
SELECT race_no, lane, weather, series_day FROM members""")
def left_join_preserving(spark, sf):
    joined = merge.join_preserving(entries(spark, sf), races(spark, sf), RACE_KEYS)
    return joined.select("race_no", "lane", "weather", "series_day")


@query("select_after_window", f"""WITH {PREPARED_SQL},
w AS (SELECT *, count(won) OVER (PARTITION BY racer_id ORDER BY race_ts
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS racer_win_n FROM prepared)
SELECT race_no, lane, racer_win_n FROM w WHERE stadium_id = 7""")
def select_after_window(spark, sf):
    """One venue is picked after the history is built, so other venues still count."""
    rate = Rate("racer_win", "won", ("racer_id",), 30.0, ("racer_id",))
    rows = shrunk_rates(features.prepare(members(spark, sf)), [rate])
    return select_groups(rows, stadium=7).select("race_no", "lane", "racer_win_n")


# --- two feeds ----------------------------------------------------------------

_FEEDS_SQL = """e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
card AS (SELECT user_id, day, arg_max(CASE WHEN event_id % 3 <> 0 THEN value END, event_id) FILTER (WHERE event_id % 3 <> 0) AS value,
    count(*) AS visits FROM e WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL),
result AS (SELECT user_id, day, arg_max(value, event_id) FILTER (WHERE event_id % 4 <> 0) AS value,
    max(event_id) AS last_id FROM e WHERE event_type IN ('purchase', 'error') GROUP BY ALL)"""


def _feeds(spark, sf):
    rows = events(spark, sf)
    newest = lambda step: F.max_by("value", F.when(F.col("event_id") % step != 0, F.col("event_id")))
    card = rows.filter(F.col("event_type").isin("view", "click", "signup")).groupBy("user_id", "day").agg(
        newest(3).alias("value"), F.count(F.lit(1)).alias("visits")
    )
    result = rows.filter(F.col("event_type").isin("purchase", "error")).groupBy("user_id", "day").agg(
        newest(4).alias("value"), F.max("event_id").alias("last_id")
    )
    return card, result


@query("two_feed_merge", f"""WITH {_FEEDS_SQL}
SELECT coalesce(c.user_id, r.user_id) AS user_id, coalesce(c.day, r.day) AS day,
  coalesce(c.value, r.value) AS value, visits, last_id,
  c.user_id IS NOT NULL AS has_b, r.user_id IS NOT NULL AS has_k
FROM card c FULL JOIN result r ON c.user_id = r.user_id AND c.day = r.day""")
def two_feed_merge(spark, sf):
    card, result = _feeds(spark, sf)
    return merge.two_feed_merge(card, result, ["user_id", "day"], card_wins=["value"])


@query("feed_agreement", f"""WITH {_FEEDS_SQL}
SELECT c.user_id, c.day, c.value, r.value AS other_value FROM card c JOIN result r USING (user_id, day)
WHERE c.value IS DISTINCT FROM r.value""")
def feed_agreement(spark, sf):
    card, result = _feeds(spark, sf)
    return merge.feed_disagreements(card, result, ["user_id", "day"], ["value"])


@query("feed_key_diff", f"""WITH {_FEEDS_SQL}
SELECT user_id, day, 'left' AS side FROM card ANTI JOIN result USING (user_id, day)
UNION ALL SELECT user_id, day, 'right' AS side FROM result ANTI JOIN card USING (user_id, day)""")
def feed_key_diff(spark, sf):
    return merge.key_differences(*_feeds(spark, sf), ["user_id", "day"])


@query("upsert_coalesce", """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
old AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(event_id, event_id) AS seen,
    bool_or(value > 100) AS big FROM e WHERE day < DATE '2024-01-16' GROUP BY ALL),
fresh AS (SELECT user_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id END AS seen, value > 100 AS big, event_id FROM e WHERE day >= DATE '2024-01-16'),
n AS (SELECT user_id, event_type, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value,
    arg_max_null(seen, event_id) AS seen, bool_or(big) AS big FROM fresh GROUP BY ALL)
SELECT user_id, event_type, coalesce(n.value, o.value) AS value,
  CASE WHEN n.user_id IS NOT NULL THEN n.seen ELSE o.seen END AS seen,
  coalesce(n.big, false) OR coalesce(o.big, false) AS big
FROM old o FULL JOIN n USING (user_id, event_type)""")
def upsert_coalesce(spark, sf):
    rows = events(spark, sf)
    cut = F.lit("2024-01-16").cast("date")
    stored = rows.filter(F.col("day") < cut).groupBy("user_id", "event_type").agg(
        F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("seen"),
        F.bool_or(F.col("value") > 100).alias("big"),
    )
    fresh = rows.filter(F.col("day") >= cut).select(
        "user_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 2 != 0, F.col("event_id")).alias("seen"),
        (F.col("value") > 100).alias("big"), "event_id",
    )
    return merge.keyed_merge(
        stored, fresh, ["user_id", "event_type"], order=["event_id"], replace=["seen"], either=["big"]
    )


@query("aligned_union", """SELECT event_id, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-25'
UNION ALL SELECT event_id, user_id, NULL AS event_type, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-25'""")
def aligned_union(spark, sf):
    rows = read(spark, sf, "events")
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    history = rows.filter(F.col("ts") < cut).select("event_id", "user_id", "event_type", "value")
    extra = rows.filter(F.col("ts") >= cut).select(
        F.lit("x").alias("unused"), F.col("value").cast("float").alias("value"), "user_id", "event_id"
    )
    return merge.aligned_union(history, extra)


_ASOF_SQL = """SELECT p.event_id, p.user_id, s.event_id AS signup_id, s.value AS signup_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s
ON p.user_id = s.user_id AND p.ts >= s.ts"""


def _asof(spark, sf, rows=None, **options):
    rows = read(spark, sf, "events") if rows is None else rows
    purchases = rows.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    signups = rows.filter(F.col("event_type") == "signup").select(
        "user_id", "ts", F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value")
    )
    joined = asof_join(
        purchases, signups, ["user_id"], "ts", "ts", ["signup_id", "signup_value"], **options
    )
    return joined.drop("ts")


@query("asof_join", _ASOF_SQL)
def asof(spark, sf):
    return _asof(spark, sf)


@query("asof_join_chunked", _ASOF_SQL)
def asof_chunked(spark, sf):
    """The same join with every key above 5 rows cut into chunks."""
    return _asof(spark, sf, hot_rows=5)


_HOLES = "SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN ts END AS ts) FROM events"
_ASOF_NULL_SQL = f"""WITH e AS ({_HOLES})
SELECT p.event_id, p.user_id, s.event_id AS signup_id, s.value AS signup_value
FROM (SELECT * FROM e WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup' AND ts IS NOT NULL) s
ON p.user_id = s.user_id AND p.ts >= s.ts"""
_NULL_ORDER_SQL = f"""WITH e AS ({_HOLES})
SELECT event_id, user_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before FROM e"""


def _holes(spark, sf):
    """Events of which every seventh has no instant."""
    return read(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))


def _null_order(spark, sf, **options):
    rows = _holes(spark, sf).withColumns(
        {"day": F.to_date("ts"), "minute": F.date_trunc("minute", "ts")})
    before = Family((), (Measure("before", F.col("event_id")),))
    return running(rows, ["user_id"], [before], ["ts", "event_id"], [["day"], ["minute"]],
                   **options).select("event_id", "user_id", "before")


@query("asof_join_null_ts", _ASOF_NULL_SQL)
def asof_null(spark, sf):
    return _asof(spark, sf, rows=_holes(spark, sf))


@query("asof_join_null_ts_chunked", _ASOF_NULL_SQL)
def asof_null_chunked(spark, sf):
    return _asof(spark, sf, rows=_holes(spark, sf), hot_rows=5)


@query("prior_counts_null_order", _NULL_ORDER_SQL)
def null_order(spark, sf):
    return _null_order(spark, sf)


@query("prior_counts_null_order_chunked", _NULL_ORDER_SQL)
def null_order_chunked(spark, sf):
    return _null_order(spark, sf, hot_rows=5)


# --- logs ---------------------------------------------------------------------


@query("log_explode_latest", """SELECT user_id, event_type, k AS combination, arg_max(v, event_id) AS price
FROM (SELECT *, unnest(json_keys(props)) AS k, CAST(props->>'k' AS DOUBLE) AS v FROM events) GROUP BY ALL""")
def log_explode_latest(spark, sf):
    rows = read(spark, sf, "events").select(
        "event_id", "user_id", "event_type",
        F.explode(F.from_json("props", "MAP<STRING, DOUBLE>")).alias("combination", "price"),
    )
    return merge.latest_by(
        rows, ["user_id", "event_type", "combination"], ["event_id"]
    ).drop("event_id")


@query("dedupe_by_key", """SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_max(event_id, row(value, event_id)) AS event_id,
  max(value) AS value FROM events GROUP BY ALL""")
def dedupe_by_key(spark, sf):
    rows = events(spark, sf).select("user_id", "event_type", "day", "event_id", "value")
    return merge.latest_by(rows, ["user_id", "event_type", "day"], ["value", "event_id"])


_KEY_SQL = "concat(strftime(ts, '%Y-%m-%d'), '/', lpad(CAST(user_id % 24 AS VARCHAR), 2, '0'), '/', event_id)"


def _keyed(spark, sf):
    key = race_key_text(F.col("ts"), F.col("user_id") % 24, F.col("event_id"))
    return read(spark, sf, "events").withColumn("k", key)


@query("resume_todo", f"""WITH r AS (SELECT {_KEY_SQL} AS k, event_type FROM events)
SELECT k FROM r WHERE k NOT IN (SELECT k FROM r WHERE event_type IN ('error', 'view'))
ORDER BY md5(concat(k, '#20240101')), k LIMIT 500""")
def resume_todo(spark, sf):
    rows = _keyed(spark, sf)
    logs = [rows.filter(F.col("event_type") == t) for t in ("error", "view")]
    todo = merge.not_recorded(rows.select("k"), merge.union_keys(logs, ["k"]), ["k"])
    return merge.shuffled_prefix(todo, "k", 500)


@query("hash_order_sample", """SELECT k FROM (SELECT concat(strftime(o_orderdate, '%Y-%m-%d'), '/', lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), '/', o_orderkey) AS k
  FROM orders JOIN customer ON c_custkey = o_custkey)
ORDER BY md5(concat(k, '#20240101')), k LIMIT 1000""")
def hash_order_sample(spark, sf):
    orders = read(spark, sf, "orders").join(
        read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    keyed = orders.select(
        race_key_text(F.col("o_orderdate"), F.col("c_nationkey"), F.col("o_orderkey")).alias("k")
    )
    return merge.shuffled_prefix(keyed, "k", 1000)


@query("coverage_by_month", """SELECT CAST(month(o_orderdate) AS INT) AS month, count(*) AS races
FROM (SELECT DISTINCT o_orderdate, o_custkey FROM orders) GROUP BY 1""")
def coverage_by_month(spark, sf):
    groups = read(spark, sf, "orders").select("o_orderdate", "o_custkey").distinct()
    return groups.groupBy(F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("races")
    ).orderBy("month")


_CARRY_SQL = """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations"""


def _carry(spark, sf, **options):
    turns = read(spark, sf, "conversations").withColumn("block", F.floor(F.col("turn") / 4))
    said = {"header": F.when(F.col("role") == "user", F.col("text"))}
    out = carry_forward(turns, ["conv_id"], ["turn"], said, [["block"]], **options)
    return out.select("conv_id", "turn", "role", "header")


@query("carry_forward_header", _CARRY_SQL)
def carry_forward_header(spark, sf):
    return _carry(spark, sf)


@query("carry_forward_chunked", _CARRY_SQL)
def carry_forward_chunked(spark, sf):
    """The same with conversations of more than 3 turns cut into blocks."""
    return _carry(spark, sf, hot_rows=3)


# --- checks -------------------------------------------------------------------


@query("missing_child_anti", """SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey""")
def missing_child_anti(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.missing_children(read(spark, sf, "orders"), lines, ["o_orderkey"])


@query("bad_group_sizes", """SELECT o_orderkey, count(l_orderkey) AS entry_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 6""")
def bad_group_sizes(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.bad_group_sizes(read(spark, sf, "orders"), lines, ["o_orderkey"], 6)


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("podium_reconcile", f"""WITH {DIVIDENDS_SQL}
SELECT race_no, concat_ws('-', a, b, c) AS expected, d.combination AS paid
FROM podium LEFT JOIN (SELECT race_no, CASE WHEN race_no % 50 = 0 THEN '9-9-9' ELSE combination END AS combination
  FROM dividends WHERE race_no % 40 <> 0) d USING (race_no)
WHERE concat_ws('-', a, b, c) IS DISTINCT FROM d.combination""")
def podium_reconcile(spark, sf):
    """Some dividends are spoilt or left out on purpose, so that there is something to find."""
    number = F.col("race_no")
    paid = load_dividends(payouts(spark, sf)).filter(number % 40 != 0).withColumn(
        "combination", F.when(number % 50 == 0, "9-9-9").otherwise(F.col("combination"))
    )
    return quality.podium_mismatches(members(spark, sf), paid, RACE_KEYS).select(
        "race_no", "expected", "paid"
    )


_RULES = {
    "venue_range": ("stadium_id BETWEEN 1 AND 24", "stadium_id", (1, 24)),
    "lane_range": ("lane BETWEEN 1 AND 6", "lane", (1, 6)),
    "course_range": ("course BETWEEN 1 AND 6", "course", (1, 6)),
    "finish_range": ("finish_position BETWEEN 1 AND 6", "finish_position", (1, 6)),
    "wind_range": ("wind_speed_m BETWEEN 0 AND 9", "wind_speed_m", (0, 9)),
    "wave_range": ("wave_height_cm BETWEEN 0 AND 7", "wave_height_cm", (0, 7)),
    "distance_range": ("distance_m BETWEEN 800 AND 1500", "distance_m", (800, 1500)),
    "exhibition_band": ("exhibition_time BETWEEN 6.5e0 AND 7.0e0", "exhibition_time", (6.5, 7.0)),
}


@query("constraint_report", f"WITH {MEMBERS_SQL}\n" + "\nUNION ALL ".join(
    [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT ({r[0]})) AS violations, count(*) AS rows FROM members" for n, r in _RULES.items()]
    + ["SELECT 'grade_known' AS rule, count(*) FILTER (WHERE grade NOT IN ('A1','A2','B1')) AS violations, count(*) AS rows FROM members"]))
def constraint_report(spark, sf):
    rules = {n: F.col(c).between(*band) for n, (_, c, band) in _RULES.items()}
    rules["grade_known"] = F.col("grade").isin(*GRADES[:3])
    return quality.constraint_report(members_in_passing(spark, sf), rules)


_NULLABLE = ["course", "finish_position", "start_timing", "grade", "weather", "wind_direction",
             "wind_speed_m", "wave_height_cm", "deadline_time", "lane"]


@query("null_share", f"WITH {MEMBERS_SQL}\nSELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS null_share FROM members"
    for c in _NULLABLE) + ") WHERE null_share > 0.01")
def null_share(spark, sf):
    return quality.null_share(members(spark, sf), _NULLABLE, above=0.01).select(
        "column", *_r("null_share")
    )


@query("yearly_consistency", f"""WITH {MEMBERS_SQL}
SELECT CAST(year(race_date) AS INT) AS year, count(DISTINCT race_no) AS races, count(*) AS entries,
  count(course) AS with_course, count(finish_position) AS with_finish,
  count(*) FILTER (WHERE course <> lane) AS course_differs,
  count(*) FILTER (WHERE finish_position = 1 AND course = 1) AS course1_wins,
  count(*) FILTER (WHERE finish_position = 1) AS winners,
  round(count(*) / count(DISTINCT race_no), 6) AS boats_per_race,
  round(count(*) FILTER (WHERE finish_position = 1 AND course = 1) / count(*) FILTER (WHERE finish_position = 1), 6) AS course1_win_rate,
  round(count(*) FILTER (WHERE course <> lane) / count(course), 6) AS course_differs_share
FROM members GROUP BY 1""")
def yearly_consistency(spark, sf):
    table = quality.yearly_consistency(members(spark, sf), RACE_KEYS)
    rates = ("boats_per_race", "course1_win_rate", "course_differs_share")
    return table.select(*[c for c in table.columns if c not in rates], *_r(*rates))


def _groups(spark, sf, *more):
    orders = read(spark, sf, "orders").join(
        read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return orders.select(
        F.to_date("o_orderdate").alias("race_date"), F.col("c_nationkey").alias("stadium_id"),
        F.col("o_orderkey").alias("race_no"), *more,
    )


@query("yearly_summary_view", f"""WITH {MEMBERS_SQL}
SELECT CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT o_orderkey) AS races, count(lane) AS entries,
  count(course) AS entries_with_course, count(finish_position) AS entries_with_finish,
  round(100.0e0 * count(*) FILTER (WHERE course IS NOT NULL AND course <> lane) / nullif(count(course), 0), 2) AS course_differs_pct,
  round(avg(course) FILTER (WHERE finish_position = 1), 3) AS avg_winning_course
FROM orders LEFT JOIN members ON race_no = o_orderkey GROUP BY 1""")
def yearly_summary_view(spark, sf):
    return quality.yearly_summary(_groups(spark, sf), members(spark, sf), RACE_KEYS)


@query("conditional_rate_by_year", f"""WITH {MEMBERS_SQL}
SELECT CAST(year(race_date) AS INT) AS year, count(*) AS races_with_winner,
  round(avg(CASE WHEN course = 1 THEN 1 ELSE 0 END), 4) AS course1_win_rate
FROM members WHERE finish_position = 1 AND course IS NOT NULL GROUP BY 1""")
def conditional_rate_by_year(spark, sf):
    return quality.first_course_rate(members(spark, sf))


@query("group_permutation_check", f"""WITH {MEMBERS_SQL}
SELECT race_no, count(c) AS filled, count(DISTINCT c) AS "distinct",
  count(DISTINCT c) FILTER (WHERE c NOT BETWEEN 1 AND 6) AS outside
FROM (SELECT race_no, CASE WHEN race_no % 20 = 0 THEN (course + 1) // 2 ELSE course END AS c FROM members)
GROUP BY race_no HAVING count(c) <> count(DISTINCT c) OR count(DISTINCT c) FILTER (WHERE c NOT BETWEEN 1 AND 6) > 0""")
def group_permutation_check(spark, sf):
    """Every twentieth group gets repeated values on purpose."""
    spoilt = members(spark, sf).withColumn(
        "course",
        F.when(F.col("race_no") % 20 == 0, F.floor((F.col("course") + 1) / 2)).otherwise(F.col("course")),
    )
    return quality.permutation_violations(spoilt, RACE_KEYS, "course", 1, 6).select(
        "race_no", "filled", "distinct", "outside"
    )


@query("type_completeness", """SELECT l_orderkey, concat_ws(',', CASE WHEN NOT bool_or(l_returnflag = 'A') THEN 'A' END,
  CASE WHEN NOT bool_or(l_returnflag = 'N') THEN 'N' END, CASE WHEN NOT bool_or(l_returnflag = 'R') THEN 'R' END) AS missing
FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) < 3""")
def type_completeness(spark, sf):
    return quality.missing_types(
        read(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"]
    )


@query("monotone_check", """SELECT event_id, user_id FROM (
  SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous > value""")
def monotone_check(spark, sf):
    rows = read(spark, sf, "events").withColumn("block", F.floor(F.col("event_id") / 4096))
    return quality.decreasing_steps(rows, ["user_id"], "event_id", "value", [["block"]]).select(
        "event_id", "user_id"
    )


@query("validation_suite", f"""WITH {MEMBERS_SQL}
SELECT 'groups not of six' AS "check", count(*) AS metric, true AS hard, count(*) = 0 AS passed
FROM (SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 6)
UNION ALL SELECT 'repeated members', 0, true, true
UNION ALL SELECT 'no course', count(*), false, true FROM members WHERE course IS NULL
UNION ALL SELECT 'course is not lane', count(*), false, true FROM members WHERE course <> lane""")
def validation_suite(spark, sf):
    rows = members(spark, sf)
    checks = {
        "groups not of six": quality.bad_group_sizes(_groups(spark, sf), rows, RACE_KEYS, 6),
        "repeated members": quality.duplicate_keys(rows, [*RACE_KEYS, "lane"]),
        "no course": rows.filter(F.col("course").isNull()),
        "course is not lane": rows.filter(F.col("course") != F.col("lane")),
    }
    return quality.validation_suite(checks, hard=("groups not of six", "repeated members"))


_ROW_RULES = {**{n: r for t in ("venues", "races", "entries") for n, r in rules.ROW_RULES[t].items()},
              **{n: r for n, r in rules.PLAUSIBLE.items() if n != "race_time"}}


@query("row_rules", f"WITH {MEMBERS_SQL}\n" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT ({r})) AS violations, count(*) AS rows FROM members" for n, r in _ROW_RULES.items()))
def row_rules(spark, sf):
    """The library's rules and bands; numbers of races here go far beyond 12."""
    return rules.check_rows(members(spark, sf), _ROW_RULES)


@query("validations", f"""WITH {MEMBERS_SQL}, {DIVIDENDS_ONLY_SQL},
g AS (SELECT o_orderkey AS race_no, c_nationkey AS venue, year(o_orderdate) AS y, o_orderstatus <> 'P' AS has_k
      FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'races' AS "check", count(*) AS metric, false AS hard, true AS passed FROM g
UNION ALL SELECT 'entries', count(*), false, true FROM members
UNION ALL SELECT 'groups not of six', count(*), true, count(*) = 0
FROM (SELECT g.race_no FROM g LEFT JOIN lineitem ON l_orderkey = g.race_no GROUP BY 1 HAVING count(l_orderkey) <> 6)
UNION ALL SELECT 'no course', count(*), false, true FROM members WHERE course IS NULL
UNION ALL SELECT 'course is not lane', count(*), false, true FROM members WHERE course <> lane
UNION ALL SELECT 'results without trifecta', count(*), true, count(*) = 0
FROM g WHERE has_k AND race_no NOT IN (SELECT race_no FROM dividends)
UNION ALL SELECT 'venues', count(DISTINCT venue), false, true FROM g
UNION ALL SELECT 'payout types', count(DISTINCT bet_type), false, true FROM payouts
UNION ALL SELECT 'summary years', count(DISTINCT y), false, true FROM g
UNION ALL SELECT 'course 1 years', count(DISTINCT year(race_date)), false, true FROM members WHERE finish_position = 1 AND course IS NOT NULL""")
def validations(spark, sf):
    races = _groups(spark, sf, (F.col("o_orderstatus") != "P").alias("has_k"))
    return rules.validations(races, members_in_passing(spark, sf), payouts(spark, sf))


_OUTCOMES_SQL = """o AS (SELECT o_orderkey AS source, CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderstatus = 'P' AND year(o_orderdate) = 1997 THEN 7 ELSE 10 END AS records_ok,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderstatus = 'P' AND year(o_orderdate) = 1997 THEN 3 ELSE 0 END AS records_failed,
  CASE WHEN o_orderkey % 97 = 0 THEN 'unreadable' END AS fatal FROM orders)"""


def outcomes(spark, sf):
    """Orders seen as parsed files; 1997 has a layout change."""
    key, dead = F.col("o_orderkey"), F.col("o_orderkey") % 97 == 0
    changed = (F.col("o_orderstatus") == "P") & (F.year("o_orderdate") == 1997)
    return read(spark, sf, "orders").select(
        F.lpad(key.cast("string"), 12, "0").alias("source"),
        F.when(key % 101 != 0, F.to_date("o_orderdate")).alias("day"),
        F.when(dead, 0).when(changed, 7).otherwise(10).cast("long").alias("records_ok"),
        F.when(dead, 0).when(changed, 3).otherwise(0).cast("long").alias("records_failed"),
        F.when(dead, "unreadable").alias("fatal"),
        F.when(changed & ~dead, F.array(F.lit("bad row"))).alias("samples"),
    )


_RATES_SQL = """count(*) AS files, count(fatal) AS files_fatal, CAST(sum(records_ok) AS BIGINT) AS records_ok, CAST(sum(records_failed) AS BIGINT) AS records_failed,
  round(coalesce(sum(records_ok) / nullif(sum(records_ok + records_failed), 0), 1), 6) AS record_success_rate,
  round((count(*) - count(fatal)) / count(*), 6) AS file_success_rate"""


@query("parse_stats_by_year", f"""WITH {_OUTCOMES_SQL}
SELECT CAST(year(day) AS INT) AS year, false AS is_total, {_RATES_SQL} FROM o GROUP BY year(day)
UNION ALL SELECT NULL, true, {_RATES_SQL} FROM o""")
def parse_stats(spark, sf):
    table = quality.parse_stats_by_year(outcomes(spark, sf))
    rates = ("record_success_rate", "file_success_rate")
    return table.select(*[c for c in table.columns if c not in rates], *_r(*rates))


@query("parse_samples", f"""WITH {_OUTCOMES_SQL}
SELECT CAST(year AS INT) AS year, CAST(place AS INT) AS place, sample FROM (
  SELECT year(day) AS year, row_number() OVER (PARTITION BY year(day) ORDER BY source) AS place,
    concat(lpad(CAST(source AS VARCHAR), 12, '0'), ': ', coalesce(fatal, 'bad row')) AS sample
  FROM o WHERE fatal IS NOT NULL OR records_failed > 0) WHERE place <= 5""")
def parse_samples(spark, sf):
    return quality.parse_samples(outcomes(spark, sf))


@query("layout_suspects", f"""WITH {_OUTCOMES_SQL},
y AS (SELECT year(day) AS year, sum(records_ok) / sum(records_ok + records_failed) AS r FROM o GROUP BY 1 HAVING sum(records_ok + records_failed) > 0)
SELECT CAST(year AS INT) AS year, round(r, 6) AS record_success_rate, r = (SELECT min(r) FROM y) AS is_worst FROM y WHERE r < 0.99 OR r = (SELECT min(r) FROM y)""")
def layout_suspects(spark, sf):
    return quality.layout_suspects(outcomes(spark, sf)).select(
        "year", *_r("record_success_rate"), "is_worst"
    )


@query("worst_year", f"""WITH {_OUTCOMES_SQL},
y AS (SELECT year(day) AS year, sum(records_ok) / sum(records_ok + records_failed) AS r FROM o GROUP BY 1 HAVING sum(records_ok + records_failed) > 0)
SELECT CAST(year AS INT) AS year, round(r, 6) AS record_success_rate, true AS is_worst FROM y ORDER BY r, year LIMIT 1""")
def worst_year(spark, sf):
    """The worst year is reported even where every year passes."""
    return quality.layout_suspects(outcomes(spark, sf), threshold=0.0).select(
        "year", *_r("record_success_rate"), "is_worst"
    )


@query("status_rollup", """SELECT count(*) AS attempted, count(*) FILTER (WHERE event_type = 'purchase') AS downloaded,
  count(*) FILTER (WHERE event_type = 'view') AS skipped, count(*) FILTER (WHERE event_type = 'click') AS missing,
  count(*) FILTER (WHERE event_type = 'signup') AS known_missing, count(*) FILTER (WHERE event_type = 'error') AS errors,
  round(count(*) FILTER (WHERE event_type IN ('purchase', 'view')) / count(*) FILTER (WHERE event_type IN ('purchase', 'view', 'error')), 6) AS success_rate
FROM events""")
def status_rollup(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in (
        ("purchase", "downloaded"), ("view", "skipped"), ("click", "missing"),
        ("signup", "known_missing"), ("error", "error")) for x in pair])
    log = read(spark, sf, "events").select(names[F.col("event_type")].alias("status"))
    table = quality.status_rollup(log)
    return table.select(*table.columns[:-1], *_r("success_rate"))


@query("resolve_dimension", """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE n_nationkey END AS stadium_id
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def resolve_dimension(spark, sf):
    """Venue names with the usual decorations, codes, and some nobody knows."""
    nation = read(spark, sf, "nation")
    customer = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name, key = F.col("n_name"), F.col("c_custkey")
    asked = customer.select(
        "c_custkey",
        F.when(key % 9 == 0, "nowhere")
        .when(key % 4 == 1, F.concat(F.lit("ボートレース"), name))
        .when(key % 4 == 2, F.concat(name, F.lit("競艇場")))
        .when(key % 4 == 3, F.col("n_nationkey").cast("string"))
        .otherwise(F.concat(F.lit(" "), name)).alias("asked"),
    )
    known = nation.select(F.col("n_nationkey").alias("stadium_id"), F.col("n_name").alias("name"))
    return resolve_names(asked, "asked", known).select("c_custkey", "stadium_id")

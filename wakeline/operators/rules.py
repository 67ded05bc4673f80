"""The named rules and validations of the merged tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators import quality
from wakeline.schema import MEMBERS_PER_GROUP, RACE_KEYS

# --- fixed values: what stored rows must satisfy, by table; an unknown result passes ---
ROW_RULES = {
    "venues": {"venue_id": "stadium_id BETWEEN 1 AND 24"},
    "races": {
        "race_number": "race_no BETWEEN 1 AND 12",
        "distance": "distance_m BETWEEN 800 AND 3000",
        "wind_speed": "wind_speed_m BETWEEN 0 AND 30",
        "wave_height": "wave_height_cm BETWEEN 0 AND 100",
    },
    "entries": {
        "lane": "lane BETWEEN 1 AND 6",
        "course": "course BETWEEN 1 AND 6",
        "grade": "grade IN ('A1', 'A2', 'B1', 'B2')",
        "finish": "finish_position BETWEEN 1 AND 6",
    },
    "payouts": {
        "bet_type": "bet_type IN ('win', 'place', 'exacta', 'quinella', 'wide', 'trifecta', 'trio')",
        "payout": "payout_yen >= 0",
    },
    "periods": {"half": "period_half IN (1, 2)"},
    "ingest_log": {"kind": "kind IN ('B', 'K', 'fan')"},
}
#: Bands outside which a value was probably cut from the wrong bytes.
PLAUSIBLE = {
    "national_win_rate": "national_win_rate BETWEEN 0 AND 10",
    "national_top2_rate": "national_top2_rate BETWEEN 0 AND 100",
    "motor_top2_rate": "motor_top2_rate BETWEEN 0 AND 100",
    "known_distance": "distance_m IN (600, 1200, 1800, 2600, 3000)",
    "start_timing": "start_timing > -1.0e0 AND start_timing < 2.0e0",
    "race_time": "race_time_sec > 90 AND race_time_sec < 180",
}
#: Rows of one type a paid group must have, at least and at most.
TYPE_COUNTS = {"wide": (3, 3), "place": (1, 2)}
HARD = ("groups not of six", "results without trifecta")
# --- end of fixed values ---------------------------------------------------------------


def check_rows(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Violations of each rule whose columns ``df`` has, in one pass."""
    return quality.constraint_report(df, {name: F.expr(rule) for name, rule in rules.items()})


def type_counts(payouts: DataFrame, counts: dict[str, tuple[int, int]] = TYPE_COUNTS) -> DataFrame:
    """Paid groups with too few or too many rows of a type."""
    types = list(counts)
    found = payouts.groupBy(*RACE_KEYS).agg(*[
        F.count_if(F.col("bet_type") == t).alias(t) for t in types])
    rows = F.inline(F.array(*[F.struct(
        F.lit(t).alias("bet_type"), F.col(t).alias("rows"),
        (~F.col(t).between(*counts[t])).alias("wrong")) for t in types]))
    return found.select(*RACE_KEYS, rows).filter("wrong").drop("wrong")


def validations(races: DataFrame, entries: DataFrame, payouts: DataFrame) -> DataFrame:
    """The nine validations as rows (check, metric, hard, passed); hard ones must count 0."""
    course = F.col("course")
    sums = {
        "races": F.lit(1), "with_result": F.coalesce(F.col("has_k").cast("int"), F.lit(0)),
    }
    held = races.select(*RACE_KEYS, *[c.alias(n) for n, c in sums.items()])
    # members are read once and are one row per group before they meet the races
    counts = {
        "entries": F.count(F.lit(1)), "no_course": F.count_if(course.isNull()),
        "differs": F.count_if(course != F.col("lane")),
        "winners": F.count_if((F.col("finish_position") == 1) & course.isNotNull()),
    }
    sizes = entries.groupBy(*RACE_KEYS).agg(*[c.alias(n) for n, c in counts.items()])
    paid = payouts.filter(F.col("bet_type") == "trifecta").select(*RACE_KEYS, F.lit(1).alias("paid"))
    names = [*sums, *counts, "paid"]
    groups = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [held, sizes, paid]).groupBy(
        *RACE_KEYS).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    # a key that holds a NULL meets nothing
    named = reduce(and_, [F.col(k).isNotNull() for k in RACE_KEYS])
    groups = groups.withColumns({
        "wrong_size": F.when(named & (F.col("entries") == MEMBERS_PER_GROUP), 0).otherwise(F.col("races")),
        "unpaid": F.when(named & (F.col("paid") > 0), 0).otherwise(F.col("with_result")),
    })
    totals = ["races", "entries", "no_course", "differs", "winners", "wrong_size", "unpaid"]
    yearly = groups.groupBy(F.year("race_date").alias("year"), "stadium_id").agg(*[F.sum(n).alias(n) for n in totals])

    def kinds(column: str, where: str) -> Column:
        """Distinct values, NULL being one."""
        return F.count_distinct(F.when(F.col(where) > 0, F.struct(column)))

    def count(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    metrics = {
        "races": count("races"), "entries": count("entries"), "groups not of six": count("wrong_size"),
        "no course": count("no_course"), "course is not lane": count("differs"),
        "results without trifecta": count("unpaid"), "venues": kinds("stadium_id", "races"),
        "summary years": kinds("year", "races"), "course 1 years": kinds("year", "winners"),
    }
    row = yearly.agg(*[c.alias(n) for n, c in metrics.items()])
    found = row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").cast("long").alias("metric"), F.lit(n in HARD).alias("hard"))
        for n in metrics])))
    types = quality.validation_suite({"payout types": payouts.select("bet_type").distinct()})
    return found.withColumn("passed", ~F.col("hard") | (F.col("metric") == 0)).unionByName(types)

"""Checks on keys, rows and leaks. Checks return tables; guards raise."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.history import Rate
from wakeline.operators.prefix import HOT_ROWS, Family, Measure, running
from wakeline.schema import ORDER_KEYS
from wakeline.session import staged


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Raise when a key repeats, so that a later join cannot add rows. Runs one job."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{what}: more than one row for key {found[0].asDict()}")
    return df


def assert_rows(df: DataFrame, holds: Column, keys: Sequence[str], what: str) -> DataFrame:
    """Rows that stop the job that reads them where ``holds`` is false. Moves no row, runs no job."""
    named = F.concat(F.lit(f"{what} "), F.to_json(F.struct(*keys)))
    # a filter stays whichever columns are read later
    return df.filter(F.when(holds, True).otherwise(F.raise_error(named).cast("boolean")))


def history_differences(
    build: Callable[[DataFrame, Sequence[Rate]], DataFrame],
    df: DataFrame,
    rates: Sequence[Rate],
    day_column: str,
    cutoff,
    tampered: dict[str, Column],
    labels: Callable[[DataFrame], DataFrame],
    *,
    reads: Sequence[str] = (*ORDER_KEYS, "race_date"),
    digits: int = 9,
) -> DataFrame:
    """Leak proof of a history build in one run: how many rows before ``cutoff`` change.

    Rows from ``cutoff`` on are altered by ``tampered``, and ``labels`` derives the values of the
    rates from either. Both values lie in one row and each rate is built twice under two names, so
    the rows go through the build's shuffles once and are compared where they are. ``build`` gives
    ``{name}_rate`` and, if it likes, ``{name}_n`` and ``{name}_raw`` of each rate it is handed. It sees
    the columns of ``reads``, the keys and the values, which are written once.
    """
    late = F.col(day_column) >= F.lit(cutoff)
    values = list(dict.fromkeys(r.value for r in rates))
    changed = labels(df.withColumns({c: F.when(late, v).otherwise(F.col(c)) for c, v in tampered.items()}
                                    | {f"_true_{c}": F.col(c) for c in tampered}))
    altered = changed.withColumns({f"_late_{v}": F.col(v) for v in values})
    both = labels(altered.withColumns({c: F.col(f"_true_{c}") for c in tampered}))
    seen = [*reads, day_column, *(k for r in rates for k in r.group), *values, *(f"_late_{v}" for v in values)]
    both = staged(both.select(*dict.fromkeys(seen)), "scenarios")
    twice = [*rates, *(replace(r, name=f"_late_{r.name}", value=f"_late_{r.value}") for r in rates)]
    built = build(both, twice)

    def same(c: str) -> Column:
        a, b = F.col(c), F.col(f"_late_{c}")
        return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < 10.0 ** -digits, F.lit(False))

    pairs = [f"{r.name}{s}" for r in rates for s in ("_n", "_rate", "_raw") if f"{r.name}{s}" in built.columns]
    early = built.filter(F.col(day_column) < F.lit(cutoff))
    return early.agg(F.count(F.lit(1)).alias("rows_compared"), F.count_if(~reduce(and_, map(same, pairs))).alias("rows_changed"))


def point_in_time_violations(
    build: Callable[[DataFrame], DataFrame],
    df: DataFrame,
    keys: Sequence[str],
    day_column: str,
    cutoff,
    tampered: dict[str, Column],
    *,
    columns: Sequence[str] | None = None,
    digits: int = 9,
) -> DataFrame:
    """Rebuild with the rows from ``cutoff`` on altered and compare the earlier rows.

    One row: how many earlier rows were compared and how many differ in ``columns``
    (all, if not given). Rows are matched by key and content in one aggregate, so
    there is no join of the two builds.
    """
    late = F.col(day_column) >= F.lit(cutoff)
    changed = df.withColumns({c: F.when(late, v).otherwise(F.col(c)) for c, v in tampered.items()})

    def digest(frame: DataFrame, sign: int) -> DataFrame:
        built = build(frame).filter(F.col(day_column) < F.lit(cutoff))
        content = [
            F.round(F.col(f.name), digits) if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in built.schema.fields
            if columns is None or f.name in columns
        ]
        return built.select(*keys, F.xxhash64(*content).alias("_h"), F.lit(sign).alias("_sign"))

    both = digest(df, 1).unionByName(digest(changed, -1))
    per_key = both.groupBy(*keys, "_h").agg(
        F.sum("_sign").alias("_diff"), F.sum((F.col("_sign") > 0).cast("long")).alias("_kept")
    )
    return per_key.agg(
        F.coalesce(F.sum("_kept"), F.lit(0)).alias("rows_compared"),
        F.coalesce(F.sum((F.col("_diff") > 0).cast("long")), F.lit(0)).alias("rows_changed"),
    )


def assert_point_in_time(*args, **kwargs) -> None:
    row = point_in_time_violations(*args, **kwargs).first()
    if row["rows_changed"]:
        raise ValueError(f"{row['rows_changed']} earlier rows depend on later ones")


# ---------------------------------------------------------------------------
# Rows, groups and categories
# ---------------------------------------------------------------------------


def constraint_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass. As in SQL CHECKs, an unknown result passes."""
    broken = df.agg(
        *[F.count_if(~rule).alias(f"_{i}") for i, rule in enumerate(rules.values())],
        F.count(F.lit(1)).alias("_n"),
    )
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("violations"),
                 F.col("_n").alias("rows"))
        for i, name in enumerate(rules)
    ]
    return broken.select(F.inline(F.array(*rows)))


def null_share(df: DataFrame, columns: Sequence[str], above: float = 0.0) -> DataFrame:
    """Share of NULLs per column, largest first; columns up to ``above`` are left out."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("null_share")) for c in columns
    ]
    return (
        shares.select(F.inline(F.array(*rows)))
        .filter(F.col("null_share") > above)
        .orderBy(F.desc("null_share"), "column")
    )


def yearly_consistency(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and ratios per year; groups are totalled before they are counted."""
    course, lane, place = F.col("course"), F.col("lane"), F.col("finish_position")
    sums = {
        "with_course": course.isNotNull(),
        "with_finish": place.isNotNull(),
        "course_differs": course != lane,
        "course1_wins": (place == 1) & (course == 1),
        "winners": place == 1,
    }
    per_group = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), *[F.count_if(c).alias(n) for n, c in sums.items()]
    )
    return (
        per_group.groupBy(F.year("race_date").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("races"),
            *[F.sum(n).alias(n) for n in ("entries", *sums)],
        )
        .withColumns(
            {
                "boats_per_race": F.try_divide(F.col("entries").cast("double"), "races"),
                "course1_win_rate": F.try_divide(F.col("course1_wins").cast("double"), "winners"),
                "course_differs_share": F.try_divide(
                    F.col("course_differs").cast("double"), "with_course"
                ),
            }
        )
    )


def yearly_summary(groups: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Like the consistency table, but from the group side: empty groups count."""
    course, lane, place = F.col("course"), F.col("lane"), F.col("finish_position")
    per_group = members.groupBy(*keys).agg(
        F.count("lane").alias("entries"),
        F.count("course").alias("entries_with_course"),
        F.count("finish_position").alias("entries_with_finish"),
        F.count_if(course != lane).alias("_differs"),
        F.sum(F.when(place == 1, course)).alias("_winning_course"),
        F.count(F.when(place == 1, course)).alias("_winners"),
    )
    counts = ["entries", "entries_with_course", "entries_with_finish"]
    return (
        groups.select(*keys)
        .join(per_group, list(keys), "left")
        .groupBy(F.year("race_date").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("races"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
            F.sum("_differs").alias("_differs"),
            F.sum("_winning_course").alias("_wc"),
            F.sum("_winners").alias("_w"),
        )
        .select(
            "year", "races", *counts,
            F.round(F.try_divide(F.col("_differs") * 100.0, "entries_with_course"), 2)
            .alias("course_differs_pct"),
            F.round(F.try_divide(F.col("_wc").cast("double"), "_w"), 3).alias("avg_winning_course"),
        )
    )


def first_course_rate(members: DataFrame) -> DataFrame:
    """Share of winners starting from course 1 per year."""
    won = members.filter((F.col("finish_position") == 1) & F.col("course").isNotNull())
    return won.groupBy(F.year("race_date").alias("year")).agg(
        F.count(F.lit(1)).alias("races_with_winner"),
        F.round(F.avg((F.col("course") == 1).cast("int")), 4).alias("course1_win_rate"),
    )


def bad_group_sizes(
    groups: DataFrame, members: DataFrame, keys: Sequence[str], size: int
) -> DataFrame:
    """Groups without exactly ``size`` members, those without any included."""
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("entry_count"))
    return (
        groups.select(*keys)
        .join(counts, list(keys), "left")
        .withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
        .filter(F.col("entry_count") != size)
    )


def missing_children(parents: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parents.join(children.select(*keys), list(keys), "left_anti").select(*keys)


def podium_mismatches(
    members: DataFrame, dividends: DataFrame, keys: Sequence[str], places: int = 3
) -> DataFrame:
    """Groups whose paid combination is not that of their first ``places`` members."""
    podium = members.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("finish_position") == i, F.col("lane"))).alias(f"_p{i}")
            for i in range(1, places + 1)
        ]
    )
    expected = F.concat_ws("-", *[F.col(f"_p{i}").cast("string") for i in range(1, places + 1)])
    whole = podium.dropna(subset=[f"_p{i}" for i in range(1, places + 1)])
    return (
        whole.select(*keys, expected.alias("expected"))
        .join(dividends.select(*keys, F.col("combination").alias("paid")), list(keys), "left")
        .filter(~F.col("expected").eqNullSafe(F.col("paid")))
    )


def permutation_violations(
    df: DataFrame, keys: Sequence[str], column: str, low: int, high: int
) -> DataFrame:
    """Groups where a non-null value repeats or leaves low..high."""
    per_value = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        per_value.groupBy(*keys)
        .agg(
            F.sum("_n").alias("filled"),
            F.count(F.lit(1)).alias("distinct"),
            F.count_if(~F.col(column).between(low, high)).alias("outside"),
        )
        .filter((F.col("filled") != F.col("distinct")) | (F.col("outside") > 0))
    )


def missing_types(
    df: DataFrame, keys: Sequence[str], column: str, types: Sequence[str]
) -> DataFrame:
    """Groups lacking some child type, with the types they lack."""
    seen = [F.bool_or(F.col(column).eqNullSafe(F.lit(t))).alias(f"_{i}") for i, t in enumerate(types)]
    lacking = F.array_compact(
        F.array(*[F.when(~F.col(f"_{i}"), F.lit(t)) for i, t in enumerate(types)])
    )
    return (
        df.groupBy(*keys)
        .agg(*seen)
        .select(*keys, F.array_join(lacking, ",").alias("missing"))
        .filter(F.col("missing") != "")
    )


def decreasing_steps(
    df: DataFrame,
    group: Sequence[str],
    index: str,
    value: str,
    levels: Sequence[Sequence[str]],
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows whose value is below the previous non-null one along the index."""
    before = Family((), (Measure("previous", F.col(value), "last"),))
    rows = running(df, group, [before], [index], levels, hot_rows=hot_rows)
    return rows.filter(F.col("previous") > F.col(value))


# ---------------------------------------------------------------------------
# Parse accounting
# ---------------------------------------------------------------------------

MAX_SAMPLES_PER_YEAR = 5


def _parse_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("files"),
        F.count("fatal").alias("files_fatal"),
        F.sum("records_ok").alias("records_ok"),
        F.sum("records_failed").alias("records_failed"),
    ]


def _parse_rates(df: DataFrame) -> DataFrame:
    total = F.col("records_ok") + F.col("records_failed")
    return df.withColumns(
        {
            "record_success_rate": F.coalesce(
                F.try_divide(F.col("records_ok").cast("double"), total), F.lit(1.0)
            ),
            "file_success_rate": F.coalesce(
                F.try_divide((F.col("files") - F.col("files_fatal")).cast("double"), "files"),
                F.lit(1.0),
            ),
        }
    )


def parse_stats_by_year(outcomes: DataFrame) -> DataFrame:
    """Per year and in total (``is_total``), files without a date under a NULL year."""
    dated = outcomes.withColumn("year", F.year("day"))
    rolled = dated.rollup("year").agg(F.grouping("year").alias("g"), *_parse_sums())
    return _parse_rates(rolled).select(
        "year", (F.col("g") == 1).alias("is_total"), "files", "files_fatal", "records_ok",
        "records_failed", "record_success_rate", "file_success_rate",
    ).orderBy("is_total", F.asc_nulls_last("year"))


def parse_samples(outcomes: DataFrame, kept: int = MAX_SAMPLES_PER_YEAR) -> DataFrame:
    """The first error texts per year.

    The row-number limit is applied in every task before the shuffle, so a year with
    millions of failures sends a handful of rows.
    """
    texts = outcomes.select(
        F.year("day").alias("year"), "source",
        F.posexplode(
            F.array_compact(F.concat(F.array("fatal"), F.coalesce("samples", F.array())))
        ).alias("n", "text"),
    )
    place = F.row_number().over(Window.partitionBy("year").orderBy("source", "n"))
    return (
        texts.withColumn("place", place)
        .filter(F.col("place") <= kept)
        .select("year", "place", F.concat("source", F.lit(": "), "text").alias("sample"))
    )


def layout_suspects(outcomes: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Years with records whose success rate is under the threshold, and the worst year anyway."""
    yearly = _parse_rates(outcomes.groupBy(F.year("day").alias("year")).agg(*_parse_sums()))
    dated = yearly.filter(F.col("records_ok") + F.col("records_failed") > 0)
    # one row per year
    worst = Window.partitionBy(F.lit(0)).orderBy("record_success_rate", "year")
    return (
        dated.withColumn("is_worst", F.row_number().over(worst) == 1)
        .filter((F.col("record_success_rate") < threshold) | F.col("is_worst"))
        .select("year", "record_success_rate", "is_worst")
    )


def status_rollup(log: DataFrame, status: str = "status") -> DataFrame:
    """Outcome counts and the success rate, which leaves out files known not to exist."""
    def n(*names: str) -> Column:
        return F.count_if(F.col(status).isin(*names))

    counted = log.agg(
        F.count(F.lit(1)).alias("attempted"),
        n("downloaded").alias("downloaded"),
        n("skipped").alias("skipped"),
        n("missing").alias("missing"),
        n("known_missing").alias("known_missing"),
        n("error").alias("errors"),
    )
    held = F.col("downloaded") + F.col("skipped")
    return counted.withColumn(
        "success_rate",
        F.coalesce(F.try_divide(held.cast("double"), held + F.col("errors")), F.lit(1.0)),
    )


def validation_suite(checks: dict[str, DataFrame], hard: Sequence[str] = ()) -> DataFrame:
    """Row count of each named check; hard checks pass only when empty."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("metric")).select(
            F.lit(name).alias("check"), "metric", F.lit(name in hard).alias("hard")
        )
        for name, df in checks.items()
    ]
    return reduce(DataFrame.unionByName, counted).withColumn(
        "passed", ~F.col("hard") | (F.col("metric") == 0)
    )

"""Point-in-time history: what was known about a key before each row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.prefix import (
    HOT_ROWS,
    Family,
    Measure,
    chunk_depths,
    running,
    running_strict,
)
from wakeline.schema import (
    COURSE_SHRINKAGE,
    MIN_PRIOR_OBSERVATIONS,
    MOTOR_SHRINKAGE,
    ORDER_KEYS,
    RACER_SHRINKAGE,
)

#: Day, then blocks of groups inside a day that is itself hot.
EVENT_LEVELS = [["race_date"], ["race_ts", "stadium_id", "race_block"]]
INSTANT_LEVELS = [["race_date"], ["race_ts"]]
GROUPS_PER_BLOCK = 4096


@dataclass(frozen=True)
class Rate:
    """A prior mean of column ``value`` per ``group``, shrunk with weight ``k``.

    ``anchor`` (a prefix of ``group``) decides the shuffle key; rates with the same
    anchor share one.
    """

    name: str
    value: str
    group: tuple[str, ...]
    k: float
    anchor: tuple[str, ...]


_RACER = ("racer_id",)
#: Venues are few: cut by day together with the overall means, they need few carry rows and no
#: shuffle of their own, and no venue ends up in one task.
_VENUE = ()

DEPLOYABLE_RATES = (
    Rate("racer_win", "won", _RACER, RACER_SHRINKAGE, _RACER),
    Rate("racer_top2", "top2", _RACER, RACER_SHRINKAGE, _RACER),
    Rate("racer_st", "start_timing", _RACER, RACER_SHRINKAGE, _RACER),
    Rate("racer_course_gain", "course_gain", _RACER, COURSE_SHRINKAGE, _RACER),
    Rate("racer_goes_inside", "goes_inside", _RACER, COURSE_SHRINKAGE, _RACER),
    Rate("racer_lane_win", "won", ("racer_id", "lane"), COURSE_SHRINKAGE, _RACER),
    Rate("racer_stadium_top2", "top2", ("racer_id", "stadium_id"), COURSE_SHRINKAGE, _RACER),
    Rate("motor_hist", "top2", ("stadium_id", "motor_no"), MOTOR_SHRINKAGE,
         ("stadium_id", "motor_no")),
    Rate("stadium_lane_win", "won", ("stadium_id", "lane"), COURSE_SHRINKAGE, _VENUE),
)
#: Grouped on the realised course, so for diagnosis only.
REALISED_RATES = (
    Rate("racer_course_win", "won", ("racer_id", "course"), COURSE_SHRINKAGE, _RACER),
    Rate("stadium_course_win", "won", ("stadium_id", "course"), COURSE_SHRINKAGE, _VENUE),
)


def _pair(prefix: str, value: str) -> tuple[Measure, Measure]:
    """Running sum and running count of the non-null values."""
    column = F.col(value)
    return (
        Measure(f"{prefix}_s", column),
        Measure(f"{prefix}_n", column.isNotNull().cast("long")),
    )


def prior_counts(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    name: str,
    *,
    order: Sequence[str] = ORDER_KEYS,
    levels: Sequence[Sequence[str]] = EVENT_LEVELS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``{name}_s`` and ``{name}_n``: sum and count of ``value`` over earlier rows."""
    family = Family((), _pair(name, value))
    out = running(df, group, [family], order, levels, hot_rows=hot_rows)
    return out.fillna(0, subset=[f"{name}_s", f"{name}_n"])


def prior_counts_strict(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    name: str,
    *,
    levels: Sequence[Sequence[str]] = INSTANT_LEVELS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Like :func:`prior_counts`, over rows at strictly earlier instants only."""
    depth = chunk_depths(df, [group], levels, hot_rows)[tuple(group)]
    out = _scan_strict(df, group, [Family((), _pair(name, value))], levels, depth, hot_rows, df)
    return out.fillna(0, subset=[f"{name}_s", f"{name}_n"])


def _scan_strict(df, anchor, families, levels, depth, hot_rows, source) -> DataFrame:
    """Windows by instant inside a day; where one day of a key is hot, totals per instant."""
    if depth < 2:
        instant = levels[-1][0]
        return running(df, anchor, families, [instant], levels[:1], instant=instant,
                       hot_rows=hot_rows, source=source, depth=depth)
    for f in families:
        df = running_strict(df, [*anchor, *f.extra], f.measures, levels, source=source)
    return df


def shrunk_rates(
    df: DataFrame,
    rates: Sequence[Rate],
    *,
    mode: str = "strict",
    order: Sequence[str] = ORDER_KEYS,
    levels: Sequence[Sequence[str]] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``{name}_n``, ``{name}_rate`` and ``{name}_raw`` for each rate.

    The global mean a rate is shrunk toward expands with time as well, so nothing
    depends on later rows. ``mode='rows'`` takes every row earlier in ``order``
    (members of one group see each other through the global mean);
    ``mode='strict'`` takes rows at strictly earlier instants only.

    ``df`` is also counted per key (one job) and totalled per hot key, so pass a table
    or :func:`wakeline.session.staged` rows.
    """
    if mode not in ("rows", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    levels = levels or (EVENT_LEVELS if mode == "rows" else INSTANT_LEVELS)
    out = prior_sums(df, rates, mode=mode, order=order, levels=levels, hot_rows=hot_rows)
    return finished(out, df.columns, rates)


def families(rates: Sequence[Rate]) -> dict[tuple[str, ...], tuple[str, ...]]:
    """The values summed per group; the empty group is the overall mean's."""
    out = {(): tuple(dict.fromkeys(r.value for r in rates))}
    for group in dict.fromkeys(r.group for r in rates):
        out[group] = tuple(dict.fromkeys(r.value for r in rates if r.group == group))
    return out


def sum_name(group: Sequence[str], value: str) -> str:
    """Stem of the columns of a running sum and count: ``{stem}_s`` and ``{stem}_n``."""
    return f"_{'_'.join(group) or 'all'}_{value}"


def prior_sums(
    df: DataFrame,
    rates: Sequence[Rate],
    *,
    mode: str,
    order: Sequence[str],
    levels: Sequence[Sequence[str]],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the running sums that the rates are made of; groups of one anchor share a shuffle."""
    anchors = list(dict.fromkeys([(), *(r.anchor for r in rates)]))
    anchor_of = {(): (), **{r.group: r.anchor for r in rates}}
    depths = chunk_depths(df, anchors, levels, hot_rows)
    wanted_of = {
        anchor: [
            Family(group[len(anchor):], tuple(m for v in values for m in _pair(sum_name(group, v), v)))
            for group, values in families(rates).items()
            if anchor_of[group] == anchor
        ]
        for anchor in anchors
    }
    out = df
    # later shuffles carry the columns of earlier ones, so the anchor with the most comes last
    for anchor, wanted in sorted(wanted_of.items(), key=lambda a: sum(len(f.measures) for f in a[1])):
        if mode == "rows":
            out = running(out, anchor, wanted, order, levels, hot_rows=hot_rows,
                          source=df, depth=depths[anchor])
        else:
            out = _scan_strict(out, anchor, wanted, levels, depths[anchor], hot_rows, df)
    return out


def finished(sums: DataFrame, keep: Sequence[str], rates: Sequence[Rate]) -> DataFrame:
    """``keep`` and the columns of each rate, from the running sums."""
    columns = []
    for r in rates:
        stem, overall = sum_name(r.group, r.value), sum_name((), r.value)
        total = f"coalesce(CAST({stem}_s AS DOUBLE), 0.0D)"
        n = f"coalesce({stem}_n, 0L)"
        mean = f"try_divide({overall}_s, {overall}_n)"
        columns += [
            f"{n} AS {r.name}_n",
            f"({total} + {r.k}D * {mean}) / ({n} + {r.k}D) AS {r.name}_rate",
            f"CASE WHEN {n} > 0 THEN {total} / {n} END AS {r.name}_raw",
        ]
    return sums.selectExpr(*[f"`{c}`" for c in keep], *columns)


def expanding_mean(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Sequence[str]],
    name: str,
    *,
    min_n: int = MIN_PRIOR_OBSERVATIONS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean over earlier rows of the group; the overall one below ``min_n`` rows.

    Adds ``name`` and ``{name}_n`` (earlier rows of the group). NULL on the first row.
    """
    def measures(tag: str) -> tuple[Measure, Measure]:
        return (
            Measure(f"_{tag}_s", F.col(value).cast("double")),
            Measure(f"_{tag}_n", F.lit(1).cast("long")),
        )

    out = running(df, group, [Family((), measures("g"))], order, levels,
                  hot_rows=hot_rows, source=df)
    out = running(out, [], [Family((), measures("all"))], order, levels,
                  hot_rows=hot_rows, source=df)
    n = F.coalesce(F.col("_g_n"), F.lit(0))
    mean = (
        F.when(n >= min_n, F.try_divide("_g_s", "_g_n"))
        .when(F.col("_all_n") > 0, F.try_divide("_all_s", "_all_n"))
    )
    return out.select(*df.columns, n.alias(f"{name}_n"), mean.alias(name))


def blocked(df: DataFrame, column: str = "race_no", size: int = GROUPS_PER_BLOCK) -> DataFrame:
    """Add ``race_block``, the coarsening of the group number used by the levels."""
    return df.withColumn("race_block", F.floor(F.col(column) / size))


def event_ts(day: Column, time: Column, default: str = "12:00:00") -> Column:
    """Day plus time of day; a missing or unreadable time counts as ``default``."""
    text, clock = day.cast("string"), time.cast("string")
    at = F.when(clock.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), F.concat(text, F.lit(" "), clock))
    noon = F.concat(text, F.lit(f" {default}"))
    return F.coalesce(at.try_cast("timestamp_ntz"), noon.cast("timestamp_ntz"))

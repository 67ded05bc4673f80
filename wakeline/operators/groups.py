"""Per-group statistics, completeness, softmax and renormalisation.

A group is expected to be small, but nothing here relies on it: statistics are
aggregated (combined before the shuffle) and joined back, and a join, unlike a
window, can be split when one group is huge. ``bounded=True`` promises that groups
are small, e.g. after :func:`complete_groups`, and then uses windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.schema import MEMBERS_PER_GROUP, RACE_KEYS


def with_group(
    df: DataFrame, keys: Sequence[str], stats: dict[str, Column], *, bounded: bool = False
) -> DataFrame:
    """Add aggregates of the row's group. A NULL key is a group of its own."""
    if bounded:
        window = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(window) for n, c in stats.items()})
    return with_totals(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def with_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows of ``totals``, unique by key, to their groups, NULL keys included."""
    names = [c for c in totals.columns if c not in keys]
    other = totals.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *names)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)])
    return df.join(other, same).select(*df.columns, *names)


def complete_groups(
    df: DataFrame,
    keys: Sequence[str] = RACE_KEYS,
    *,
    label: str = "won",
    size: int = MEMBERS_PER_GROUP,
) -> DataFrame:
    """Rows of groups with exactly ``size`` members and exactly one positive label.

    A group whose key holds a NULL has no identity and is not complete. Rows are read once: of a
    larger group the first ``size + 1`` tell that it is too large, and no more of them are moved or
    counted. Later windows on the keys use the placement.
    """
    named = df.dropna(subset=list(keys))
    # the order is by a key, so any rows of the group; Spark limits such windows before the shuffle
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[-1]))
    few = named.withColumn("_place", place).filter(F.col("_place") <= size + 1)
    stats = {"_n": F.count(F.lit(1)), "_wins": F.sum(label)}
    counted = with_group(few, keys, stats, bounded=True)
    return counted.filter((F.col("_n") == size) & (F.col("_wins") == 1)).drop("_place", *stats)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def _softmax_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest score, shifted sum and size of each group from one use of the rows.

    The sum needs the largest score, which is not known yet. So scores are summed per
    whole number first, shifted by that number, and the few sums are shifted again.
    """
    steps = df.groupBy(*keys, F.floor("_s").alias("_step")).agg(
        F.max("_s").alias("_top"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.exp(F.col("_s") - F.floor("_s"))).alias("_part"),
    )
    groups = steps.groupBy(*keys).agg(
        F.max("_top").alias("_top"), F.sum("_n").alias("_n"),
        F.collect_list(F.when(F.col("_step").isNotNull(), F.struct("_step", "_part"))).alias("_parts"),
    )
    total = F.aggregate(
        F.array_sort("_parts"), F.lit(0.0),
        lambda a, x: a + x["_part"] * F.exp(x["_step"] - F.col("_top")),
    )
    return groups.select(*keys, "_top", "_n", total.alias("_total"))


def group_softmax(
    df: DataFrame,
    keys: Sequence[str] = RACE_KEYS,
    score: str = "score",
    out: str = "p_win",
    *,
    bounded: bool = False,
) -> DataFrame:
    """Softmax of ``score`` inside each group; sums to one in every group.

    Scores that are missing or not finite get probability 0; a group without any
    finite score is uniform.
    """
    value = F.col(score).cast("double")
    df = df.withColumn("_s", F.when(is_finite(value), value))
    if bounded:
        df = with_group(df, keys, {"_top": F.max("_s"), "_n": F.count(F.lit(1))}, bounded=True)
        df = df.withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
        df = with_group(df, keys, {"_total": F.sum("_e")}, bounded=True)
    else:
        df = with_totals(df, _softmax_totals(df, keys), keys)
        df = df.withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    df = df.withColumn("_e", F.coalesce("_e", F.lit(0.0)))
    share = F.when(F.col("_total") > 0, F.col("_e") / F.col("_total")).otherwise(1.0 / F.col("_n"))
    return df.withColumn(out, share).drop("_s", "_top", "_e", "_total", "_n")


def renormalise_group(
    df: DataFrame,
    keys: Sequence[str] = RACE_KEYS,
    column: str = "p_win",
    *,
    size: int = MEMBERS_PER_GROUP,
    bounded: bool = False,
) -> DataFrame:
    """Divide by the group total; ``1/size`` each where the total is zero."""
    df = with_group(df, keys, {"_total": F.sum(column)}, bounded=bounded)
    share = F.when(F.col("_total") > 0, F.col(column) / F.col("_total")).otherwise(1.0 / size)
    return df.withColumn(column, share).drop("_total")


def sum_to_one(df: DataFrame, keys: Sequence[str] = RACE_KEYS, column: str = "p_win") -> DataFrame:
    """Smallest and largest group total."""
    return (
        df.groupBy(*keys)
        .agg(F.sum(column).alias("_total"))
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.min("_total").alias("min_total"),
            F.max("_total").alias("max_total"),
        )
    )

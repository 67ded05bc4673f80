"""Ordered triples of a six-member group and their probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.schema import MEMBERS_PER_GROUP, RACE_KEYS
from wakeline.session import shuffle_partitions


def wide_groups(
    df: DataFrame, keys: Sequence[str], member: str, value: str, size: int = MEMBERS_PER_GROUP
) -> DataFrame:
    """One row per group with members exactly 1..size, values in array ``v``.

    Fixed-size aggregates only, so a malformed huge group is dropped without ever
    being collected.
    """
    slots = [F.max(F.when(F.col(member) == i, F.col(value))) for i in range(1, size + 1)]
    seen = [F.sum((F.col(member) == i).cast("long")) for i in range(1, size + 1)]
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.array(*seen).alias("_seen"),
            F.array(*slots).alias("v"),
        )
        .filter((F.col("_n") == size) & F.forall("_seen", lambda c: c == 1))
        .select(*keys, "v")
    )


def triple_table(size: int) -> Column:
    """All ordered triples of 1..size as a literal array of (i, j, k, combination)."""
    rows = ", ".join(
        f"named_struct('i', {i}, 'j', {j}, 'k', {k}, 'combination', '{i}-{j}-{k}')"
        for i, j, k in permutations(range(1, size + 1), 3)
    )
    return F.expr(f"array({rows})")


def placed_by_group(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that become 120 times larger next, so their partitions must not be sized by what comes in.

    A fixed count is left alone by adaptive coalescing. Later joins on group and combination keep this
    placement, and two tables placed so meet without a shuffle.
    """
    return groups.repartition(4 * shuffle_partitions(groups.sparkSession), *keys)


def race_tickets(
    scored: DataFrame,
    keys: Sequence[str] = RACE_KEYS,
    *,
    member: str = "lane",
    p: str = "p_win",
    size: int = MEMBERS_PER_GROUP,
) -> DataFrame:
    """Explode group probabilities into all ordered triples (without replacement).

    p(i,j,k) = p_i * p_j / (1 - p_i) * p_k / (1 - p_i - p_j), 0 where a denominator
    is not positive. Groups that do not have members 1..size are skipped; negative,
    missing or all-zero probabilities are an error.
    """
    wide = wide_groups(scored, keys, member, p, size)
    bad = F.exists("v", lambda x: x.isNull() | (x < 0))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    checked = wide.withColumn("_total", total).withColumn(
        "v",
        F.when(
            bad | (F.col("_total") <= 0),
            F.raise_error("group probabilities must be non-negative and not all zero"),
        ).otherwise(F.transform("v", lambda x: x / F.col("_total"))),
    )
    placed = placed_by_group(checked.select(*keys, "v"), keys)
    rows = placed.select(*keys, "v", F.explode(triple_table(size)).alias("t"))
    a, b, c = (F.get("v", F.col(f"t.{x}") - 1) for x in "ijk")
    rest = 1.0 - a
    rest2 = rest - b
    probability = F.when(
        (rest > 0) & (rest2 > 0), a * F.try_divide(b, rest) * F.try_divide(c, rest2)
    ).otherwise(0.0)
    return rows.select(*keys, F.col("t.combination"), probability.alias("p_model"))

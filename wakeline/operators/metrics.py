"""Calibration and ranking metrics. Accuracy is left out on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.prefix import HOT_ROWS, Family, Measure, running
from wakeline.schema import MEMBERS_PER_GROUP, RACE_KEYS


def brier(p: str, label: str) -> Column:
    gap = F.col(p) - F.col(label)
    return F.avg(gap * gap)


def roc_auc(df: DataFrame, p: str, label: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Labels are totalled per distinct score; the only ordered step is a chunked
    prefix over those totals, so no task sees all scores.
    """
    scores = df.groupBy(F.col(p).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    def part(scale: int) -> Column:
        # NaN sorts last, among scores and among parts
        return F.when(F.isnan("s"), F.lit(2**62)).otherwise(F.floor(F.col("s") * scale))

    cut = scores.select(
        "s", "pos", (F.col("n") - F.col("pos")).alias("neg"),
        part(1_000).alias("s3"), part(1_000_000).alias("s6"),
    )
    below = Family((), (Measure("neg_below", F.col("neg")),))
    ranked = running(cut, [], [below], ["s"], [["s3"], ["s6"]], hot_rows=hot_rows)
    wins = F.col("pos") * (F.coalesce(F.col("neg_below"), F.lit(0)) + F.col("neg") / 2.0)
    return ranked.agg(
        F.try_divide(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc")
    )


def reliability_table(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Predicted against observed frequency per probability bin; empty bins are absent.

    Bins are half-open on explicit edges ``i / bins``: ``floor(p * bins)`` would move
    values lying just below an edge.
    """
    number = F.lit(0)
    for i in range(1, bins):
        number = F.when(F.col(p) >= i / bins, i).otherwise(number)
    names = F.create_map(
        *[F.lit(x) for i in range(bins) for x in (i, f"{i / bins:.1f}-{(i + 1) / bins:.1f}")]
    )
    return (
        df.groupBy(number.alias("_b"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("mean_predicted"),
            F.avg(label).alias("observed"),
        )
        .select(
            names[F.col("_b")].alias("bin"), "n", "mean_predicted", "observed",
            (F.col("mean_predicted") - F.col("observed")).alias("gap"),
        )
    )


def evaluate(
    df: DataFrame, p: str, label: str, keys: Sequence[str] = RACE_KEYS
) -> DataFrame:
    """One row: sizes, base rate, Brier score, AUC and mean prediction."""
    per_group = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).alias("y"),
        F.sum(p).alias("p"),
        F.sum((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("sq"),
    )
    sizes = per_group.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("races"),
        F.try_divide(F.sum("y").cast("double"), F.sum("n")).alias("base_rate"),
        F.try_divide(F.sum("sq"), F.sum("n")).alias("brier"),
        F.try_divide(F.sum("p"), F.sum("n")).alias("mean_predicted"),
    )
    # both sides are a single row
    return sizes.withColumn("_k", F.lit(0)).join(
        roc_auc(df, p, label).withColumn("_k", F.lit(0)), "_k"
    ).drop("_k")


def constant_baseline(df: DataFrame, label: str, size: int = MEMBERS_PER_GROUP) -> DataFrame:
    """Brier score of predicting the base rate, and of 1/size, for every row."""
    y = F.col(label).cast("double")
    return df.agg(F.avg(y).alias("m"), F.avg(y * y).alias("m2")).select(
        (F.col("m2") - F.col("m") * F.col("m")).alias("brier_constant"),
        (F.col("m2") - 2 * F.col("m") / size + F.lit(1.0 / size**2)).alias("brier_uniform"),
    )

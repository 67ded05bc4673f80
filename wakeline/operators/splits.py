"""Chronological splits. Years become date ranges, so partitions and row groups prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.schema import TEST_YEARS, TRAIN_YEARS, VALID_YEARS

MIN_PAST_ROWS = 10_000


def years(df: DataFrame, first: int, last: int, day: str = "race_date") -> DataFrame:
    """Rows of the calendar years first..last."""
    return df.filter(
        (F.col(day) >= F.lit(f"{first}-01-01").cast("date"))
        & (F.col(day) < F.lit(f"{last + 1}-01-01").cast("date"))
    )


def train_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return years(df, *TRAIN_YEARS), years(df, *VALID_YEARS)


def hold_out(df: DataFrame, *, final_evaluation: bool = False) -> DataFrame:
    """The years kept for one final evaluation; refused unless asked for by name."""
    if not final_evaluation:
        raise RuntimeError(
            "the hold-out years are for the final evaluation only; "
            "tune on the validation years or pass final_evaluation=True"
        )
    return years(df, *TEST_YEARS)


def walk_forward_folds(
    df: DataFrame, first: int, last: int, *, min_past_rows: int = MIN_PAST_ROWS
) -> DataFrame:
    """Folds: fit before year-1, stop early on year-1, evaluate on year.

    ``skipped`` says why a fold cannot be used, and is NULL where it can. One count per calendar
    year; the folds come from that small table, years without rows included.
    """
    per_year = df.groupBy(F.year("race_date").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    asked = df.sparkSession.range(first, last + 1).select(
        F.col("id").cast("int").alias("eval_year"), F.lit(None).cast("int").alias("y"), F.lit(0).cast("long").alias("n"))
    folds = asked.unionByName(per_year.select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("eval_year"), "y", "n"
    ))
    total = {
        "train_rows": F.col("y") < F.col("eval_year") - 1,
        "holdout_rows": F.col("y") == F.col("eval_year") - 1,
        "rows": F.col("y") == F.col("eval_year"),
    }
    summed = folds.groupBy("eval_year").agg(
        *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in total.items()]
    )
    reason = (
        F.when(F.col("rows") == 0, "no rows to evaluate")
        .when(F.col("holdout_rows") == 0, "no rows to stop on")
        .when(F.col("train_rows") == 0, "no rows to fit")
        .when(F.col("train_rows") + F.col("holdout_rows") < min_past_rows, f"fewer than {min_past_rows} past rows")
    )
    return summed.withColumn("skipped", reason)


def chronological(
    df: DataFrame, first: float = 0.70, second: float = 0.85, day: str = "race_date"
) -> DataFrame:
    """Add ``part``: train, valid or test by cut dates on the list of distinct dates."""
    # one row per calendar day, so the ordered window is small
    dates = df.select(day).distinct()
    numbered = dates.select(
        day,
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"),
    )
    part = (
        F.when(F.col("i") < F.floor(F.col("n") * first), "train")
        .when(F.col("i") < F.floor(F.col("n") * second), "valid")
        .otherwise("test")
    )
    # bounded by the calendar: one row per date
    return df.join(F.broadcast(numbered.select(day, part.alias("part"))), day)

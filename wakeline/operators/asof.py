"""As-of join: each left row with the latest right row at or before its instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.prefix import HOT_ROWS, Family, Measure, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    *,
    strict: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left rows keep their number; unmatched payload is NULL.

    Both sides are interleaved by time and the last right row is carried forward, a
    prefix that hot keys run through in day and minute chunks. ``strict`` takes
    right rows before the instant only. Of right rows with equal key and instant
    the one with the largest payload is taken. A NULL instant matches nothing, on
    either side.
    """
    # right before left at one instant for <=, after it for <
    right_side = 2 if strict else 0
    value = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    # an extremely dense instant is one row per key and instant here
    right = right.filter(F.col(right_ts).isNotNull())
    events = right.groupBy(*on, F.col(right_ts).alias("_ts")).agg(F.max(value).alias("_v"))
    rows = left.select(
        *left.columns, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side")
    ).unionByName(
        events.withColumn("_side", F.lit(right_side)), allowMissingColumns=True
    )
    timed = rows.withColumns(
        {"_day": F.to_date("_ts"), "_minute": F.date_trunc("minute", "_ts")}
    )
    family = Family((), (Measure("_last", F.col("_v"), "last"),))
    carried = running(
        timed, on, [family], ["_ts", "_side"], [["_day"], ["_minute"]], hot_rows=hot_rows
    )
    return carried.filter(F.col("_side") == 1).select(
        *left.columns, *[F.when(F.col("_ts").isNotNull(), F.col(f"_last.p{i}")).alias(c)
          for i, c in enumerate(payload)]
    )

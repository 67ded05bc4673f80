"""Append-only price logs: JSON lines keyed by group, later records win."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.merge import union_keys
from wakeline.schema import PRICE_LOG


@dataclass(frozen=True)
class PriceLog:
    records: DataFrame
    quarantine: DataFrame


def parse_log_lines(lines: DataFrame) -> PriceLog:
    """Text lines (value, plus columns placing them) to records and damaged lines.

    A truncated or glued line is set aside and can be counted; it never stops a read.
    """
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.filter(F.trim("value") != "").select(
        *rest, "value",
        F.from_json("value", PRICE_LOG, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"),
    )
    damaged = F.col("r._corrupt_record").isNotNull()
    return PriceLog(
        parsed.filter(~damaged).select(*rest, "r.k", "r.d", "r.j", "r.r", "r.o", "r.unavailable", "r.error"),
        parsed.filter(damaged).select(*rest, "value"),
    )


def read_price_logs(spark: SparkSession, paths: list[str]) -> PriceLog:
    """Read logs in the given order; of equal keys the last line of the last file wins."""
    files = [
        spark.read.text(path).select(
            "value",
            F.lit(i).alias("file_no"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        for i, path in enumerate(paths)
    ]
    lines = files[0]
    for other in files[1:]:
        lines = lines.unionByName(other)
    return parse_log_lines(lines)


def log_prices(records: DataFrame, order: list[str]) -> DataFrame:
    """One row per (group, combination): the price of the latest record."""
    rows = records.filter(F.col("o").isNotNull()).select(
        F.col("d").alias("race_date"),
        F.col("j").cast("smallint").alias("stadium_id"),
        F.col("r").cast("smallint").alias("race_no"),
        *order,
        F.explode("o").alias("combination", "odds"),
    )
    return rows.groupBy("race_date", "stadium_id", "race_no", "combination").agg(
        F.max_by("odds", F.struct(*order)).alias("odds")
    )


LOG_ORDER = ["file_no", "file", "block", "line"]


def recorded_keys(*logs: PriceLog) -> DataFrame:
    """Keys with any record, including those known to be unavailable."""
    return union_keys([log.records.filter(F.col("k").isNotNull()) for log in logs], ["k"])


def coverage_by_month(prices: DataFrame) -> DataFrame:
    groups = prices.select("race_date", "stadium_id", "race_no").distinct()
    return (
        groups.groupBy(F.month("race_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("races"))
        .orderBy("month")
    )

"""Table readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.schema import VENUES


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet with a declared schema, so nothing is inferred and columns prune."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_query(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """Result of a query on a database. With a column and bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    if bounds is None:
        raise ValueError("a partition column needs bounds")
    return reader.options(
        dbtable=f"({query}) AS q", partitionColumn=partition_column,
        lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(partitions),
    ).load()


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Cast to declared types in declared order; absent columns become NULL."""
    target = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def write_by_year(df: DataFrame, path: str, day: str = "race_date") -> None:
    """Replace the years present in ``df``, keep the others.

    Rows are gathered by year, and adaptive execution splits a year by its size, so a year
    becomes neither thousands of small files nor the work of one task.
    """
    (
        df.withColumn("year", F.year(day))
        .hint("rebalance", "year")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Ordered report lines as one text file. A report is one day's worth of lines."""
    lines.orderBy("section", "a", "b", "c").select("text").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def venues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VENUES.items()), "stadium_id INT, name STRING")

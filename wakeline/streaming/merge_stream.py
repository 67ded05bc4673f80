"""Streaming upserts: each micro-batch rewrites the partitions it touches, and no others.

The table is a folder of ``_part=<value>/_v=<batch id>`` partitions. A batch merges its rows with
the newest older version of the partitions they fall in and writes those anew under its own
id; a small table beside the folder then says which partitions a batch has finished. Files read
are remembered by the stream's checkpoint, and a batch replayed after a failure reads the same
versions and writes the same ones again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wakeline.operators.merge import keyed_merge
from wakeline.sources.price_log import parse_log_lines

#: Versions of a partition that stay: the newest, and the one a replayed batch reads.
KEPT_VERSIONS = 2
#: Partitions of a table without a date.
KEY_BUCKETS = 64


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Finished versions of each partition, ascending. One entry per partition and batch."""
    path, fs = _file_system(spark, f"{folder}.batches")
    if not fs.exists(path):
        return {}
    rows = spark.read.parquet(f"{folder}.batches").groupBy("part").agg(
        F.array_sort(F.collect_set(F.col("v").cast("long"))).alias("vs"))
    return {r["part"]: list(r["vs"]) for r in rows.collect()}


def read_snapshot(
    spark: SparkSession, folder: str, before: int | None = None, parts: Sequence[str] | None = None
) -> DataFrame | None:
    """Newest finished version of every partition (or of ``parts``), older than a batch id."""
    paths = []
    for part, versions in _finished(spark, folder).items():
        known = [v for v in versions if before is None or v < before]
        if known and (parts is None or part in parts):
            paths.append(f"{folder}/_part={part}/_v={known[-1]}")
    if not paths:
        return None
    return spark.read.option("basePath", folder).parquet(*paths).drop("_part", "_v")


def _forget(spark: SparkSession, folder: str, parts: Sequence[str]) -> None:
    for part, versions in _finished(spark, folder).items():
        if part in parts:
            for v in versions[:-KEPT_VERSIONS]:
                path, fs = _file_system(spark, f"{folder}/_part={part}/_v={v}")
                fs.delete(path, True)


def merge_stream(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    incoming: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    part: Column,
    *,
    order: Sequence[str],
    either: Sequence[str] = (),
) -> StreamingQuery:
    """Upsert ``incoming(batch)`` for all data available now.

    ``part`` says which partition a row lies in. It depends on the keys alone; its values are
    letters, digits, ``-`` and ``_``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = incoming(batch).withColumn("_part", F.coalesce(part.cast("string"), F.lit("none"))).persist()
        parts = [r["_part"] for r in fresh.select("_part").distinct().collect()]
        if parts:
            old = read_snapshot(spark, folder, before=batch_id, parts=parts)
            columns = [c for c in fresh.columns if c not in (*order, "_part")]
            old = fresh.select(*columns).limit(0) if old is None else old.select(*columns)
            merged = keyed_merge(old, fresh, keys, order=order, either=either)
            (merged.withColumns({"_part": F.coalesce(part.cast("string"), F.lit("none")), "_v": F.lit(batch_id)})
             .hint("rebalance", "_part")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("_part", "_v").parquet(folder))
            done = spark.createDataFrame([(p,) for p in parts], "part STRING")
            done.coalesce(1).write.mode("overwrite").parquet(f"{folder}.batches/v={batch_id}")
            _forget(spark, folder, parts)
        fresh.unpersist()

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_PRICE_KEYS = ["race_date", "stadium_id", "race_no", "combination"]


def price_log_stream(
    spark: SparkSession, source: str, folder: str, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Fold newly arrived price logs into the price table, partitioned by day; later records win.

    Within a batch, files are ordered by modification time, then name.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(source).select(
        "value",
        F.col("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    order = ["at", "file", "block", "line"]

    def incoming(batch: DataFrame) -> DataFrame:
        placed = batch.withColumn("line", F.monotonically_increasing_id())
        records = parse_log_lines(placed).records.filter(F.col("o").isNotNull())
        return records.select(
            F.col("d").alias("race_date"), F.col("j").cast("smallint").alias("stadium_id"),
            F.col("r").cast("smallint").alias("race_no"), *order,
            F.explode("o").alias("combination", "odds"),
        )

    day = F.date_format("race_date", "yyyy-MM-dd")
    return merge_stream(lines, folder, checkpoint, incoming, _PRICE_KEYS, day, order=order)


def feed_stream(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    keys: list[str],
    *,
    order: list[str],
    flags: tuple[str, ...] = ("has_b", "has_k"),
    part: Column | None = None,
) -> StreamingQuery:
    """Upsert feed rows as they arrive: a late feed fills in what it alone carries.

    The stream's rows have every column of the merged table (NULL where the feed is
    silent) and the ordering columns. Flags are OR-ed, everything else keeps the
    newest non-null value. Without ``part``, keys are dealt to a fixed number of partitions.
    """
    if part is None:
        part = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    flagged = [f for f in flags if f in stream.columns]
    return merge_stream(stream, folder, checkpoint, lambda batch: batch, keys, part, order=order, either=flagged)

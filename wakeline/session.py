"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Partitions a shuffle starts with before small ones are joined.
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

#: Settings that can be changed on a running session. Skew splitting is forced
#: even where it costs one more shuffle: a key may hold a third of all rows.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Compressed bytes of a task's input: rows of many running sums take ten times that in a sort.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # A join on (group, combination) may use rows already placed by group, so exploded
    # tickets are not shuffled again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # decode() may use the feeds' character set and marks bad bytes instead of failing
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def build_session(app: str = "wakeline", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session. Cluster sizing is left to the submit command."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for a shuffle whose count is stated: as many as any other starts with."""
    least = spark.conf.get("spark.sql.shuffle.partitions")
    return max(int(least), int(spark.conf.get(INITIAL_PARTITIONS, least)))


def require_feed_charset(spark: SparkSession) -> None:
    """Parsers of the feeds need two settings; they check them and never change a session."""
    for key in ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"):
        if spark.conf.get(key, "false") != "true":
            raise RuntimeError(f"set {key} to true, or build the session with build_session()")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the whole cluster is this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several branches of one plan start from the same rows. A parquet
    table keeps column pruning and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

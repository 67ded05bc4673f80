"""Streams that keep one merged row per key in a state store.

A record that arrives is merged into what its key holds: either the newest record wins whole, or
each column keeps its newest value that is not NULL and flags are OR-ed, so that a late feed fills in
what it alone carries. Merging does not depend on the order of arrival. Nothing that is already kept
is written again: a batch touches the keys it names, the store writes their changes to the checkpoint,
and a restart goes on from there.

The state is the table: :func:`read_state` reads it from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW, _SALT = "_row", "_salt"


@dataclass(frozen=True)
class Merge:
    """How records of a key become one row.

    ``order``: whole-number or time columns that order the records of a key; of equal ones the larger
    values stay, whichever came first. With ``whole`` the newest record wins with all its columns.
    Otherwise each column is on its own, and columns of ``either`` (booleans) are OR-ed.
    """

    keys: Sequence[str]
    order: Sequence[str]
    columns: Sequence[str]
    either: Sequence[str] = ()
    whole: bool = False
    #: Parts that the records of one key are dealt to, for keys that hold very many records.
    salts: int = 1


def merged_stream(stream: DataFrame, merge: Merge) -> DataFrame:
    """The rows of the keys that each batch names, after the merge (update mode).

    An aggregate that Spark keeps in the store: records of a batch are combined before they are
    shuffled, and a NULL key is a key of its own.
    """
    types = dict(stream.dtypes)
    order = F.array(*[F.coalesce(F.unix_micros(F.col(c).cast("timestamp")) if types[c].startswith("timestamp") else F.col(c).cast("long"),
                                 F.lit(-(2 ** 63))) for c in merge.order])
    salt = F.pmod(F.xxhash64(*merge.order), F.lit(merge.salts)).cast("int")
    # NaN is missing, as NULL is
    value = {c: (F.when(~F.isnan(c), F.col(c)) if types[c] in ("double", "float") else F.col(c)).alias(c) for c in merge.columns}
    at = order.alias("_at")
    if merge.whole:
        kept = [F.max(F.struct(at, *value.values())).alias(_ROW)]
    else:
        kept = [F.max(v if c in merge.either else F.when(v.isNotNull(), F.struct(at, v))).alias(c) for c, v in value.items()]
    return stream.groupBy(*merge.keys, salt.alias(_SALT)).agg(*kept)


@contextmanager
def _rocks(spark: SparkSession):
    """A store that need not fit in memory, while a stream is started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def keep(stream: DataFrame, merge: Merge, checkpoint: str) -> StreamingQuery:
    """Merge all that is available now into the state under ``checkpoint``."""
    with _rocks(stream.sparkSession):
        return (merged_stream(stream, merge).writeStream.format("noop").outputMode("update")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_state(spark: SparkSession, merge: Merge, checkpoint: str) -> DataFrame:
    """The table: one row per key, from the newest state of a stream that is not running.

    The store holds what the aggregates hold, in their order and under names of Spark's own.
    """
    with _rocks(spark):
        state = spark.read.format("statestore").option("path", checkpoint).load()
    names = [_ROW] if merge.whole else list(merge.columns)
    held = StructType([StructField(n, f.dataType) for n, f in zip(names, state.schema["value"].dataType.fields, strict=True)])
    rows = state.select("key.*", F.col("value").cast(held).alias("_value")).select(*merge.keys, "_value.*")
    # parts of a key meet here
    best = rows.groupBy(*merge.keys).agg(*[F.max(n).alias(n) for n in names])
    if merge.whole:
        return best.select(*merge.keys, *[F.col(f"{_ROW}.{c}").alias(c) for c in merge.columns])
    return best.select(*merge.keys, *[
        F.col(c) if c in merge.either else F.col(f"{c}.{c}").alias(c) for c in merge.columns])

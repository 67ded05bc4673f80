"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The whole table, pruned to ``columns``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows and bytes of a batch that goes to a Python worker, at most. A batch lies in the worker, as lists of
#: Python objects, and in the executor outside its heap, so both grow with it and keep what they took.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
_BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
}


def _number(setting: str) -> int:
    """A count or a size in bytes as Spark's settings give it: 1000, 64m, 64MB, 4194304b."""
    digits, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", setting.lower()).groups()
    return int(digits) << 10 * " kmgt".index(unit or " ")


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded size. Limits of the session that are lower stay."""
    conf = df.sparkSession.conf
    for key, most in _BATCH_CONF.items():
        if not 0 < _number(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(work, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str) -> DataFrame:
    """Run ``make()``'s function over batches of rows (lists of columns in, out).

    ``make`` runs once per task, so tables and caches live as long as the task.
    """
    spark_schema = StructType.fromDDL(schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spark_schema)
        work = make()
        gc.disable()  # nothing here makes cycles, and scans of large tables are slow
        try:
            for batch in batches:
                if batch.num_rows:
                    columns = work([batch.column(name).to_pylist() for name in names])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)
        finally:
            gc.enable()

    return map_batches(df, run, spark_schema)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))

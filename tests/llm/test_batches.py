"""What lies in a Python worker, and in its executor outside the heap, does not grow with a partition."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakeline.llm import common, minhash, quality

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def defaults(spark):
    before = {key: spark.conf.get(key) for key in (ROWS, BYTES)}
    spark.conf.set(ROWS, "10000")
    spark.conf.set(BYTES, "64MB")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def sizes_of(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()),
                                              "bytes": pa.array([batch.nbytes], pa.int64())})

    return common.map_batches(df, sizes, "n long, bytes long")


@pytest.mark.parametrize("n, width", [(5_000, 10), (400, 100_000)])
def test_batches_are_bounded_in_rows_and_bytes(spark, defaults, n, width):
    df = spark.range(0, n, 1, 1).select(F.repeat(F.lit("x"), width).alias("text"))
    seen = sizes_of(df).collect()
    assert sum(r["n"] for r in seen) == n
    assert max(r["n"] for r in seen) <= common.BATCH_ROWS
    # the row that passes the limit closes its batch
    assert max(r["bytes"] for r in seen) <= common.BATCH_BYTES + 2 * width


def test_lower_limits_of_a_session_stay(spark, defaults):
    spark.conf.set(ROWS, "7")
    assert [common._number(s) for s in ("7", "64m", "64MB", "67108864b", "-1b")] == [7, 1 << 26, 1 << 26, 1 << 26, -1]
    sizes_of(spark.range(1))
    assert spark.conf.get(ROWS) == "7" and int(spark.conf.get(BYTES)) == common.BATCH_BYTES


@pytest.mark.parametrize("stage", [quality.select, minhash.sketch])
def test_stages_of_the_pipeline_bound_their_batches(spark, defaults, stage):
    stage(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert int(spark.conf.get(ROWS)) == common.BATCH_ROWS

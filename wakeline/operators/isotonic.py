"""Isotonic regression over ranges of the score, and lookups in a sorted table of knots.

Pooling adjacent violators keeps a stack of blocks. The stack of two neighbouring ranges is the
pooled concatenation of their stacks, so ranges are pooled in parallel and then merged level by
level, a few neighbours at a time, and only where two ranges still violate each other at their seam.
Nothing but the number of such seams reaches the driver; the result is a table of knots, found by
a join with small sorted leaves.

The stack itself is the one thing here that column functions cannot express: it runs in Python, over
sorted Arrow batches, holding one range's stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.quality import decreasing_steps
from wakeline.session import staged

#: Neighbouring ranges merged in one step.
FAN = 8
#: Leaves of a lookup table (at most), and knots of a leaf (at least).
MAX_LEAVES, LEAF_KNOTS = 4096, 64
#: Knots of a table that is sent to every task; beyond, rows are shuffled to their leaves.
SENT_KNOTS = 100_000

BLOCK = "range long, lo double, hi double, total double, weight double"


def _pooled(stack: list[list[float]], lo: float, hi: float, total: float, weight: float) -> None:
    """Push one block and pool while the mean below is larger."""
    while stack and stack[-1][2] * weight > total * stack[-1][3]:
        low, _, t, w = stack.pop()
        lo, total, weight = low, total + t, weight + w
    stack.append([lo, hi, total, weight])


def _stacks(rows: DataFrame, keyed: bool) -> DataFrame:
    """Pool sorted rows per range, which is the task where ``keyed`` is false."""
    def emit(key: int, stack: list[list[float]]) -> pa.RecordBatch:
        columns = [pa.array([key] * len(stack), pa.int64()), *[pa.array(c, pa.float64()) for c in zip(*stack)]]
        return pa.RecordBatch.from_arrays(columns, names=["range", "lo", "hi", "total", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None if keyed else TaskContext.get().partitionId(), []
        for batch in batches:
            ranges = batch.column("range").to_pylist() if keyed else [key] * batch.num_rows
            for r, *block in zip(ranges, *[batch.column(c).to_pylist() for c in ("lo", "hi", "total", "weight")]):
                if r != key:
                    if stack:
                        yield emit(key, stack)
                    key, stack = r, []
                _pooled(stack, *block)
        if stack:
            yield emit(key, stack)

    return rows.mapInArrow(run, BLOCK)


def _seams(blocks: DataFrame) -> DataFrame:
    """One row per range that violates the range before it: range, previous."""
    mean = F.struct("total", "weight")
    edges = blocks.groupBy("range").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    order = Window.orderBy("range")  # one row per range, of which there are as many as tasks
    before, previous = F.lag("last").over(order), F.lag("range").over(order)
    edges = edges.select("range", "first", before.alias("before"), previous.alias("previous"))
    return edges.filter(F.col("before.total") * F.col("first.weight") > F.col("first.total") * F.col("before.weight")).select("range", "previous")


def isotonic_blocks(points: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """lo, hi, total, weight of the blocks of the weighted non-decreasing least-squares fit.

    Equal ``x`` are one point. Rows whose ``x`` or ``y`` is NULL or NaN, or whose weight is not
    positive, take no part. The fitted value of a block is total / weight; blocks ascend by lo.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = points.select(F.nanvl(F.col(x).cast("double"), F.lit(None)).alias("lo"),
                         F.nanvl(F.col(y).cast("double"), F.lit(None)).alias("_y"), w.alias("_w"))
    rows = rows.filter(F.col("lo").isNotNull() & F.col("_y").isNotNull() & (F.col("_w") > 0))
    # the sum of labels is exact while labels and weights are whole
    rows = rows.groupBy("lo").agg(F.sum(F.col("_y") * F.col("_w")).alias("total"), F.sum("_w").alias("weight"))
    rows = rows.withColumn("hi", F.col("lo")).repartitionByRange("lo").sortWithinPartitions("lo")
    blocks = staged(_stacks(rows, keyed=False), "isotonic-0")
    level = 0
    while _seams(blocks).count():
        level += 1
        parent = F.floor(F.col("range") / FAN).cast("long")
        inside = _seams(blocks).filter(parent == F.floor(F.col("previous") / FAN)).select(parent.alias("_parent")).distinct()
        moved = blocks.withColumn("range", parent)
        same = F.col("range") == F.col("_parent")
        merged = moved.join(inside, same, "left_semi").repartition("range").sortWithinPartitions("range", "lo")
        blocks = staged(_stacks(merged, keyed=True).unionByName(moved.join(inside, same, "left_anti")), f"isotonic-{level}")
    return blocks.drop("range")


def knots(blocks: DataFrame) -> DataFrame:
    """x, y: both ends of each block with its value, clipped to [0, 1]."""
    y = F.least(F.greatest(F.col("total") / F.col("weight"), F.lit(0.0)), F.lit(1.0))
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    return blocks.select(F.explode(ends).alias("x"), y.alias("y"))


def falls(table: DataFrame) -> DataFrame:
    """One row, falls: how many knots (x, y) lie below the knot before them.

    The order is cut at a thousandth of the range of ``x``, so no task walks all knots.
    """
    ends = table.agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    piece = F.floor(F.try_divide((F.col("x") - F.col("_low")) * 1000, F.col("_high") - F.col("_low")))
    rows = table.crossJoin(F.broadcast(ends)).select("x", "y", piece.alias("_piece"))
    return decreasing_steps(rows, [], "x", "y", [["_piece"]]).agg(F.count(F.lit(1)).alias("falls"))


def _below(values: Column, value: Column, most: int) -> Column:
    """How many of at most ``most`` ascending values are at most ``value``, by binary search.

    Each step evaluates both columns anew, so they should be plain ones.
    """
    steps = F.lit([1 << k for k in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (n + step <= F.size(values)) & (F.get(values, n + step - 1) <= value), n + step).otherwise(n))


def interpolated(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Map ``column`` through knots (x, y), linearly between them and flat outside.

    The knots are cut into sorted leaves. A row finds its leaf by binary search among the leaves'
    first knots (one row of at most MAX_LEAVES numbers), joins that one leaf, and searches it. So no
    row is repeated and no knot is a literal. NULL and NaN stay as they are; a table without knots
    gives NULL.
    """
    spark, none = df.sparkSession, F.array().cast("array<struct<x:double,y:double>>")
    about = table.agg(F.count("*").alias("n"), F.min("x").alias("least")).first()
    leaves = max(1, min(MAX_LEAVES, about["n"] // LEAF_KNOTS))
    at = [i / leaves for i in range(1, leaves)]
    cuts = []
    if at:  # a cut is a knot, so that no leaf is empty
        found = table.agg(F.percentile_approx("x", at, 10 * MAX_LEAVES)).first()[0]
        cuts = sorted(c for c in set(found) if c > about["least"])
    cuts = F.broadcast(spark.createDataFrame([(1, cuts)], "_one int, _cuts array<double>"))

    def placed(rows: DataFrame, value: Column) -> DataFrame:
        rows = rows.withColumn("_one", F.lit(1)).join(cuts, "_one")
        return rows.withColumn("_leaf", _below(F.col("_cuts"), value, len(at))).drop("_one", "_cuts")

    leaf = placed(table.select("x", "y"), F.col("x")).groupBy("_leaf").agg(
        F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_knots"))
    order = Window.orderBy("_leaf")  # at most MAX_LEAVES rows
    leaf = leaf.select("_leaf", F.concat("_knots", F.coalesce(F.slice(F.lead("_knots").over(order), 1, 1), none)).alias("_knots"))
    leaf = leaf.select("_leaf", F.col("_knots.x").alias("_x"), F.col("_knots.y").alias("_y"))
    if about["n"] <= SENT_KNOTS:  # rows stay where they are, and no leaf is hot
        leaf = F.broadcast(leaf)
    value = F.col(column).cast("double")
    last = _below(F.col("_x"), value, about["n"]) - 1

    def mapped(i: Column) -> Column:
        x0, x1, y0, y1 = F.get("_x", i), F.get("_x", i + 1), F.get("_y", i), F.get("_y", i + 1)
        slope = F.try_divide(y1 - y0, x1 - x0)
        return (F.when(i < 0, F.get("_y", F.lit(0))).when(x1.isNull() | (value == x0), y0)
                .otherwise(slope * (value - x0) + y0))

    # a one-element list binds the position for its four reads
    inner = F.get(F.transform(F.array(last), mapped), F.lit(0))
    rows = placed(df, value).join(leaf, "_leaf", "left")
    result = F.when(value.isNull() | F.isnan(value), value).otherwise(inner).alias(column)
    return rows.select(*[result if c == column else F.col(c) for c in df.columns])

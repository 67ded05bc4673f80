"""Isotonic fit and table lookup against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import isotonic


def by_hand(points):
    """Max over starts of the min over ends of the block means."""
    xs = sorted({x for x, _ in points})
    s = [sum(y for x, y in points if x == v) for v in xs]
    w = [sum(1 for x, _ in points if x == v) for v in xs]
    mean = lambda a, b: sum(s[a:b + 1]) / sum(w[a:b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "saw"])
def test_fit_is_exact_over_many_ranges(spark, shape, monkeypatch):
    rng = random.Random(shape)
    label = {"noise": lambda i: int(rng.random() < i / 90), "falling": lambda i: -i,
             "rising": lambda i: i, "saw": lambda i: i % 10}[shape]
    points = [(rng.choice([i, i, i + 0.5]) / 1.0, float(label(i))) for i in range(90) for _ in range(2)]
    monkeypatch.setattr(isotonic, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = isotonic.isotonic_blocks(spark.createDataFrame(points, "x double, y double"), "x", "y").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = by_hand(points)
    for b in blocks:
        inside = [x for x in want if b["lo"] <= x <= b["hi"]]
        assert [want[x] for x in inside] == pytest.approx([b["total"] / b["weight"]] * len(inside))
    assert sum(b["weight"] for b in blocks) == len(points)


def test_rows_that_take_no_part(rows):
    nan = float("nan")
    df = rows("x double, y double, w double", (1.0, 1.0, 1.0), (2.0, 0.0, 3.0), (None, 1.0, 1.0), (nan, 1.0, 1.0),
              (3.0, None, 1.0), (3.0, nan, 1.0), (3.0, 0.0, 0.0), (3.0, 0.0, None))
    blocks = isotonic.isotonic_blocks(df, "x", "y", "w").collect()
    assert [(b["lo"], b["hi"], b["total"], b["weight"]) for b in blocks] == [(1.0, 2.0, 1.0, 4.0)]
    assert isotonic.isotonic_blocks(df.limit(0), "x", "y").collect() == []


@pytest.mark.parametrize("leaf", [1, 64])
def test_lookup_interpolates(spark, leaf, monkeypatch):
    monkeypatch.setattr(isotonic, "LEAF_KNOTS", leaf)
    rng = np.random.default_rng(3)
    xs = np.unique(np.round(rng.random(40), 3))
    ys = np.sort(rng.random(len(xs)))
    table = spark.createDataFrame([(float(x), float(y)) for x, y in zip(xs, ys)], "x double, y double")
    values = [*map(float, rng.random(200)), -1.0, 2.0, *map(float, xs)]
    df = spark.createDataFrame([(i, v, 7) for i, v in enumerate([*values, None, float("nan")])], "i int, p double, x int")
    got = {r["i"]: r["p"] for r in isotonic.interpolated(df, "p", table).collect()}
    assert [got[i] for i in range(len(values))] == pytest.approx(list(np.interp(values, xs, ys)), abs=1e-12)
    assert got[len(values)] is None and np.isnan(got[len(values) + 1])
    assert isotonic.interpolated(df, "p", table).columns == df.columns


def test_lookup_without_knots_and_with_one(rows):
    df = rows("p double", (0.3,), (0.9,))
    one = rows("x double, y double", (0.5, 0.25))
    assert [r["p"] for r in isotonic.interpolated(df, "p", one).collect()] == [0.25, 0.25]
    assert [r["p"] for r in isotonic.interpolated(df, "p", one.limit(0)).collect()] == [None, None]


def test_no_knot_is_in_the_plan(spark):
    table = spark.range(5000).select((F.col("id") / 7).alias("x"), (F.col("id") / 5000).alias("y"))
    plan = isotonic.interpolated(spark.range(3).select(F.col("id").cast("double").alias("p")), "p", table)
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_lookup_searches_plain_columns(spark):
    """The leaf's numbers are not taken out of the knots anew in every step of a row's search."""
    table = spark.range(5000).select((F.col("id") / 7).alias("x"), (F.col("id") / 5000).alias("y"))
    plan = isotonic.interpolated(spark.range(3).select(F.col("id").cast("double").alias("p")), "p", table)
    assert "transform(_knots" not in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sent", [0, 100_000])
def test_lookup_is_the_same_whether_knots_are_sent_or_not(spark, sent, monkeypatch):
    monkeypatch.setattr(isotonic, "SENT_KNOTS", sent)
    table = spark.range(300).select((F.col("id") / 300).alias("x"), (F.col("id") / 300).alias("y"))
    df = spark.range(-5, 310).select((F.col("id") / 310).alias("p"), (F.col("id") / 310).alias("want"))
    far = F.abs(F.col("p") - F.least(F.greatest("want", F.lit(0.0)), F.lit(299 / 300))) > 1e-12
    assert isotonic.interpolated(df, "p", table).filter(far).count() == 0


def test_falls_are_counted_within_and_between_pieces(spark, rows):
    table = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 1250).cast("double").alias("y"))
    assert isotonic.falls(table).first()["falls"] == 3
    assert isotonic.falls(table.filter("id < 1250")).first()["falls"] == 0
    assert isotonic.falls(rows("x double, y double", (1.0, 0.9), (1.001, 0.2), (900.0, 0.1), (901.0, 0.1))).first()["falls"] == 2
    assert isotonic.falls(table.limit(0)).first()["falls"] == 0

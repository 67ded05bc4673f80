"""Trees grown as tables: properties of the fit, and the nodes walked by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import boosting
from wakeline.operators.boosting import Params

DDL = "i int, a double, b int, y int"


def sample(n=600):
    rng = random.Random(9)
    out = []
    for i in range(n):
        a, b = rng.choice([None, float("nan"), rng.random(), rng.random()]), rng.randint(0, 5)
        chance = 0.8 if a is None or a != a else 0.7 * a + 0.05 * b
        out.append((i, a, b, int(rng.random() < chance)))
    return out


SMALL = Params(trees=4, depth=3, rate=0.4, l2=1.0, min_rows=10)


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(sample(), DDL)
    cuts = boosting.quantile_cuts(df, ["a", "b"], bins=8)
    return df, cuts, boosting.fit(df, cuts, "y", SMALL)


def walked(nodes, row):
    """The margin of one row by following the table."""
    table = {(r["tree"], r["node"]): r for r in nodes}
    total = 0.0
    for tree in {t for t, _ in table}:
        at = table[tree, 1]
        while at["feature"] is not None:
            x = row[at["feature"]]
            missing = x is None or x != x
            left = at["missing_left"] if missing else x < at["threshold"] or at["threshold"] == math.inf
            at = table[tree, 2 * at["node"] + (not left)]
        total += at["value"]
    return total


def test_margins_follow_the_nodes(fitted):
    df, _, nodes = fitted
    rows = nodes.collect()
    for r in df.withColumn("m", boosting.margin(nodes)).collect():
        assert r["m"] == walked(rows, r)


def test_it_learns_and_missing_values_count(fitted):
    df, _, nodes = fitted
    chance = 1 / (1 + F.exp(-boosting.margin(nodes)))
    scored = df.select("y", chance.alias("p"), (F.col("a").isNull() | F.isnan("a")).alias("none"))
    loss = scored.agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]
    rate = df.agg(F.avg("y")).first()[0]
    assert loss < 0.95 * rate * (1 - rate)
    means = {r["none"]: r["p"] for r in scored.groupBy("none").agg(F.avg("p").alias("p")).collect()}
    assert means[True] > means[False] + 0.1
    assert {r["feature"] for r in boosting.gains(nodes).collect()} == {"a", "b"}
    assert min(r["rows"] for r in nodes.collect()) >= SMALL.min_rows


def test_rows_anywhere_give_the_same_trees(fitted):
    df, cuts, nodes = fitted
    shuffled = df.orderBy(F.xxhash64("i")).repartition(7)
    again = boosting.fit(shuffled, cuts, "y", SMALL)
    key = lambda r: (r["tree"], r["node"])
    assert sorted(nodes.collect(), key=key) == sorted(again.collect(), key=key)


def test_early_stop_and_empty_tables(spark, fitted):
    df, cuts, _ = fitted
    flipped = df.withColumn("y", 1 - F.col("y"))
    nodes = boosting.fit(df, cuts, "y", Params(trees=6, depth=2, rate=0.4, min_rows=10, patience=1), holdout=flipped)
    assert nodes.agg(F.max("tree")).first()[0] == 0  # the second tree was already worse
    none = boosting.fit(df.limit(0), cuts, "y", SMALL)
    assert none.count() == 0 and df.select(boosting.margin(none).alias("m")).distinct().collect() == [(0.0,)]
    same = df.withColumn("y", F.lit(1))
    assert boosting.fit(same.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(1)), cuts, "y", SMALL).filter("feature is not null").count() == 0

"""Chunked prefixes against plain loops, with keys far above the chunk limit."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators import prefix
from wakeline.operators.prefix import (
    Family, Measure, carry_forward, chunk_depths, ordinals, running, running_strict,
)

START = datetime(2024, 1, 1)


def sample(n, seed, hot_share=0.4):
    """Rows (id, k, sub, ts, v); one key holds a large share, any but id and sub may be NULL."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = 1 if rng.random() < hot_share else rng.choice([2, 3, 4, None])
        ts = START + timedelta(minutes=rng.randrange(60 * 72)) if rng.random() > 0.15 else None
        out.append((i, k, rng.randrange(2), ts, rng.choice([None, rng.randrange(100)])))
    return out


@pytest.fixture
def frame(spark):
    def make(data):
        df = spark.createDataFrame(data, "id INT, k INT, sub INT, ts TIMESTAMP, v INT")
        return df.withColumns({"day": F.to_date("ts"), "hour": F.date_trunc("hour", "ts")})

    return make


LEVELS = [["day"], ["hour"]]


def instant(row):
    """A missing instant comes before all others."""
    return row[3] or datetime.min


def expected(data, key, how, inclusive=False, strict=False):
    out = {}
    ordered = sorted(data, key=lambda r: (instant(r), r[0]))
    for i, row in enumerate(ordered):
        seen = [
            r[4] for j, r in enumerate(ordered)
            if key(r) == key(row) and r[4] is not None
            and ((instant(r) < instant(row)) if strict else (j <= i if inclusive else j < i))
        ]
        total = {"sum": sum(seen), "max": max(seen, default=None), "last": seen[-1] if seen else None}
        out[row[0]] = total[how] if how != "sum" or seen else None
    return out


@pytest.mark.parametrize("hot_rows", [10_000, 60, 5])
@pytest.mark.parametrize("how", ["sum", "max", "last"])
def test_chunking_does_not_change_results(frame, how, hot_rows):
    data = sample(300, seed=hot_rows)
    families = [
        Family((), (Measure("a", F.col("v"), how),)),
        Family(("sub",), (Measure("b", F.col("v"), how),)),
    ]
    got = running(frame(data), ["k"], families, ["ts", "id"], LEVELS, hot_rows=hot_rows).collect()
    assert len(got) == len(data)
    a, b = expected(data, lambda r: r[1], how), expected(data, lambda r: (r[1], r[2]), how)
    assert {r["id"]: r["a"] for r in got} == a
    assert {r["id"]: r["b"] for r in got} == b


@pytest.mark.parametrize("hot_rows", [10_000, 5])
def test_global_prefix(frame, hot_rows):
    data = sample(200, seed=1)
    family = Family((), (Measure("a", F.col("v")),))
    got = running(frame(data), [], [family], ["ts", "id"], LEVELS, hot_rows=hot_rows).collect()
    assert {r["id"]: r["a"] for r in got} == expected(data, lambda r: 0, "sum")


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_strictly_earlier_instants(frame, hot_rows):
    data = sample(250, seed=2)
    data += [(1000 + i, 1, 0, data[0][3], 7) for i in range(10)]  # ties at one instant
    want = expected(data, lambda r: r[1], "sum", strict=True)
    measure = Measure("a", F.col("v"))
    by_window = running(frame(data), ["k"], [Family((), (measure,))], ["ts"], [["day"]],
                        instant="ts", hot_rows=hot_rows).collect()
    by_totals = running_strict(frame(data), ["k"], [measure], [["day"], ["ts"]]).collect()
    assert {r["id"]: r["a"] for r in by_window} == want
    assert {r["id"]: r["a"] for r in by_totals} == want


def test_depths_follow_the_largest_key(frame):
    df = frame(sample(300, seed=3))
    assert chunk_depths(df, [["k"], []], LEVELS, 1_000) == {("k",): 0, (): 1}
    assert chunk_depths(df, [["k"], []], LEVELS, 60) == {("k",): 1, (): 2}
    assert chunk_depths(df, [["k"]], LEVELS, 5) == {("k",): 2}


@pytest.mark.parametrize("hot_rows", [1_000, 10])
def test_carry_forward_includes_the_row(frame, hot_rows):
    data = sample(150, seed=4)
    got = carry_forward(frame(data), ["k"], ["ts", "id"], {"c": F.col("v")}, LEVELS,
                        hot_rows=hot_rows).collect()
    assert {r["id"]: r["c"] for r in got} == expected(data, lambda r: r[1], "last", inclusive=True)


@pytest.mark.parametrize("hot_rows", [1_000, 30])
def test_ordinals(frame, hot_rows):
    data = sample(200, seed=5)
    df = frame(data).withColumn("down", -F.col("id")).withColumn("down10", F.floor(F.col("down") / 10))
    got = ordinals(df, ["k"], {"up": (["ts", "id"], LEVELS), "rev": (["down"], [["down10"]])},
                   hot_rows=hot_rows).collect()
    for key in {r[1] for r in data}:
        mine = sorted((r for r in data if r[1] == key), key=lambda r: (instant(r), r[0]))
        assert {r["id"]: r["up"] for r in got if r["k"] == key} == {
            r[0]: i for i, r in enumerate(mine, 1)}
        back = sorted((r for r in data if r[1] == key), key=lambda r: -r[0])
        assert {r["id"]: r["rev"] for r in got if r["k"] == key} == {
            r[0]: i for i, r in enumerate(back, 1)}


def test_keys_are_counted_by_hash_before_they_are_counted_one_by_one(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("ts"))
    monkeypatch.setattr(prefix, "HASHED", 10)
    asked = []
    largest = prefix._largest

    def spy(df, keyed):
        asked.append(list(keyed.values()))
        return largest(df, keyed)

    monkeypatch.setattr(prefix, "_largest", spy)
    assert chunk_depths(df, [["k"]], [["ts"]], hot_rows=3000) == {("k",): 0}
    assert len(asked) == 1 and not isinstance(asked[0][0][0], str)  # no key was counted by itself
    # many small keys of one hash are not taken for a hot one, and a hot one is found
    assert chunk_depths(df, [["k"]], [["ts"]], hot_rows=100) == {("k",): 0}
    hot = df.unionByName(df.withColumn("k", F.lit(None).cast("long")))
    assert chunk_depths(hot, [["k"]], [["ts"]], hot_rows=3000) == {("k",): 1}

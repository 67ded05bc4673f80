"""Nearest neighbours by stable random projections in a kd-tree, with a statistical stop.

Vectors are projected to a few dimensions by a Gaussian (2-stable) matrix, so the squared distance
of two projections over the squared true distance follows a chi-square law with as many degrees of
freedom. Projected points lie in a kd-tree, whose upper cells are shuffle keys and whose leaves are
built inside each cell. A query meets projected neighbours in growing order and verifies them on
the original vectors, until a point as near as its k-th best would, with probability CONFIDENCE,
already have been met. The test is applied to whole cells as well: cells that pass it are never sent
the query.

Largest inner product becomes smallest distance by one added coordinate that gives every vector the
same length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.common import map_rows
from wakeline.session import staged

DIMS, CONFIDENCE, SEED = 10, 0.97, 7
#: Vectors of one part of a cell, and queries that meet it together.
PART_ROWS, QUERY_ROWS = 4096, 2048
#: Vectors of a leaf, and leaves verified between two tests.
LEAF_ROWS, LEAVES_AT_ONCE = 64, 8
#: The cells are cut on a sample of about so many vectors; every vector is indexed.
SAMPLE_ROWS, MAX_DEPTH = 16_384, 11


def chi_square_bound(confidence: float, dims: int) -> float:
    """x with P(chi-square of ``dims`` (even) degrees <= x) = confidence, by halving."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


def projection(dim: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """The matrix for vectors of ``dim`` components and the added one."""
    return np.random.default_rng(seed).standard_normal((dim + 1, dims))


def extended(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the added coordinate, where ``largest`` is the largest squared length."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))])


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _cut(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits of a complete kd-tree in heap order: widest dimension, at its middle value."""
    splits: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for part in level:
            if len(part):
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                value = float(np.median(part[:, axis]))
            else:
                axis, value = 0, 0.0
            splits.append((axis, value))
            right = part[:, axis] > value
            below += [part[~right], part[right]]
        level = below
    return splits


def _cells(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    axes = np.array([a for a, _ in splits], dtype=np.int64)
    values = np.array([v for _, v in splits])
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range((len(splits) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > values[node])
    return node - len(splits)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree over one part."""
    done, waiting = [], [np.arange(len(points))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= LEAF_ROWS:
            done.append(rows)
            continue
        inside = points[rows]
        axis = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
        order = np.argpartition(inside[:, axis], len(rows) // 2)
        waiting += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return done


def _box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(0.0, np.maximum(low - point, point - high))
    return (gap * gap).sum(axis=-1)


def _exact(ids, x, rows, query, k) -> tuple[np.ndarray, np.ndarray]:
    """The k best of some rows by exact score, ties to the smaller id."""
    scores = (x[rows] * query).sum(axis=1)  # row by row, so that equal vectors score alike
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]


def _worth(rough: np.ndarray, least: float) -> np.ndarray:
    """Rows that may reach a score, allowing for rounding."""
    return rough >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else np.isfinite(rough)


def search_part(ids: np.ndarray, x: np.ndarray, projected: np.ndarray, queries: list[tuple], k: int,
                largest: float, bound: float) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) found in one part, for queries (id, vector, projection, floor).

    ``floor`` is a score that k vectors elsewhere reach already, or minus infinity.
    """
    leaves = _leaves(projected)
    low = np.stack([projected[r].min(axis=0) for r in leaves])
    high = np.stack([projected[r].max(axis=0) for r in leaves])
    out = []
    for query_id, query, point, floor in queries:
        near = _box_distance(low, high, point)
        order = np.argsort(near, kind="stable")
        length = float(query @ query)
        rows, rough, kth = np.empty(0, dtype=np.int64), np.empty(0), floor
        for at in range(0, len(order), LEAVES_AT_ONCE):
            reach = length + largest - 2 * kth  # squared distance of the k-th best so far
            if near[order[at]] >= bound * reach:
                break
            new = np.concatenate([leaves[i] for i in order[at:at + LEAVES_AT_ONCE]])
            new = new[ids[new] != query_id]
            rows, rough = np.concatenate([rows, new]), np.concatenate([rough, x[new] @ query])
            if len(rows) >= k:
                kth = max(kth, float(np.partition(rough, len(rough) - k)[len(rough) - k]))
            keep = _worth(rough, kth)
            rows, rough = rows[keep], rough[keep]
        rows, scores = _exact(ids, x, rows, query, k)
        out += [(query_id, int(ids[r]), float(s)) for r, s in zip(rows, scores)]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, dims: int = DIMS,
           confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found per query.

    ``vectors``: vec_id and embedding; ``is_query`` is a condition on them. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do null ids. Shorter vectors
    are taken as ending in zeros. Of rows that repeat a vec_id the largest vector counts. Scores are
    double-precision products of the original vectors; ties go to the smaller vec_id. All of fewer
    than k candidates are returned; a lone query has none.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("_asked", F.coalesce(is_query, F.lit(False)))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "_asked")
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("x")))
    rows = staged(rows.groupBy("vec_id").agg(F.max("x").alias("x"), F.max("_asked").alias("asked")), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(square).alias("largest"),
                     F.sum(F.col("asked").cast("long")).alias("asked")).first()
    n, dim, largest = about["n"], about["dim"], about["largest"]
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    bound = chi_square_bound(confidence, dims)
    matrix = projection(dim, dims)

    def full(columns) -> np.ndarray:
        x = np.zeros((len(columns), dim))
        for i, v in enumerate(columns):
            x[i, :len(v)] = v
        return x

    # the upper kd-tree, cut on a sample of bounded size
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(n / PART_ROWS))))
    sample = (rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0)
              .select("x").limit(2 * SAMPLE_ROWS).collect())
    splits = _cut(extended(full([r["x"] for r in sample]), largest) @ matrix, depth)

    def make():
        def work(columns):
            x = full(columns[1])
            # a query has no added coordinate; cells are those of the vector
            points, asking = extended(x, largest) @ matrix, x @ matrix[:dim]
            return [columns[0], list(x), list(points), list(asking), _cells(points, splits), columns[2]]

        return work

    index = staged(map_rows(rows, make, "vec_id long, x array<double>, point array<double>, "
                                        "asking array<double>, cell long, asked boolean"), "index")
    bounds = index.groupBy("cell").agg(
        F.count("*").alias("n"), *[f(F.get("point", F.lit(i))).alias(f"{m}{i}") for i in range(dims)
                                   for m, f in (("low", F.min), ("high", F.max))]).collect()  # at most 2**MAX_DEPTH
    cells = sorted((r["cell"], max(1, -(-r["n"] // PART_ROWS)), [r[f"low{i}"] for i in range(dims)],
                    [r[f"high{i}"] for i in range(dims)]) for r in bounds)
    parts = spark.createDataFrame([(c, p) for c, p, _, _ in cells], "cell long, parts long")
    placed = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))

    found_schema = "query_id long, vec_id long, score double"

    def meet(key: tuple, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(data) and len(queries):
            asked = list(zip(queries["q_vec_id"].tolist(), np.stack(queries["q_x"]), np.stack(queries["q_asking"]),
                             queries["q_floor"].tolist()))
            found = search_part(data["vec_id"].to_numpy(), np.stack(data["x"]), np.stack(data["point"]),
                                asked, k, largest, bound)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def together(data: DataFrame, queries: DataFrame) -> DataFrame:
        keys = ["cell", "part", "turn"]
        # both sides stem from one table: other names keep them apart
        asking = queries.select(*[F.col(c).alias(f"q_{c}") for c in (*keys, "vec_id", "x", "asking", "floor")])
        return (data.select(*keys, "vec_id", "x", "point").groupBy(*keys)
                .cogroup(asking.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(meet, found_schema))

    # a first look at home gives every query a score to beat
    turns = max(1, -(-(about["asked"] or 0) // QUERY_ROWS))
    turn = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(turns))
    spread = placed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
    asking = placed.filter("asked").withColumn("turn", turn)
    home = staged(together(spread, asking.withColumn("floor", F.lit(float("-inf")))), "home")
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("reached"))
    queries = asking.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("reached", F.lit(float("-inf"))))

    # then on to the other parts of every cell that the test does not rule out
    low, high = np.array([c[2] for c in cells]), np.array([c[3] for c in cells])

    def make_routes():
        def work(columns):
            out: list[list] = []
            for x, point, floor in zip(columns[1], columns[2], columns[3]):
                reach = bound * (float(np.dot(x, x)) + largest - 2 * floor)
                near = _box_distance(low, high, np.asarray(point))
                out.append([c[0] for c, d in zip(cells, near) if d < reach])
            return [columns[0], out]

        return work

    routes = map_rows(queries.select("vec_id", "x", "asking", "floor"), make_routes, "vec_id long, cells array<long>")
    homes = queries.select("vec_id", "x", "asking", "floor", "turn", F.col("cell").alias("home"), F.col("part").alias("home_part"))
    sent = (homes.join(routes, "vec_id").withColumn("cell", F.explode("cells")).join(F.broadcast(parts), "cell")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .filter((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part"))))
    found = home.unionByName(together(spread, sent))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

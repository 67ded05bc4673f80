"""Exact top-k search by inner product in a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it. The vectors of a pivot, sorted
by that distance, are cut into rings, which are the shuffle keys, and each ring into thin annuli. A
query first meets the ring that promises most, which gives it a score to beat, and then only rings
and annuli whose best possible score, by the triangle inequality, is not below that score. Annuli are
met outwards from the query's own distance, so the stop comes early where the data allow one.

Largest inner product becomes smallest distance by one added coordinate that gives every vector the
same length. Bounds are taken in doubles with an allowance for rounding; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.session import staged

#: Rows of a ring and of one part of it, pivots, and rings of one pivot (both at most).
RING_ROWS, MAX_PIVOTS, MAX_RINGS = 8192, 64, 256
#: Queries that meet a part together, and rows of an annulus.
QUERY_ROWS, ANNULUS_ROWS = 2048, 512
#: Pivots are chosen from a sample of about so many vectors; every vector is indexed.
SAMPLE_ROWS = 4096
#: Up to this sum of products doubles are exact.
EXACT = 2.0 ** 53
LONG_MIN, LONG_MAX = -2 ** 63, 2 ** 63 - 1
FOUND = "query_id long, vec_id long, score long"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def packed(vectors: DataFrame, is_query: Column, scale: int) -> DataFrame:
    """vec_id, v (integers as little-endian doubles), asked: one row per id, of usable vectors."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) == float("inf")))
    rows = vectors.withColumn("_asked", F.coalesce(is_query, F.lit(False)))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("x"))
            # adding 0.0 turns a negative zero into a plain one
            raw = (np.floor(values * scale) + 0.0).astype("<f8").tobytes()
            v = [raw[8 * a:8 * b].rstrip(b"\0") for a, b in zip(offsets[:-1], offsets[1:])]
            v = [b + b"\0" * (-len(b) % 8) for b in v]  # zeros at the end say nothing
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), pa.array(v, pa.binary()), batch.column("asked")],
                names=["vec_id", "v", "asked"])

    rows = rows.select("vec_id", x.alias("x"), F.col("_asked").alias("asked"))
    rows = rows.mapInArrow(pack, "vec_id long, v binary, asked boolean")
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"), F.max("asked").alias("asked"))


def matrix(column: list[bytes], dim: int) -> np.ndarray:
    """Rows of ``dim`` doubles; shorter vectors end in zeros."""
    return np.frombuffer(b"".join(b.ljust(8 * dim, b"\0") for b in column), "<f8").reshape(len(column), dim)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the added coordinate, where ``largest`` is the largest squared length."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.column_stack([x, np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))])


@np.errstate(invalid="ignore", over="ignore")
def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, square))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled point farthest from those before it."""
    chosen = [int(np.argmax(distances(sample, sample.mean(axis=0)[None])[:, 0]))]
    nearest = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def best_score(from_pivot: np.ndarray, low, high, square, largest: float) -> np.ndarray:
    """No vector whose distance from the pivot lies in [low, high] scores above this.

    ``from_pivot`` is the query's distance from the pivot, ``square`` its squared length.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.maximum(0.0, np.maximum(from_pivot - high, low - from_pivot))
        best = (square + largest - gap * gap) / 2 + 0.5 + 1e-5 * (square + largest)
    return np.where(np.isnan(best), np.inf, best)  # lengths beyond a double rule nothing out


def scores(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, one row per query; beyond a long they stop at its limits."""
    if len(x) and len(queries) and x.shape[1] * np.abs(x).max() * np.abs(queries).max() >= EXACT:
        whole = [[int(v) for v in row] for row in x]
        out = [[sum(a * b for a, b in zip(row, q)) for row in whole] for q in ([int(v) for v in q] for q in queries)]
        return np.array([[min(max(s, LONG_MIN), LONG_MAX) for s in row] for row in out], dtype=np.int64)
    return (queries @ x.T).astype(np.int64)


def search_part(ids: np.ndarray, x: np.ndarray, far: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                from_pivot: np.ndarray, floors: np.ndarray, k: int, largest: float,
                met: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best of one part for each query that can still use them.

    ``far`` are the rows' distances from the pivot, ``floors`` scores that k other vectors reach.
    ``met`` gets the number of scores taken.
    """
    order = np.lexsort((ids, far))
    ids, x, far = ids[order], x[order], far[order]
    starts = np.arange(0, len(ids), ANNULUS_ROWS)
    low, high = far[starts], far[np.minimum(starts + ANNULUS_ROWS, len(ids)) - 1]
    square = (queries * queries).sum(axis=1)
    floor, last = floors.copy(), np.full(len(queries), LONG_MAX)
    pool = [np.empty(0, np.int64)] * 3  # query row, vector row, score
    middle = np.median(from_pivot) if len(queries) else 0.0
    for a in np.argsort(np.maximum(0.0, np.maximum(middle - high, low - middle)), kind="stable"):
        live = np.flatnonzero(best_score(from_pivot, low[a], high[a], square, largest) >= floor)
        if not len(live):
            continue
        rows = np.arange(starts[a], min(starts[a] + ANNULUS_ROWS, len(ids)))
        got = scores(x[rows], queries[live])
        if met is not None:
            met.append(got.size)
        good = (got > floor[live, None]) | ((got == floor[live, None]) & (ids[rows] < last[live, None]))
        good &= ids[rows] != query_ids[live, None]
        i, j = np.nonzero(good)
        if not len(i):
            continue
        pool = [np.concatenate(p) for p in zip(pool, (live[i], rows[j], got[i, j]))]
        best = np.lexsort((ids[pool[1]], -pool[2], pool[0]))
        pool = [p[best] for p in pool]
        first = np.searchsorted(pool[0], pool[0])  # where each query's rows begin
        rank = np.arange(len(first)) - first
        pool = [p[rank < k] for p in pool]
        rank = rank[rank < k]
        full = rank == k - 1
        floor[pool[0][full]], last[pool[0][full]] = pool[2][full], ids[pool[1][full]]
    return query_ids[pool[0]], ids[pool[1]], pool[2]


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
           ring_rows: int = RING_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest integer inner product per query.

    ``vectors``: vec_id and embedding; ``is_query`` is a condition on them. A component x counts as
    floor(scale * x). Vectors that are null or hold null or non-finite components (before or after
    scaling) take no part, nor do null ids. Shorter vectors end in zeros, so an empty one scores 0.
    Of rows that repeat a vec_id one definite vector counts, and it is a query if any of them is.
    Ties go to the smaller vec_id. All of fewer than k candidates are returned; a lone query has
    none. Scores beyond a long stop at its limits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = staged(packed(vectors, is_query, scale), "vectors")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v").to_pylist()
            square = [float(np.dot(x, x)) for x in (np.frombuffer(b, "<f8") for b in column)]
            yield pa.RecordBatch.from_arrays([pa.array([len(b) // 8 for b in column], pa.int32()), pa.array(square, pa.float64())],
                                             names=["dim", "square"])

    about = rows.select("v").mapInArrow(measure, "dim int, square double").agg(
        F.count("*").alias("n"), F.max("dim").alias("dim"), F.max("square").alias("largest")).first()
    n, dim, largest = about["n"], about["dim"], about["largest"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = (rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0)
              .select("v").limit(2 * SAMPLE_ROWS).collect())
    sample = matrix([bytes(r["v"]) for r in sample], dim) if sample else np.zeros((1, dim))
    pivots = choose_pivots(lifted(sample, largest), min(MAX_PIVOTS, -(-n // ring_rows)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(lifted(matrix(batch.column("v").to_pylist(), dim), largest), pivots)
            pivot = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), batch.column("asked"), pa.array(pivot, pa.int64()),
                 pa.array(far[np.arange(len(far)), pivot], pa.float64())], names=["vec_id", "v", "asked", "pivot", "far"])

    index = staged(rows.mapInArrow(key, "vec_id long, v binary, asked boolean, pivot long, far double"), "index")

    # rings of about equal size per pivot; what comes to the driver is one row per ring at most
    most = index.groupBy("pivot").count().agg(F.max("count")).first()[0]
    per_pivot = min(MAX_RINGS, -(-most // ring_rows))
    at = [i / per_pivot for i in range(1, per_pivot)]
    cuts = index.groupBy("pivot").agg((F.percentile_approx("far", at, 10 * MAX_RINGS) if at else
                                       F.array().cast("array<double>")).alias("cuts"))
    cuts = spark.createDataFrame(cuts.collect(), "pivot long, cuts array<double>")
    inside = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    placed = index.join(F.broadcast(cuts), "pivot").withColumn("ring", F.col("pivot") * per_pivot + inside).drop("cuts")
    rings = placed.groupBy("ring", "pivot").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    rings = sorted((r["ring"], r["pivot"], -(-r["n"] // ring_rows), r["low"], r["high"]) for r in rings)
    names, of = np.array([r[0] for r in rings]), np.array([r[1] for r in rings])
    low, high = np.array([r[3] for r in rings]), np.array([r[4] for r in rings])

    def route(first: bool):
        """Rings of each query: the one that promises most, or all others that may hold better."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column("v").to_pylist(), dim)
                square = (q * q).sum(axis=1)
                from_pivot = distances(np.column_stack([q, np.zeros(len(q))]), pivots)[:, of]
                promise = best_score(from_pivot, low, high, square[:, None], largest)
                best = np.lexsort((from_pivot, -promise), axis=1)[:, 0]
                take = promise >= np.array(batch.column("floor").to_pylist(), dtype=float)[:, None]
                take[np.arange(len(q)), best] = False
                if first:
                    take[:] = False
                    take[np.arange(len(q)), best] = True
                i, j = np.nonzero(take)
                # a query may ask for many rings: not all its copies at once
                for s in range(0, len(i), 4096):
                    a, b = i[s:s + 4096], j[s:s + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(pa.array(a)), batch.column("v").take(pa.array(a)),
                         batch.column("floor").take(pa.array(a)), pa.array(from_pivot[a, b], pa.float64()), pa.array(names[b], pa.int64())],
                        names=["q_id", "q_v", "q_floor", "q_far", "q_ring"])
        return run

    parts = spark.createDataFrame([(r[0], r[2]) for r in rings], "ring long, parts long")
    data = placed.select("vec_id", "v", "far", "ring").join(F.broadcast(parts), "ring")
    data = data.withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))

    def meet(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [np.empty(0, np.int64)] * 3
        if len(rows) and len(asked):
            found = search_part(rows["vec_id"].to_numpy(), matrix(list(rows["v"]), dim), rows["far"].to_numpy(),
                                asked["q_id"].to_numpy(), matrix(list(asked["q_v"]), dim), asked["q_far"].to_numpy(),
                                asked["q_floor"].to_numpy(), k, largest)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    def together(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.select("vec_id", "v", "floor").mapInArrow(
            route(first), "q_id long, q_v binary, q_floor long, q_far double, q_ring long")
        sent = staged(sent, "routes")
        # a ring is repeated only for the blocks of queries that ask for it
        turns = sent.groupBy("q_ring").count().select(
            F.col("q_ring").alias("ring"), F.ceil(F.col("count") / query_rows).alias("turns"))
        sizes = F.broadcast(spark.createDataFrame(parts.join(turns, "ring").collect(), "ring long, parts long, turns long"))
        there = data.drop("parts").join(sizes, "ring").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
        coming = (sent.join(sizes.withColumnRenamed("ring", "q_ring"), "q_ring")
                  .withColumn("q_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                  .withColumn("q_turn", F.pmod(F.xxhash64("q_id"), "turns")))
        return (there.select("ring", "part", "turn", "vec_id", "v", "far").groupBy("ring", "part", "turn")
                .cogroup(coming.select("q_ring", "q_part", "q_turn", "q_id", "q_v", "q_floor", "q_far").groupBy("q_ring", "q_part", "q_turn"))
                .applyInPandas(meet, FOUND))

    asked = placed.filter("asked").withColumn("floor", F.lit(LONG_MIN).cast("long"))
    home = staged(together(asked, True), "home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
           .select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached")))
    rest = asked.drop("floor").join(kth, "vec_id", "left").withColumn("floor", F.coalesce("reached", F.lit(LONG_MIN).cast("long")))
    found = home.unionByName(together(rest, False))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""

"""Interaction audit of document filters: what each removes, in any order, and what it is worth.

Documents are only counted by the set of filters they fail. From that, the removals of all 2**n
coalitions of filters are tabulated per part. What a filter removes at a step of an order is the
difference of two coalitions. Its Shapley value is the solution of a least-squares fit to all
coalitions under the Shapley kernel, constrained to add up to what all filters remove together; the
normal equations are solved once, in rationals, and give integer weights of the coalitions.

Everything runs as DataFrame functions; Python only solves the equations of n unknowns.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import text_or_empty

NAMES = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
#: Fixed values: what separates words, and the characters that filter D looks for.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (capitals), D (symbols)."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [count < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * count,
            100 * capitals > MAX_CAPITAL_PERCENT * chars, text.rlike(SYMBOLS)]


def failed(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document; bit i of mask is set where it fails NAMES[i].

    Texts are compared by SHA-256. The first holder of a text is found by an aggregate, and rows are
    matched to it by text and doc_id together, so that no text shared by many gathers its rows.
    """
    bits = failures(F.col("text"))
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                            text_or_empty().alias("text"))
    mask = sum((F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)), F.lit(0))
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.groupBy(F.col("doc_id").alias("l_doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    firsts = rows.groupBy(F.col("digest").alias("f_digest")).agg(F.min("doc_id").alias("f_doc"))
    rows = rows.join(marks, F.col("doc_id") == F.col("l_doc"), "left")
    rows = rows.join(firsts, (F.col("digest") == F.col("f_digest")) & (F.col("doc_id") == F.col("f_doc")), "left")
    copy = F.col("f_doc").isNull() & F.col("doc_id").isNotNull()
    return rows.select("part", (F.col("mask") + F.when(copy, 1 << len(bits)).otherwise(0)).alias("mask"),
                       F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def coalitions(rows: DataFrame, filters: int) -> DataFrame:
    """part, documents, and for each of removed, good, toxic an array over all sets of filters.

    Entry s counts the documents (all, good, toxic) that fail at least one filter of set s.
    ``rows``: part, mask, good, toxic.
    """
    sets = 1 << filters
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    sums = [F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)).cast("long") for s in range(sets)]).alias(out)
            for c, out in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))]
    return counted.groupBy("part").agg(F.sum("n").alias("documents"), *sums)


def shapley_weights(filters: int) -> list[list[Fraction]]:
    """w with: the Shapley value of filter i is the sum over sets s of w[i][s] * v[s].

    Minimises the sum over proper sets s of kernel(s) * (v[s] - sum of the values in s)**2 subject to
    all values adding up to v[all]. The multiplier of that constraint is the last unknown.
    """
    if filters == 1:
        return [[Fraction(-1), Fraction(1)]]
    sets = 1 << filters
    inside = [[s >> i & 1 for i in range(filters)] for s in range(sets)]
    kernel = [Fraction(0)] * sets
    for s in range(1, sets - 1):
        size = sum(inside[s])
        kernel[s] = Fraction(filters - 1, math.comb(filters, size) * size * (filters - size))
    # one row per unknown: its coefficients, then a right-hand side for v being 1 at one set alone
    rows = [[2 * sum(kernel[s] * inside[s][i] * inside[s][j] for s in range(sets)) for j in range(filters)]
            + [Fraction(1)] + [2 * kernel[s] * inside[s][i] for s in range(sets)] for i in range(filters)]
    rows.append([Fraction(1)] * filters + [Fraction(0)] + [Fraction(int(s == sets - 1)) for s in range(sets)])
    size = filters + 1
    for c in range(size):
        pivot = next(r for r in range(c, size) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(size):
            if r != c:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[size:] for row in rows[:filters]]


def steps(table: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from the table of coalitions."""
    n, sets, orders = len(names), 1 << len(names), math.factorial(len(names))
    # summed over all orders the values are whole numbers, and so are these weights
    weights = [[int(w * orders) for w in row] for row in shapley_weights(n)]
    values = [sum((F.lit(w) * F.get("removed", F.lit(s)) for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in weights]
    every = F.get("removed", F.lit(sets - 1))
    unique = [every - F.get("removed", F.lit(sets - 1 - (1 << i))) for i in range(n)]
    rows = table.withColumn("values", F.array(*values)).withColumn("unique", F.array(*unique))
    rows = rows.withColumn("filter_order", F.explode(F.split(F.lit(",".join(map("".join, itertools.permutations(names)))), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def filter_at(i: Column) -> Column:
        return F.position(F.substr("filter_order", i, F.lit(1)), F.lit(names)) - 1

    def bit(i: Column) -> Column:
        return F.get(F.array(*[F.lit(1 << b) for b in range(n)]), filter_at(i))

    before = F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(n)), 2, F.col("step") - 1), F.lit(0), lambda a, i: a + bit(i))
    rows = rows.withColumn("filter", filter_at(F.col("step"))).withColumn("own", bit(F.col("step"))).withColumn("before", before)
    gain = {c: F.get(c, F.col("before") + F.col("own")) - F.get(c, F.col("before")) for c in ("removed", "good", "toxic")}
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("documents") - F.get("removed", F.col("before") + F.col("own"))).alias("kept"),
        gain["removed"].alias("removed"), (F.get("removed", F.col("own")) - gain["removed"]).alias("redundant"),
        F.get("unique", F.col("filter")).alias("unique_fails"), gain["good"].alias("good_lost"),
        gain["toxic"].alias("toxic_lost"), F.get("values", F.col("filter")).alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    For each part (value of source; null is the empty string), each of the 120 orders of the five
    filters and each step: documents kept after it, removed by it, failing its filter but removed
    earlier (redundant), failing no other filter (unique_fails), removed by it though good or being
    toxic by ``labels``, and its filter's Shapley value summed over all orders.

    Null texts are empty: they fail A only, and E if another row with an empty text has a smaller
    doc_id. A row without doc_id neither fails E nor makes another fail it; rows that repeat both
    doc_id and text fail it together or not at all. Of labels that repeat a doc_id any mark counts.
    An empty table gives no rows. Other columns are ignored.
    """
    return steps(coalitions(failed(documents, labels), len(NAMES)))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w
  FROM documents
), docs AS (
  SELECT d.doc_id, d.part,
         ['A', 'B', 'C', 'D', 'E'] AS names,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body),
          regexp_matches(body, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY body), false)] AS fails,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM words d LEFT JOIN labels l USING (doc_id)
), kinds AS (
  SELECT part, list_filter(names, lambda x, i: fails[i]) AS failed, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM docs GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), applied AS (
  SELECT part, failed, n, good, toxic, filter_order,
         list_min(list_transform(failed, lambda x: instr(filter_order, x))) AS gone FROM kinds, orders
), stepped AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step] AS f,
         coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone < step AND list_contains(failed, filter_order[step])), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = [filter_order[step]]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM applied, range(1, 6) AS s(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM stepped
"""

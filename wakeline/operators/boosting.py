"""Boosted trees as tables: trained by grouped histograms, scored by walking a table of nodes.

Features are read as bin numbers. A level of a tree is one aggregate over (node, feature, bin),
combined before the shuffle, so what is shuffled does not grow with the rows; the best split of each
node is picked from running sums over bins. Gradients and leaf values are rounded to fixed binary
fractions and summed as whole numbers, so a model does not depend on how the rows are spread over
tasks: the same rows give the same trees, bit for bit.

A missing value is a bin of its own and goes to the side that gains more.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.session import staged

#: Gradients are multiples of 1 / GRAIN, leaf values of 1 / LEAF_GRAIN.
GRAIN, LEAF_GRAIN = 1 << 16, 1 << 20
#: An ensemble of more nodes than this is not sent to every task.
MAX_NODES = 1 << 20

#: A node: its tree and number (root 1, children 2n and 2n + 1), a split (rows whose feature is below
#: the threshold go left, missing ones where ``missing_left`` says) or a leaf value, and the gain.
NODES = ("tree int, node int, feature string, threshold double, missing_left boolean, value double, "
         "gain double, rows long")


@dataclass(frozen=True)
class Params:
    trees: int = 60
    depth: int = 5
    rate: float = 0.1
    l2: float = 1.0
    min_rows: int = 200
    #: Stop when the hold-out has not improved for so many trees.
    patience: int = 10


def quantile_cuts(df: DataFrame, names: Sequence[str], bins: int = 64) -> dict[str, list[float]]:
    """Cut points per feature at even ranks; one row of at most ``bins`` numbers a feature returns."""
    at = [i / bins for i in range(1, bins)]
    value = {n: F.nanvl(F.col(n).cast("double"), F.lit(None)) for n in names}
    found = df.agg(*[F.percentile_approx(v, at, 100 * bins).alias(n) for n, v in value.items()]).first()
    return {n: sorted(set(found[n] or [])) for n in names}


def _bin(name: str, cuts: Sequence[float]) -> Column:
    """0 for a missing value, else 1 + the number of cuts at or below it."""
    value = F.nanvl(F.col(name).cast("double"), F.lit(None))
    above = F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)
    return F.when(value.isNull(), 0).otherwise(1 + above).cast("int")


def _histogram(rows: DataFrame) -> DataFrame:
    """node, f, b, g, h, n over the rows still to be split."""
    chance = 1.0 / (1.0 + F.exp(-F.col("margin")))
    g = F.floor((F.col("label") - chance) * GRAIN + 0.5).cast("long")
    h = F.floor(chance * (1.0 - chance) * GRAIN + 0.5).cast("long")
    cells = rows.select("node", g.alias("g"), h.alias("h"), F.posexplode("bins").alias("f", "b"))
    return cells.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def _worth(g: Column, h: Column, l2: float) -> Column:
    g, h = g.cast("double"), h.cast("double")
    return g * g / (h + l2 * GRAIN)


def best_splits(histogram: DataFrame, params: Params) -> DataFrame:
    """One row per node: its sums g, h, n and, where one gains, the split f, b, missing_left, gain.

    A split at b sends bins 1 to b left. Ties go to the first feature, then the lowest cut, then to
    missing values going right.
    """
    cell = Window.partitionBy("node", "f")
    up_to = cell.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums, zero = ("g", "h", "n"), F.lit(0).cast("long")
    rows = histogram.select("node", "f", "b", *sums, *[F.sum(c).over(cell).alias(f"all_{c}") for c in sums],
                            *[F.sum(F.when(F.col("b") > 0, F.col(c)).otherwise(zero)).over(up_to).alias(f"low_{c}") for c in sums],
                            *[F.sum(F.when(F.col("b") == 0, F.col(c)).otherwise(zero)).over(cell).alias(f"none_{c}") for c in sums])
    rows = rows.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    left = {c: F.col(f"low_{c}") + F.when(F.col("missing_left"), F.col(f"none_{c}")).otherwise(zero) for c in sums}
    right = {c: F.col(f"all_{c}") - left[c] for c in sums}
    gain = (_worth(left["g"], left["h"], params.l2) + _worth(right["g"], right["h"], params.l2)
            - _worth(F.col("all_g"), F.col("all_h"), params.l2))
    usable = (F.col("b") > 0) & (left["n"] >= params.min_rows) & (right["n"] >= params.min_rows) & (gain > 0)
    rows = rows.withColumn("gain", F.when(usable, gain))
    order = F.struct(F.col("gain"), -F.col("f"), -F.col("b"), ~F.col("missing_left"))
    best = F.max_by(F.struct("f", "b", "missing_left", "gain"), F.when(F.col("gain").isNotNull(), order))
    # every feature of a node holds the node's totals
    return rows.groupBy("node").agg(*[F.max(f"all_{c}").alias(c) for c in sums], best.alias("s")).select("node", *sums, "s.*")


def fit(df: DataFrame, cuts: Mapping[str, Sequence[float]], label: str, params: Params = Params(),
        holdout: DataFrame | None = None) -> DataFrame:
    """The nodes of an ensemble for the logit of ``label`` (0 or 1), as a staged table.

    ``cuts``: the ascending cut points of each feature, which also name the features and their
    order. Rows with a NULL label take no part. Per level, what returns to the driver is one row per
    node. With a hold-out, boosting stops once its log-loss has not improved for ``patience`` trees,
    and later trees are dropped. A table without rows gives an ensemble without trees.
    """
    spark, names = df.sparkSession, list(cuts)
    bins = F.array(*[_bin(n, cuts[n]) for n in names])

    def prepared(rows: DataFrame, held: bool) -> DataFrame:
        return (rows.filter(F.col(label).isNotNull())
                .select(F.col(label).cast("double").alias("label"), bins.alias("bins"), F.lit(0.0).alias("margin"), F.lit(held).alias("held")))

    rows = prepared(df, False) if holdout is None else prepared(df, False).unionByName(prepared(holdout, True))
    rows = staged(rows, "binned")
    nodes: list[tuple] = []
    best, best_trees = math.inf, 0
    for tree in range(params.trees):
        splits: dict[int, tuple] = {}
        leaves: dict[int, float] = {}
        for level in range(params.depth + 1):
            at = rows.filter(~F.col("held")).withColumn("node", _position(splits))
            if leaves:
                at = at.filter(~F.col("node").isin(list(leaves)))
            found = sorted(best_splits(_histogram(at), params).collect())  # at most 2 ** level rows
            for r in found:
                if r["f"] is None or level == params.depth:
                    value = math.floor(params.rate * r["g"] / (r["h"] + params.l2 * GRAIN) * LEAF_GRAIN + 0.5) / LEAF_GRAIN
                    leaves[r["node"]] = value
                    nodes.append((tree, r["node"], None, None, None, value, None, r["n"]))
                else:
                    splits[r["node"]] = (r["f"], r["b"], r["missing_left"])
                    name = names[r["f"]]
                    threshold = float(cuts[name][r["b"] - 1]) if r["b"] <= len(cuts[name]) else math.inf
                    nodes.append((tree, r["node"], name, threshold, r["missing_left"], None, r["gain"] / GRAIN, r["n"]))
            if all(r["node"] in leaves for r in found):
                break
        if not leaves:
            break
        values = F.create_map(*[F.lit(x) for pair in leaves.items() for x in pair])
        margin = F.col("margin") + F.element_at(values, _position(splits))
        rows = staged(rows.withColumn("margin", margin), "boosted")
        if holdout is not None:
            chance = 1.0 / (1.0 + F.exp(-F.col("margin")))
            loss = -F.avg(F.when(F.col("label") == 1, F.log(chance)).otherwise(F.log(1.0 - chance)))
            now = rows.filter("held").agg(loss).first()[0]
            if now is not None and now < best:
                best, best_trees = now, tree + 1
            elif now is not None and tree + 1 - best_trees >= params.patience:
                break
    kept = nodes if holdout is None or not best_trees else [n for n in nodes if n[0] < best_trees]
    return staged(spark.createDataFrame(kept, NODES), "nodes")


def _position(splits: Mapping[int, tuple]) -> Column:
    """The node a row of bins has reached, by the splits of one tree (at most 2 ** depth)."""
    def below(node: int) -> Column:
        if node not in splits:
            return F.lit(node)
        f, b, missing_left = splits[node]
        value = F.get("bins", F.lit(f))
        left = (value <= b) & (value > 0) if not missing_left else value <= b
        return F.when(left, below(2 * node)).otherwise(below(2 * node + 1))

    return below(1)


def read_nodes(nodes: DataFrame) -> dict[int, dict[int, tuple]]:
    """Nodes by tree and number; refuses an ensemble of more than MAX_NODES."""
    found = nodes.select("tree", "node", "feature", "threshold", "missing_left", "value").limit(MAX_NODES + 1).collect()
    if len(found) > MAX_NODES:
        raise ValueError(f"an ensemble of more than {MAX_NODES} nodes")
    trees: dict[int, dict[int, tuple]] = {}
    for tree, node, *rest in sorted(found, key=lambda r: (r["tree"], r["node"])):
        trees.setdefault(tree, {})[node] = tuple(rest)
    return trees


def margin(nodes: DataFrame, columns: Mapping[str, Column] | None = None) -> Column:
    """The sum of the leaf values a row reaches, as one generated expression.

    Features are the columns of the nodes' names, or what ``columns`` gives for a name. Without trees
    it is 0. A feature that is NULL or NaN is missing.
    """
    trees, columns = read_nodes(nodes), columns or {}

    def feature(name: str) -> Column:
        return F.nanvl(columns.get(name, F.col(name)).cast("double"), F.lit(None))

    def below(tree: dict[int, tuple], node: int) -> Column:
        name, threshold, missing_left, value = tree[node]
        if name is None:
            return F.lit(float(value))
        x = feature(name)
        left = F.lit(True) if threshold == math.inf else x < threshold
        left = F.when(x.isNull(), F.lit(bool(missing_left))).otherwise(left)
        return F.when(left, below(tree, 2 * node)).otherwise(below(tree, 2 * node + 1))

    return sum((below(tree, 1) for _, tree in sorted(trees.items())), F.lit(0.0))


def gains(nodes: DataFrame) -> DataFrame:
    """feature, gain, splits: what each feature's splits gained in all."""
    return nodes.filter(F.col("feature").isNotNull()).groupBy("feature").agg(
        F.sum("gain").alias("gain"), F.count("*").alias("splits"))

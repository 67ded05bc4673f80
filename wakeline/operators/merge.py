"""Unions, merges and latest-wins. Merges are aggregates, so hot keys combine early."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.quality import assert_unique
from wakeline.schema import SHUFFLE_SEED


def aligned_union(history: DataFrame, extra: DataFrame) -> DataFrame:
    """Append ``extra`` on the schema of ``history``: missing columns NULL, others cast."""
    have = set(extra.columns)
    aligned = extra.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in history.schema.fields
        ]
    )
    return history.unionByName(aligned)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row per key in a full order, whole."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def two_feed_merge(
    card: DataFrame,
    result: DataFrame,
    keys: Sequence[str],
    *,
    card_wins: Sequence[str] = (),
    result_wins: Sequence[str] = (),
    flags: tuple[str, str] = ("has_b", "has_k"),
) -> DataFrame:
    """Full outer merge of two feeds with one row per key each.

    Columns carried by both take the non-null value of the named feed first; the
    flags record which feeds described the key.
    """
    marked_card = card.withColumn(flags[0], F.lit(True))
    marked_result = result.withColumn(flags[1], F.lit(True))
    shared = [c for c in card.columns if c in result.columns and c not in keys]
    unruled = sorted(set(shared) - set(card_wins) - set(result_wins))
    if unruled:
        raise ValueError(f"no precedence given for columns of both feeds: {unruled}")
    renamed = marked_result.withColumnsRenamed({c: f"_k_{c}" for c in shared})
    joined = marked_card.join(renamed, list(keys), "full_outer")

    def pick(name: str) -> Column:
        mine, other = F.col(name), F.col(f"_k_{name}")
        return (F.coalesce(mine, other) if name in card_wins else F.coalesce(other, mine)).alias(name)

    columns = [pick(c) if c in shared else F.col(c) for c in card.columns if c not in keys]
    extra = [c for c in result.columns if c not in card.columns]
    return joined.select(
        *keys, *columns, *extra, *[F.coalesce(f, F.lit(False)).alias(f) for f in flags]
    )


def keyed_merge(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    *,
    order: Sequence[str] = (),
    replace: Sequence[str] = (),
    either: Sequence[str] = (),
) -> DataFrame:
    """Upsert: one row per key, incoming values over stored ones.

    By default the newest non-null value is kept, so an absent value never erases a
    stored one. ``replace`` columns take the newest row even when NULL; ``either``
    flags are OR-ed. Repeated incoming keys are resolved by ``order``. Replaying the
    same input changes nothing.
    """
    columns = [c for c in target.columns if c not in keys]
    blank = [F.lit(None).cast(incoming.schema[c].dataType).alias(c) for c in order]
    stored = target.select(*target.columns, F.lit(0).alias("_side"),
                           F.struct(F.lit(0), *blank).alias("_seq"))
    fresh = incoming.select(*target.columns, F.lit(1).alias("_side"),
                            F.struct(F.lit(0), *order).alias("_seq"))
    seq = F.struct("_side", "_seq")

    def keep(name: str) -> Column:
        value = F.col(name)
        if name in either:
            return F.bool_or(F.coalesce(value, F.lit(False)))
        if name in replace:
            return F.max_by(value, seq)
        return F.max_by(value, F.when(value.isNotNull(), seq))

    return (
        stored.unionByName(fresh)
        .groupBy(*keys)
        .agg(*[keep(c).alias(c) for c in columns])
        .select(*target.columns)
    )


def not_recorded(known: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known keys without a record."""
    return known.join(recorded.select(*keys), list(keys), "left_anti")


def union_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys over several logs."""
    return reduce(DataFrame.unionByName, [f.select(*keys) for f in frames]).distinct()


def shuffled_prefix(
    df: DataFrame, key: str, limit: int | None = None, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """A fixed random order in which every prefix is an unbiased sample.

    The order depends on key and seed only, not on how the input arrives. With a
    limit this is a top-k, not a full sort.
    """
    ordered = df.orderBy(F.md5(F.concat(F.col(key), F.lit(f"#{seed}"))), key)
    return ordered if limit is None else ordered.limit(limit)


def join_preserving(
    rows: DataFrame, context: DataFrame, keys: Sequence[str], *, check: bool = True
) -> DataFrame:
    """Left join that cannot change the row count: the right key is checked first."""
    if check:
        assert_unique(context, keys, "join context")
    return rows.join(context, list(keys), "left")


def feed_disagreements(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Rows of both feeds whose values differ (NULL equals NULL)."""
    a, b = left.select(*keys, *columns), right.select(
        *keys, *[F.col(c).alias(f"other_{c}") for c in columns]
    )
    differ = reduce(
        lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in columns]
    )
    return a.join(b, list(keys)).filter(differ)


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found in one feed only, with the side that has them."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        tagged.groupBy(*keys)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .filter(F.col("l") != F.col("r"))
        .select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))
    )

"""Ordered prefix aggregates that stay distributed for any key distribution.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key in one task, so
a key with a third of the rows is one task with a third of the rows, and a
global prefix is a single task. So the largest key is measured first. While no
key exceeds ``hot_rows`` ordinary windows are used. Otherwise every *hot* key is
cut into chunks along the order (``levels``: e.g. day, then minute); each chunk
is scanned on its own and starts from a carry row holding the aggregate of all
earlier chunks. Carry rows are unioned in front of their chunk rather than
joined, so the rows are shuffled once per anchor key either way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is cut into chunks.
HOT_ROWS = 1_000_000

#: Hash values by which keys are counted first. Limits below this are checked key by key at once.
HASHED = 4096

_ROW = "_is_row"


@dataclass(frozen=True)
class Measure:
    """One running quantity: ``how`` is 'sum', 'max' or 'last' (non-null)."""

    name: str
    value: Column
    how: str = "sum"


@dataclass(frozen=True)
class Family:
    """Measures kept per ``anchor + extra``; families of one call share a shuffle."""

    extra: tuple[str, ...]
    measures: tuple[Measure, ...] = field(default_factory=tuple)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most count(df) / hot_rows of them."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys)
    )


def chunk_depths(
    df: DataFrame,
    anchors: Sequence[Sequence[str]],
    levels: Sequence[Sequence[str]],
    hot_rows: int = HOT_ROWS,
) -> dict[tuple[str, ...], int]:
    """How many levels each anchor has to be cut by; runs one or two small jobs per level.

    The empty anchor (a global prefix) is always cut at least once. Only the
    largest count per anchor reaches the driver.
    """
    depth = {tuple(a): 0 if a else min(1, len(levels)) for a in anchors}
    pending = [a for a in depth if depth[a] < len(levels)]
    while pending:
        keyed = {a: [*a, *(c for level in levels[: depth[a]] for c in level)] for a in pending}
        if hot_rows >= HASHED:
            # rows of all keys with one hash are at least those of each key
            hashed = {a: [F.pmod(F.xxhash64(*k), F.lit(HASHED))] for a, k in keyed.items()}
            largest = _largest(df, hashed)
            keyed = {a: k for a, k in keyed.items() if largest[a] > hot_rows}
        largest = _largest(df, keyed) if keyed else {}
        grown = [a for a in keyed if largest[a] > hot_rows]
        for anchor in grown:
            depth[anchor] += 1
        pending = [a for a in grown if depth[a] < len(levels)]
    return depth


def _largest(df: DataFrame, keyed: dict[tuple[str, ...], Sequence]) -> dict[tuple[str, ...], int]:
    """Rows of the largest key per anchor, in one job."""
    probes = []
    for i, keys in enumerate(keyed.values()):
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        probes.append(counts.agg(F.lit(i).alias("_i"), F.max("_n").alias("_n")))
    found = {r["_i"]: r["_n"] or 0 for r in reduce(DataFrame.unionByName, probes).collect()}
    return {a: found[i] for i, a in enumerate(keyed)}


def _same(keys: Sequence[str], prefix: str) -> Column:
    """NULL is a key of its own, hence the null-safe comparison."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)])


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)])


def _flag_hot(
    df: DataFrame, keys: Sequence[str], hot: DataFrame, flag: str, chunk: dict[str, str]
) -> DataFrame:
    """Add ``flag`` (true where the key is hot, else NULL) and there the chunk columns.

    The flag tells a chunk whose value is NULL from rows that are not cut at all.
    """
    marked = _renamed(hot, keys, "_hot_").withColumn(flag, F.lit(True))
    return df.join(marked, _same(keys, "_hot_"), "left").select(
        *df.columns, flag, *[F.when(F.col(flag), F.col(c)).alias(n) for n, c in chunk.items()]
    )


def _chunker(
    source: DataFrame, anchor: Sequence[str], levels: Sequence[Sequence[str]], hot_rows: int
) -> tuple[Callable[[DataFrame], DataFrame], list[list[str]]]:
    """Return a function adding flags and chunk columns, and these per level.

    Level 0 applies to hot anchors, level i+1 only inside hot chunks of level i.
    """
    steps: list[Callable[[DataFrame], DataFrame]] = []
    chunk_levels: list[list[str]] = []
    keys = list(anchor)
    frame = source
    for depth, level in enumerate(levels):
        flag, chunk = f"_cut{depth}", {f"_chunk{depth}_{c}": c for c in level}
        if keys:
            hot = hot_keys(frame, keys, hot_rows)

            def step(df, keys=tuple(keys), hot=hot, flag=flag, chunk=chunk):
                return _flag_hot(df, keys, hot, flag, chunk)
        else:

            def step(df, flag=flag, chunk=chunk):
                return df.withColumns(
                    {flag: F.lit(True), **{n: F.col(c) for n, c in chunk.items()}}
                )

        steps.append(step)
        chunk_levels.append([flag, *chunk])
        keys += chunk_levels[depth]
        if depth + 1 < len(levels):
            frame = step(frame).filter(F.col(flag))
    return (lambda df: reduce(lambda acc, s: s(acc), steps, df)), chunk_levels


def _totals(
    df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], order: Sequence[str]
) -> DataFrame:
    """One row per key; for 'last' the non-null value latest in ``order``."""
    aggs = []
    for m in measures:
        value = F.col(m.name)
        if m.how == "sum":
            agg = F.sum(value)
        elif m.how == "max":
            agg = F.max(value)
        elif m.how == "last":
            # max_by skips rows whose ordering is NULL
            agg = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
        else:
            raise ValueError(f"unknown running aggregate {m.how!r}")
        aggs.append(agg.alias(m.name))
    return df.groupBy(*keys).agg(*aggs)


def _running(m: Measure, value: Column, window) -> Column:
    if m.how == "sum":
        return F.sum(value).over(window)
    if m.how == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def scan_chunks(
    totals: DataFrame,
    group: Sequence[str],
    levels: Sequence[Sequence[str]],
    measures: Sequence[Measure],
) -> DataFrame:
    """Exclusive running aggregate over a table with one row per (group, chunk).

    Works level by level, so no window holds more than the children of one chunk.
    """
    parent = [c for level in levels[:-1] for c in level]
    own = list(levels[-1])
    rows = totals.withColumn(_ROW, F.lit(1))
    if parent:
        upper = _totals(totals, [*group, *parent], measures, own)
        carry = scan_chunks(upper, group, levels[:-1], measures)
        rows = rows.unionByName(carry.withColumn(_ROW, F.lit(0)), allowMissingColumns=True)
    keys = [*group, *parent] or [F.lit(0)]
    before = (
        Window.partitionBy(*keys)
        .orderBy(_ROW, *own)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumns({f"_r_{m.name}": _running(m, F.col(m.name), before) for m in measures})
        .filter(F.col(_ROW) == 1)
        .select(*group, *parent, *own, *[F.col(f"_r_{m.name}").alias(m.name) for m in measures])
    )


def running(
    df: DataFrame,
    anchor: Sequence[str],
    families: Sequence[Family],
    order: Sequence[str],
    levels: Sequence[Sequence[str]],
    *,
    inclusive: bool = False,
    instant: str | None = None,
    hot_rows: int = HOT_ROWS,
    source: DataFrame | None = None,
    depth: int | None = None,
) -> DataFrame:
    """Add every family's measures, aggregated over the rows before each row.

    ``order`` must be a total order and ``levels`` a list of column lists, each a
    monotone coarsening of it. With ``instant`` (the timestamp column leading the
    order) only rows at strictly earlier instants count. ``source`` is a cheap
    stand-in for ``df`` (same rows, fewer steps) for key counts and chunk totals;
    ``depth`` skips the check made by :func:`chunk_depths`.
    """
    source = df if source is None else source
    anchor = list(anchor)
    if depth is None:
        depth = chunk_depths(source, [anchor], levels, hot_rows)[tuple(anchor)]
    measures = [m for f in families for m in f.measures]
    names = {m.name for m in measures}
    keep = [c for c in df.columns if c not in names]

    def window(keys, head):
        spec = Window.partitionBy(*keys)
        if instant:
            # a missing instant comes before all others; no row is before itself
            at = F.coalesce(F.unix_micros(F.col(instant).cast("timestamp")), F.lit(-(2**61)))
            if head:
                at = F.when(F.col(_ROW) == 1, at).otherwise(F.lit(-(2**62)))
            return spec.orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
        end = Window.currentRow if inclusive else -1
        return spec.orderBy(*head, *order).rowsBetween(Window.unboundedPreceding, end)

    def measured(value, keys, head):
        out = []
        for f in families:
            spec = window([*keys, *f.extra], head)
            out += [_running(m, value(m), spec).alias(m.name) for m in f.measures]
        return out

    if depth == 0:
        return df.select(*keep, *measured(lambda m: m.value, anchor, []))

    chunk, chunk_levels = _chunker(source, anchor, levels[:depth], hot_rows)
    flat = [c for level in chunk_levels for c in level]
    # rows have their values in columns of their own; what carry rows bring is NULL in them, so it costs next to nothing
    rows = chunk(df).withColumn(_ROW, F.lit(1))
    for f in families:
        group = [*anchor, *f.extra]
        valued = source.withColumns({m.name: m.value for m in f.measures})
        hot = chunk(valued).filter(F.col(flat[0]))
        totals = _totals(hot, [*group, *flat], f.measures, order)
        carry = scan_chunks(totals, group, chunk_levels, f.measures)
        carry = carry.withColumnsRenamed({m.name: f"_c_{m.name}" for m in f.measures})
        rows = rows.unionByName(carry.withColumn(_ROW, F.lit(0)), allowMissingColumns=True)

    # one shuffle on anchor and chunk serves the windows of every family
    rows = rows.repartition(*anchor, *flat)

    def value(m):
        return F.when(F.col(_ROW) == 1, m.value).otherwise(F.col(f"_c_{m.name}"))

    done = rows.select(*keep, _ROW, *measured(value, [*anchor, *flat], [_ROW]))
    return done.filter(F.col(_ROW) == 1).drop(_ROW)


def running_strict(
    df: DataFrame,
    group: Sequence[str],
    measures: Sequence[Measure],
    levels: Sequence[Sequence[str]],
    *,
    source: DataFrame | None = None,
) -> DataFrame:
    """Aggregate over rows of the group with a strictly smaller last-level value.

    All rows at one instant see the same history, so totals per instant are scanned
    and joined back; a hot instant is only ever an aggregate and a splittable join.
    """
    source = df if source is None else source
    flat = [c for level in levels for c in level]
    valued = source.withColumns({m.name: m.value for m in measures})
    totals = _totals(valued, [*group, *flat], measures, flat)
    carry = scan_chunks(totals, group, levels, measures)
    keys = [*group, *flat]
    renamed = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[m.name for m in measures])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(renamed, same, "left").drop(*[f"_k_{k}" for k in keys])


def carry_forward(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    levels: Sequence[Sequence[str]],
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Latest non-null value at or before each row."""
    family = Family((), tuple(Measure(n, v, "last") for n, v in values.items()))
    return running(df, group, [family], order, levels, inclusive=True, hot_rows=hot_rows)


def ordinals(
    df: DataFrame,
    group: Sequence[str],
    numbered: dict[str, tuple[Sequence[str | Column], Sequence[Sequence[str]]]],
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Several row numbers per group: ``{name: (order, levels)}``; an order may end in earlier numbers.

    Ordinary groups get all numbers from one shuffle; rows of hot groups, if there
    are any, are numbered in chunks.
    """

    def windows(rows):
        for name, (order, _) in numbered.items():
            rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        return rows

    if not chunk_depths(df, [group], [list(group)], hot_rows)[tuple(group)]:
        return windows(df)
    hot = _renamed(hot_keys(df, group, hot_rows), group, "_hot_")
    cold_rows = df.join(hot, _same(group, "_hot_"), "left_anti")
    hot_rows_df = df.join(hot, _same(group, "_hot_"), "left_semi")
    cold = windows(cold_rows)
    chunked = hot_rows_df
    for name, (order, levels) in numbered.items():
        family = Family((), (Measure(name, F.lit(1).cast("long")),))
        chunked = running(
            chunked, group, [family], order, levels,
            inclusive=True, hot_rows=0, source=hot_rows_df, depth=len(levels),
        )
    casts = {name: F.col(name).cast("int") for name in numbered}
    return cold.unionByName(chunked.withColumns(casts))

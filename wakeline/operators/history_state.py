"""Prior sums kept per key, so that a day is scored without reading what led up to it.

The state is a base, which holds one row per key for all days up to one, and a delta per later day
with the sums of that day alone. A day adds its delta; compaction folds deltas into a new base. The
state before any day after a base can be read as of that day, and only the buckets of keys that the
day's rows name are joined.

    state/base/through=2024-05-31/kind=1/bucket=7/...
    state/delta/day=2024-06-01/kind=1/bucket=7/...

What is in force is told by the folders themselves: a folder without its ``_SUCCESS`` mark is not
there, so a job that died half-way leaves nothing behind and can be run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.history import INSTANT_LEVELS, Rate, families, finished, prior_sums, sum_name
from wakeline.operators.prefix import HOT_ROWS
from wakeline.schema import MEMBER_KEYS

#: Files of one kind of key are split by a hash of the key.
BUCKETS = 8


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of finished folders under a path, on whatever store it is."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [f.getPath() for f in fs.listStatus(root)]
    return sorted(p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


@dataclass(frozen=True)
class HistoryState:
    """Kept sums for a set of rates under a folder that all executors reach."""

    spark: SparkSession
    path: str
    rates: tuple[Rate, ...]
    buckets: int = BUCKETS

    @property
    def groups(self) -> list[tuple[str, ...]]:
        """The kinds of keys, by number."""
        return list(families(self.rates))

    def _bucket(self, columns: Sequence[str]) -> Column:
        # of strings, so that the width of an integer does not matter
        text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
        return F.pmod(F.xxhash64(*text), F.lit(self.buckets)).cast("int") if columns else F.lit(0)

    @property
    def columns(self) -> list[str]:
        """All key columns."""
        return list(dict.fromkeys(c for g in self.groups for c in g))

    def _summed(self, rows: DataFrame) -> DataFrame:
        """kind, bucket, key columns and sums of every kind, in one pass over the rows."""
        values, columns = families(self.rates)[()], self.columns
        totals = [c for v in values for c in (F.sum(v).alias(f"{v}_s"), F.count(v).alias(f"{v}_n"))]
        sets = [[F.col(c) for c in g] for g in self.groups]
        found = rows.groupingSets(sets, *columns).agg(F.grouping_id().alias("_set"), *totals)
        kind, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, group in enumerate(self.groups):
            # a bit per key column, set where the column is not part of the key
            here = F.col("_set") == sum(1 << (len(columns) - 1 - n) for n, c in enumerate(columns) if c not in group)
            kind, bucket = F.when(here, i).otherwise(kind), F.when(here, self._bucket(group)).otherwise(bucket)
        return found.withColumns({"kind": kind, "bucket": bucket}).drop("_set")

    def _write(self, sums: DataFrame, folder: str) -> None:
        sums.repartition("kind", "bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(folder)

    def create(self, rows: DataFrame, through: date) -> None:
        """A base from all prepared rows up to and including a day."""
        rows = rows.filter(F.col("race_date") <= F.lit(through))
        self._write(self._summed(rows), f"{self.path}/base/through={through}")

    def advance(self, rows: DataFrame, day: date) -> None:
        """Add one day's prepared rows with their outcomes; a second time replaces the first."""
        rows = rows.filter(F.col("race_date") == F.lit(day))
        self._write(self._summed(rows), f"{self.path}/delta/day={day}")

    def _parts(self, before: date) -> list[str]:
        """Folders that make up the state before a day: the latest base and the deltas after it."""
        bases = [b for b in _folders(self.spark, f"{self.path}/base") if b < f"through={before}"]
        after = f"day={bases[-1].removeprefix('through=')}" if bases else ""
        deltas = [d for d in _folders(self.spark, f"{self.path}/delta") if after < d < f"day={before}"]
        return [f"{self.path}/base/{b}" for b in bases[-1:]] + [f"{self.path}/delta/{d}" for d in deltas]

    def _sums(self, parts: Sequence[str]) -> DataFrame:
        frames = [self.spark.read.parquet(part) for part in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def before(self, rows: DataFrame, row_keys: Sequence[str], day: date) -> DataFrame | None:
        """Sums over the days before one for each row, under all its keys. None: nothing is kept.

        Rows ask with one key of every kind at once, so the state is joined once.
        """
        parts = self._parts(day)
        if not parts:
            return None
        types = dict(rows.dtypes)
        asks = [F.struct(F.lit(i).alias("_kind"), self._bucket(group).alias("_bucket"), *[
            (F.col(c) if c in group else F.lit(None).cast(types[c])).alias(f"_a_{c}") for c in self.columns])
            for i, group in enumerate(self.groups)]
        asked = rows.select(*[F.col(k).alias(f"_r_{k}") for k in row_keys], F.inline(F.array(*asks)))
        # kind and bucket are folders, so those that nobody asks for are not read
        same = [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in self.columns]
        met = asked.join(self._sums(parts), reduce(and_, same, (F.col("kind") == F.col("_kind")) & (F.col("bucket") == F.col("_bucket"))))
        totals = [F.sum(F.when(F.col("kind") == i, F.col(f"{v}_{x}"))).alias(f"_kept{sum_name(group, v)}_{x}")
                  for i, group in enumerate(self.groups) for v in families(self.rates)[group] for x in "sn"]
        return met.groupBy(*[f"_r_{k}" for k in row_keys]).agg(*totals)

    def compact(self, through: date) -> None:
        """Fold the latest base and the deltas up to a day into a new base."""
        parts = self._parts(through + timedelta(days=1))
        if parts:
            sums = self._sums(parts)
            totals = [c for c in sums.columns if c.endswith(("_s", "_n")) and c[:-2] in families(self.rates)[()]]
            keys = ["kind", "bucket", *self.columns]
            self._write(sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals]), f"{self.path}/base/through={through}")

    def rates_for(self, card: DataFrame, day: date, *, row_keys: Sequence[str] = MEMBER_KEYS,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
        """The rates of a day's prepared rows, as a build over all history gives them.

        Rows of earlier instants of the same day count as well, with the outcomes the card states.
        ``row_keys`` identify a row.
        """
        rows = prior_sums(card, self.rates, mode="strict", order=(), levels=INSTANT_LEVELS, hot_rows=hot_rows)
        kept = self.before(card, row_keys, day)
        if kept is not None:
            same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in row_keys]
            both = {c.removeprefix("_kept"): F.coalesce(F.col(c.removeprefix("_kept")) + F.col(c), F.col(c.removeprefix("_kept")), F.col(c))
                    for c in kept.columns if c.startswith("_kept")}
            rows = rows.join(kept, reduce(and_, same), "left").withColumns(both)
        return finished(rows, card.columns, self.rates)

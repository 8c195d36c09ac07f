"""Order-dependent helpers that keep a huge group from landing in one task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from docaudit.session import materialize

#: Groups of more rows are cut into pieces; the result is the same.
HOT_ROWS = 1 << 20


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key. Spark limits each key before the shuffle, so hot keys are cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


@dataclass(frozen=True)
class Step:
    """An associative fold over the earlier rows of a group: ``sum``, ``max``, ``min``, or ``last`` (the last value that is
    not null). ``inclusive`` takes the row itself in. Without a value before a row the fold is null."""

    how: str
    value: Column
    inclusive: bool = False

    def _fold(self) -> Column:
        return F.last(self.value, ignorenulls=True) if self.how == "last" else {"sum": F.sum, "max": F.max, "min": F.min}[self.how](self.value)

    def window(self, w) -> Column:
        return self._fold().over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow if self.inclusive else -1))

    def summary(self, order: list[str]) -> Column:
        """The fold over a whole piece."""
        if self.how == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))
        return self._fold()

    def join(self, before: Column, here: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(before + here, before, here)
        return F.coalesce(here, before) if self.how == "last" else {"max": F.greatest, "min": F.least}[self.how](before, here)


def _same(left: str, right: str, columns: list[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def plain_scan(df: DataFrame, group: list[str], order: list[str], steps: dict[str, Step]) -> DataFrame:
    """The folds of ``steps`` as windows over whole groups."""
    inside = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.select("*", *[s.window(inside).alias(n) for n, s in steps.items()])


def cut_scan(df: DataFrame, group: list[str], order: list[str], steps: dict[str, Step]) -> DataFrame:
    """The same folds for large groups: rows are dealt by ranges of (group, order), so groups are cut evenly wherever they
    lie, also at one instant; folds run inside the pieces, and one summary row per piece carries them from piece to piece."""
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = materialize(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group], *by).withColumn("_piece", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy(*group, "_piece").agg(*[s.summary(order).alias(f"_s_{n}") for n, s in steps.items()])
    carried = materialize(
        pieces.select(*group, "_piece", *[Step(s.how, F.col(f"_s_{n}"))._fold().over(earlier).alias(f"_c_{n}") for n, s in steps.items()])
    )
    piece = Window.partitionBy(*group, "_piece").orderBy(*by)
    folded = dealt.select("*", *[s.window(piece).alias(f"_h_{n}") for n, s in steps.items()]).alias("f")
    joined = folded.join(carried.alias("c"), _same("f", "c", [*group, "_piece"]), "left")
    cut = joined.select(
        *[F.col(f"f.{c}") for c in df.columns],
        *[s.join(F.col(f"c._c_{n}"), F.col(f"f._h_{n}")).alias(n) for n, s in steps.items()],
    )
    # A sum of sums has more digits than a sum.
    kinds = plain_scan(df, group, order, steps).schema
    return cut.withColumns({n: F.col(n).cast(kinds[n].dataType) for n, s in steps.items() if s.how == "sum"})


#: plain_scan or cut_scan.
Scan = Callable[[DataFrame, list[str], list[str], dict[str, Step]], DataFrame]


def by_group_size(
    df: DataFrame, group: list[str], fold: Callable[[DataFrame, Scan], DataFrame], hot_rows: int = HOT_ROWS, stored: bool = False
) -> DataFrame:
    """``fold(rows, scan)`` of the groups of at most ``hot_rows`` rows with ``plain_scan``, and of larger ones with ``cut_scan``.

    Several scans of one fold follow each other in one plan, so the rows of small groups are dealt once however many scans
    there are, and groups are counted once. ``df`` is computed for the count and once more; with hot groups it is stored
    before it is split, unless it is ``stored`` already. The hot groups are at most 1 / hot_rows of all rows, so their
    list is small.
    """
    hot = materialize(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*group))
    if hot.isEmpty():
        return fold(df, plain_scan)
    rows = df if stored else materialize(df)
    cold = rows.alias("d").join(hot.alias("h"), _same("d", "h", group), "left_anti")
    large = rows.alias("d").join(hot.alias("h"), _same("d", "h", group), "left_semi")
    return fold(cold, plain_scan).unionByName(fold(large, cut_scan))


def chunked_scan(
    df: DataFrame, group: list[str], order: list[str], steps: dict[str, Step], hot_rows: int = HOT_ROWS, stored: bool = False
) -> DataFrame:
    """``df`` with one column per step: its fold over the rows before (or up to) a row in its group, by ``order`` (ascending,
    null first; name columns that decide every tie).

    Groups of at most ``hot_rows`` rows are windows of their own, larger ones are cut, and no task sees a whole one.
    """
    return by_group_size(df, group, lambda rows, scan: scan(rows, group, order, steps), hot_rows, stored)


def chunked_lag(df: DataFrame, group: list[str], order: list[str], carry: list[str], name: str = "prev", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Previous row (as a struct of ``carry``) within ``group``, ordered by ``order``."""
    return chunked_scan(df, group, order, {name: Step("last", F.struct(*carry))}, hot_rows)


def as_of_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, right_order: list[str], carry: list[str],
    name: str = "as_of", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left`` with the latest row of ``right`` (as a struct of ``carry``, null if none) of the same key at or before its time.

    Both sides are put on one time line per key and the last right row is carried along by ``chunked_scan``, so neither a
    key with most rows nor a wide time span multiplies anything. ``right_order`` decides between right rows of one time:
    the highest comes last. Left rows without a time find nothing; right rows without a time or key are left out.
    """
    held = left.columns
    times = F.col(left_time)
    tie = F.xxhash64(*[f.name for f in left.schema if f.dataType.typeName() != "map"])  # spreads rows of one time; their order does not matter
    line = left.select(*held, *[F.col(c).alias(f"_k_{c}") for c in on], times.alias("_t"), F.lit(1).alias("_side"), tie.alias("_tie"))
    rows = right.where(F.col(right_time).isNotNull())
    for c in on:
        rows = rows.where(F.col(c).isNotNull())
    kinds = {f.name: f.dataType for f in left.schema}
    entry = rows.select(
        *[F.col(c).alias(f"_k_{c}") for c in on], F.col(right_time).cast(kinds[left_time]).alias("_t"), F.lit(0).alias("_side"),
        F.struct(*right_order).alias("_rank"), F.struct(*carry).alias("_held"),
    )
    both = line.unionByName(entry, allowMissingColumns=True)
    keys = [f"_k_{c}" for c in on]
    found = chunked_scan(both, keys, ["_t", "_side", "_rank", "_tie"], {name: Step("last", F.col("_held"))}, hot_rows)
    return found.where("_side = 1").select(*held, name)

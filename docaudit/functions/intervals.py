"""Points in intervals, without a join that pairs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docaudit.session import discard, materialize

#: Sizes of blocks: 2**0 to 2**LEVELS. Longer intervals consist of several blocks of the largest size.
LEVELS = 12


def _blocks(low: Column, high: Column) -> Column:
    """The fewest aligned blocks (level, number) that make up low..high: at most two of every size but the largest."""
    ends = []
    for level in range(LEVELS):
        first, after = F.shiftright(low + (2**level - 1), level), F.shiftright(high + 1, level)
        ends.append(F.when((first < after) & (first % 2 != 0), F.struct(F.lit(level).alias("level"), first.alias("number"))))
        ends.append(F.when((first < after) & (after % 2 != 0), F.struct(F.lit(level).alias("level"), (after - 1).alias("number"))))
    first, after = F.shiftright(low + (2**LEVELS - 1), LEVELS), F.shiftright(high + 1, LEVELS)
    large = F.transform(F.sequence(first, after - 1), lambda n: F.struct(F.lit(LEVELS).alias("level"), n.alias("number")))
    return F.when(first < after, F.concat(F.array_compact(F.array(*ends)), large)).otherwise(F.array_compact(F.array(*ends)))


def stab(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str, best: list[str], name: str = "found") -> DataFrame:
    """``points`` with the least of the intervals of the same key that hold their place: a struct of ``best`` (these columns
    order the intervals), null if none does.

    Places and both ends (included) are whole numbers, such as days. An interval is cut into aligned blocks, and a place
    lies in one block of every size. Per key and block only the least interval is kept, and every place of a key is asked
    once. Blocks and places meet in the largest block that holds them, where a key has at most 2**LEVELS places and twice as
    many blocks: neither many overlapping intervals nor a popular key multiply what is moved.
    A null key, place or end is in nothing, and so is an interval that ends before it begins; points without a key or place
    are not moved. ``points`` is read three times, so store it first.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    cut = intervals.where(known & F.col(low).isNotNull() & F.col(high).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(on, keys)], F.struct(*best).alias("_best"),
        F.inline(_blocks(F.col(low).cast("bigint"), F.col(high).cast("bigint"))).alias("_level", "_number"),
    )
    least = materialize(cut.groupBy(*keys, "_level", "_number").agg(F.min("_best").alias("_best")))
    placed = known & F.col(at).isNotNull()
    asking, idle = points.where(placed), points.where(~placed)
    places = asking.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], F.col(at).cast("bigint").alias("_at")).distinct()
    largest = [*keys, "_largest"]
    blocks = least.withColumn("_largest", F.expr(f"shiftright(_number, {LEVELS} - _level)"))
    met = places.withColumn("_largest", F.shiftright("_at", LEVELS)).join(blocks, largest).where(F.expr("shiftright(_at, _level) = _number"))
    # The groups lie inside the partitions of the join, so nothing moves again.
    found = materialize(met.groupBy(*largest, "_at").agg(F.min("_best").alias(name)).drop("_largest"))
    discard(least)
    same = F.col("p." + at).cast("bigint") == F.col("f._at")
    for c, k in zip(on, keys):
        same = same & (F.col(f"p.{c}") == F.col(f"f.{k}"))
    joined = asking.alias("p").join(found.alias("f"), same, "left").select("p.*", f"f.{name}")
    return joined.unionByName(idle.withColumn(name, F.lit(None).cast(joined.schema[name].dataType)))

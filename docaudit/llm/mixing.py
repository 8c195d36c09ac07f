"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

Sizes are counted once and stored; all else works on one short row per document. Targets are found on the table of
sources: sources at their cap are clamped, what is left is shared among the others by weight, until none is above its
cap. A document is taken floor(target / source size) times; the rest of a target is filled by documents in the order
of a seeded hash, passing over those that do not fit. That order needs no global sort: words are summed per source and
slice of the hash range, and only the slice in which the target falls is sorted, so a source with a third of all rows is
no hot key. The draw stops at the first document that does not fit and is repeated with the gap that is left over the
documents of at most its size, until none fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docaudit.llm.common import ready, store

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2.0
SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, draw and slice of every document; a null text has size 0."""
    ready(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    draw = F.xxhash64(F.lit(seed), "doc_id", "size")
    return rows.withColumn("draw", draw).withColumn("slice", F.shiftrightunsigned("draw", 52).cast("int"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources get the weights in turn, by code point with null last. Each round clamps what is above its cap and shares
    the rest anew; two sums a round reach the driver.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = store(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(float(most)) * F.col("source_size")
    left, clamped = float(share) * total, F.lit(False)
    level = 0.0  # words for a unit of weight; it only rises, so what is clamped stays clamped
    while True:
        free = rows.where(~clamped).agg(F.sum("weight")).first()[0]
        held = rows.where(clamped).agg(F.sum(cap)).first()[0] or 0.0
        if not free:
            break
        level = max(0.0, left - held) / free
        over = cap < F.lit(level) * F.col("weight")
        if not rows.where(~clamped & over).limit(1).count():
            break
        clamped = over
    target = F.when(clamped, cap).otherwise(F.least(cap, F.lit(level) * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))


def _bordered(by_slice: DataFrame, goals: DataFrame, amount: str) -> DataFrame:
    """``goals`` with the slice in which the words of a source exceed ``amount`` and the words before it; null if none does."""
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = store(
        by_slice.withColumn("before", before).alias("s").join(goals.alias("g"), _same("s", "g")).where(f"s.before + s.words > g.{amount}")
        .groupBy("s.source").agg(F.min(F.struct("s.slice", "s.before")).alias("at"))
        .select("source", F.col("at.slice").alias("border"), F.col("at.before").alias("before"))
    )
    return store(goals.alias("g").join(border.alias("b"), _same("g", "b"), "left").select("g.*", "b.border", "b.before"))


def _drawn(placed: DataFrame, amount: str) -> DataFrame:
    """``placed`` with drawn: the documents of a source, by draw, before their words exceed ``amount``."""
    run = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.where("slice = border").withColumn("drawn", F.col("before") + F.sum("size").over(run) <= F.col(amount))
    outside = placed.where("border is null or slice <> border").withColumn("drawn", F.coalesce(F.col("slice") < F.col("border"), F.lit(True)) & (F.col(amount) > 0))
    return outside.unionByName(inside)


def _gaps(gaps: DataFrame, drawn: DataFrame) -> DataFrame:
    """source and gap after the drawn documents."""
    filled = drawn.where("drawn").groupBy("source").agg(F.sum("size").alias("filled"))
    return store(
        gaps.alias("g").join(filled.alias("f"), _same("g", "f"), "left").select("g.source", (F.col("g.gap") - F.coalesce("f.filled", F.lit(0))).alias("gap"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, times, taken.

    size counts the words ``[^\\x20\\x09-\\x0D]+`` (null text: 0); taken = times * size. A document is taken whole once
    for every full epoch of its source, and once more if it fits into what is left of the target when its turn comes in
    the order of draws. In the end no document left out fits; the smallest of them is added if it goes beyond the target
    by less than it was missed. Draws depend on doc_id, size and seed only, so reruns agree; rows that repeat both share
    a draw. A null source is a source of its own; a null doc_id is drawn like a value. Documents
    of size 0 count as whole epochs only. Other columns are ignored; an empty table gives an empty result.
    """
    rows = store(sized(docs, seed).withColumn("row", F.monotonically_increasing_id()))
    by_slice = store(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    goals = store(
        targets(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    goals = _bordered(by_slice, goals, "rest")

    # One source has at most SLICES rows in by_slice; sources are few, and AQE broadcasts goals only when small.
    placed = rows.alias("r").join(goals.alias("g"), _same("r", "g")).select("r.*", "g.source_size", "g.target", "g.whole", "g.rest", "g.border", "g.before")
    drawn = store(_drawn(placed, "rest"))
    gaps = _gaps(goals.select("source", F.col("rest").alias("gap")), drawn)

    free = drawn.where("not drawn and size > 0").select("source", "slice", "size", "draw", "doc_id", "row")
    left, added = free, free.select("row").limit(0)
    while True:
        left = left.alias("p").join(gaps.alias("g"), _same("p", "g")).where("p.size <= g.gap").select("p.*")
        by_slice = store(left.groupBy("source", "slice").agg(F.sum("size").alias("words")))
        if by_slice.isEmpty():
            break
        edges = _bordered(by_slice, gaps, "gap")
        step = store(_drawn(left.alias("p").join(edges.alias("g"), _same("p", "g")).select("p.*", "g.gap", "g.border", "g.before"), "gap"))
        gaps = _gaps(gaps, step)
        added = added.unionByName(step.where("drawn").select("row"))
        left = step.where("not drawn").select("source", "slice", "size", "draw", "doc_id", "row")
    added = store(added)
    best = F.min(F.struct(*(F.col(f"p.{n}").alias(n) for n in ("size", "draw", "doc_id", "row"))))
    beyond = (
        free.join(added, "row", "left_anti").alias("p").join(gaps.alias("g"), _same("p", "g")).where("p.size - g.gap < g.gap")
        .groupBy("p.source").agg(best.alias("best")).select("best.row")
    )
    added = store(added.unionByName(beyond))
    extra = added.select("row", F.lit(1).alias("extra"))
    times = F.col("whole") + F.col("drawn").cast("long") + F.coalesce("extra", F.lit(0))
    return (
        drawn.join(extra, "row", "left")
        .select("doc_id", "source", "size", "source_size", "target", times.alias("times"))
        .withColumn("taken", F.col("times") * F.col("size"))
    )

"""Line dedup across documents with DataFrame functions alone.

Line keys are hashed, range-partitioned by hash and sorted by document and position inside a hash, so one streaming
pass sees every key's first document before the later ones. What comes back is a run-length bitmap of kept lines per
document, not text.

A key that a large share of all lines carries would fill one range. Such keys are found from a sample of the stored
line table (a share above HEAVY, so at most 1 / HEAVY keys by proportion) and are ranged by hash and a block of
documents; the first documents of their blocks meet in a small aggregate. The sample only decides how rows are dealt
out: a key gives the same result heavy or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docaudit.llm.common import id_column, store, texts

#: Lines shorter than this many code points stay.
LEAST_CHARS = 10
#: Share of sampled lines (and at least so many) from which a key is dealt out in blocks, and the blocks.
HEAVY, HEAVY_LINES, BLOCKS, SAMPLE = 0.002, 20, 64, 0.02

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Stripped of white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def keyed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, version, position, high, low): 128 bits of hash for every line whose key is long enough."""
    lines = texts(docs).select(
        id_column().alias("id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("position", "line")
    )
    keys = lines.select("id", "version", "position", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    digest = F.md5(F.col("key").cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("long")
    return keys.select("id", "version", "position", half(1).alias("high"), half(17).alias("low"))


def dropped_positions(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, version, position) of lines whose key a document with a smaller id also holds."""
    lines = store(keyed_lines(docs, least_chars))
    sample = lines.sample(SAMPLE, 11)
    share = max(float(HEAVY_LINES), sample.count() * HEAVY)
    heavy = store(sample.groupBy("high", "low").agg(F.count("*").alias("n")).where(F.col("n") > share).select("high", "low", F.lit(True).alias("heavy")))
    block = F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(BLOCKS))).otherwise(F.lit(-1)).cast("int")
    dealt = (
        lines.join(F.broadcast(heavy), ["high", "low"], "left").withColumn("block", block).drop("heavy")
        .repartitionByRange("high", "low", "block")
        .sortWithinPartitions("high", "low", "block", "id", "position")
    )
    run = Window.partitionBy("high", "low", "block").orderBy("id", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("first", F.first("id").over(run))
    light = seen.where("block = -1 and first <> id").select("id", "version", "position")
    of_blocks = store(seen.where("block <> -1").select("high", "low", "id", "version", "position", "first"))
    first = of_blocks.groupBy("high", "low").agg(F.min("first").alias("least"))
    late = of_blocks.join(F.broadcast(first), ["high", "low"]).where("least <> id").select("id", "version", "position")
    return light.unionByName(late)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, version, dropped, starts, ends) for documents that lose lines.

    The bitmap is run-length coded: ``starts`` and ``ends`` (exclusive) are the runs of dropped positions. ``id`` is
    the doc_id (NULL_ID for null), ``version`` the xxhash64 of the text.
    """
    lost = dropped_positions(docs, least_chars).groupBy("id", "version").agg(F.sort_array(F.collect_set("position")).alias("p"))
    begins = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    stops = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    return lost.select(
        "id", "version", F.size("p").cast("long").alias("dropped"), begins.alias("starts"), F.transform(stops, lambda x: x + 1).alias("ends")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, kept_text, n_lines, n_dropped of every row."""
    bitmaps = bitmaps.withColumnsRenamed({"id": "_id", "version": "_version"})
    rows = texts(docs).withColumn("lines", F.split("text", "\n", -1))
    found = rows.join(bitmaps, (id_column() == F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left")
    size = F.size("lines")
    # Kept runs lie between the dropped ones: from the end of one to the start of the next.
    froms = F.concat(F.array(F.lit(0)), F.col("ends"))
    tos = F.concat(F.col("starts"), F.array(size))
    kept = F.flatten(F.transform(F.arrays_zip(froms.alias("a"), tos.alias("b")), lambda r: F.slice("lines", r["a"] + 1, r["b"] - r["a"])))
    return found.select(
        "doc_id", "text", F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        size.cast("long").alias("n_lines"), F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per document: doc_id, text, kept_text, n_lines, n_dropped.

    A text is split at \\n; null and empty texts are one empty line. A key of at least ``least_chars`` code points that two
    documents hold loses all its lines except in the smallest doc_id holding it; lines a single document repeats stay.
    A null doc_id comes after every other, and rows without one count as one document, as do rows that share a doc_id.
    Other columns are ignored; an empty table gives an empty result.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, least_chars))

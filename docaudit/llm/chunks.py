"""Exact dedup by content-defined chunk recipes.

A text (A-Z lower-cased, UTF-8) is cut where a rolling hash of its last WINDOW bytes hits a mask, so equal passages
give equal chunks wherever they stand. A document becomes its recipe: the ordered list of chunk identifiers, some 16
bytes for a kilobyte of text. Recipes are stored once; grouping, counting and joining work on recipes only.

Identifiers are verified: bodies are deduplicated per identifier (with map-side combine, so copies of a chunk do not
move), and an identifier that stands for two bodies is split into numbered ones in the recipes that use it. Equal
lists of verified identifiers then mean equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docaudit.llm import text as T
from docaudit.llm.common import pieces, store, texts

#: Bytes the rolling hash sees; a power of two.
WINDOW = 32
#: Smallest, mean and largest chunk in bytes.
LEAST, MEAN, MOST = 256, 1024, 8192

_GEAR = (T.BYTE_VALUES >> T.U(17)).astype(np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk ends of every row of a block, relative to the block."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # after each step a position holds the hash of twice as many bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - MEAN.bit_length() + 1)) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, at = [], a
        for m in marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b)].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while b - at > MOST:
            at += MOST
            ends.append(at)
        ends.append(b)
        out.append(ends)
    return out


def _chunked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, bytes, list[tuple[bytes, bytes]]]]:
    """Row number, normalised text and (identifier, body) of its chunks."""
    data, offsets = T.block(batch.column("text"))
    data = T.LOWER[data]
    raw = data.tobytes()
    for i, ends in enumerate(cuts(data, offsets)):
        at = int(offsets[i])
        found = []
        for end in ends:
            body = raw[at:end]
            found.append((hashlib.blake2b(body, digest_size=width).digest(), body))
            at = end
        yield i, raw[int(offsets[i]) : int(offsets[i + 1])], found


def recipes(docs: DataFrame, width: int = 16) -> DataFrame:
    """doc_id, text_sha256 of the normalised text, and the ordered chunk identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            shas, lists = [], []
            for _, whole, found in _chunked(batch, width):
                shas.append(hashlib.sha256(whole).hexdigest())
                lists.append([name for name, _ in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "text_sha256", "recipe"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, text_sha256 string, recipe array<binary>")


def chunks(docs: DataFrame, width: int = 16, placed: bool = False) -> DataFrame:
    """(name, body) of every chunk; with ``placed`` also the document and the position."""
    schema = "name binary, body binary" + (", doc_id long, text_sha256 string, position int" if placed else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, whole, found in _chunked(batch, width):
                if placed:
                    sha = hashlib.sha256(whole).hexdigest()
                    rows += [(name, body, ids[i], sha, k) for k, (name, body) in enumerate(found)]
                else:
                    rows += found
            if not placed:
                rows = list(dict.fromkeys(rows))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int32()]
            names = ["name", "body", "doc_id", "text_sha256", "position"]
            cols = [pa.array(c, kinds[k]) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    return texts(docs).mapInArrow(run, schema)


def _verified(docs: DataFrame, made: DataFrame, width: int) -> DataFrame:
    """The recipes with identifiers that stand for one body each."""
    bodies = chunks(docs, width).distinct()
    doubted = store(bodies.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    if doubted.isEmpty():  # every identifier has one body: nothing to rename
        return made
    order = F.row_number().over(Window.partitionBy("name").orderBy("body"))
    numbered = store(bodies.join(doubted, "name", "left_semi").withColumn("verified", F.concat("name", F.lit("-").cast("binary"), order.cast("string").cast("binary"))))
    row = ["doc_id", "text_sha256"]
    placed = chunks(docs, width, placed=True).join(numbered, ["name", "body"], "left")
    renamed = placed.groupBy(*row).agg(
        F.transform(
            F.sort_array(F.collect_set(F.struct("position", F.coalesce("verified", "name").alias("id")))), lambda c: c["id"]
        ).alias("recipe")
    )
    same = (F.col("m.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("m.text_sha256") == F.col("r.text_sha256"))
    return store(made.alias("m").join(renamed.alias("r"), same).select("m.doc_id", "m.text_sha256", "r.recipe", "m.row"))


def exact_duplicates(docs: DataFrame, width: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and empty texts are equal. Of
    equal texts the row with the largest doc_id stays (a null doc_id comes last, its keep_id is null only when all
    are null). Of repeated rows with that doc_id exactly one is kept. group_size counts rows. Other columns are
    ignored; an empty table gives an empty result. ``width`` is the number of bytes of a chunk's unverified name.
    """
    made = store(recipes(docs, width).withColumn("row", F.monotonically_increasing_id()))
    listed = _verified(docs, made, width)
    last = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("known"), F.col("row").alias("row"), F.col("doc_id").alias("doc_id")))
    groups = store(listed.groupBy("recipe").agg(last.alias("last"), F.count("*").alias("group_size")).where("group_size > 1"))
    return (
        listed.join(groups, "recipe", "left")
        .select(
            "doc_id",
            F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
            "text_sha256",
            F.size("recipe").alias("n_chunks"),
        )
    )

"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands, star-shaped candidates.

1. Every text becomes its set of word shingles (64-bit hashes; a second set under a key drawn for the job tells classes
   apart and confirms links). Documents with the same set form one class, so
   thousands of copies cost one row from here on.
2. One-permutation hashing gives BINS minima per set from a single pass; empty bins borrow from a bin picked by
   a fixed hash sequence (optimal densification), which keeps each bin's match probability equal to the similarity
   even for sets of a few shingles. Bins are banded into buckets.
3. Stars: the smallest id of a bucket is its hub, so a bucket of m sets gives m - 1 candidate pairs, and hubs repeat
   over bands. Pairs that the sketches rule out by more than five standard errors are left, the rest are confirmed on
   the full sets.
4. A bucket whose sets are still in several components may hold links the stars did not try. Such buckets are
   compared in pieces of bounded size on full sets, and one link per joined pair of components leaves a piece, so no
   link between different texts that a bucket holds is lost and no pairs are listed.
5. Links are contracted to connected components.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docaudit.llm import text as T
from docaudit.llm.common import pieces, store, texts
from docaudit.llm.components import components

#: Bands times rows are the bins. A pair of similarity 0.85 shares no band with probability 7e-9, one of 0.8 with 3e-6.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Sets, and bytes of sets, of one part of a bucket; two parts are compared at a time.
PIECE, PIECE_BYTES = 256, 16 << 20
#: Standard errors below the threshold at which a sketch rules a pair out.
SLACK = 5.0
_ATTEMPTS = 512

U = np.uint64


def _donors(round_: int) -> np.ndarray:
    """For every attempt and bin the bin to borrow from: the same for all documents."""
    grid = np.arange(round_ * _ATTEMPTS, (round_ + 1) * _ATTEMPTS, dtype=U)[:, None] * U(BINS) + np.arange(BINS, dtype=U)[None, :]
    return (T.mix(grid + U(0x632BE59BD9B4E019)) % U(BINS)).astype(np.int64)


_DONORS = [_donors(0)]


def signature(values: np.ndarray) -> np.ndarray:
    """BINS minima of a sorted set of hashes; the hash range is cut into BINS equal parts."""
    bins = ((values >> U(32)) * U(BINS)) >> U(32)
    held, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, U)
    full = np.zeros(BINS, bool)
    out[held], full[held] = values[first], True
    empty = np.flatnonzero(~full)
    round_ = 0
    while len(empty):
        if round_ == len(_DONORS):
            _DONORS.append(_donors(round_))
        donors = _DONORS[round_][:, empty]
        hit = full[donors]
        found = hit.any(0)
        out[empty[found]] = out[donors[hit.argmax(0)[found], np.flatnonzero(found)]]
        empty, round_ = empty[~found], round_ + 1
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sets(batch: pa.RecordBatch, words_per_shingle: int, key: int = 0) -> list[np.ndarray]:
    """The shingle sets of a batch, hashed under a key."""
    data, offsets = T.block(batch.column("text"))
    data = T.LOWER[data]
    starts, ends, first_word = T.words(data, offsets)
    return T.distinct_rows(*T.shingles(T.word_hashes(data, starts, ends, key), first_word, words_per_shingle))


_SIGNED_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"
_MULTIPLIERS = T.mix(np.arange(1, ROWS + 1, dtype=U)) | U(1)


def signatures(docs: DataFrame, words_per_shingle: int, key: int) -> DataFrame:
    """Per document: set size, a 128-bit fingerprint of the set, band keys, and one byte per bin as a sketch.

    Half of the fingerprint is of hashes under ``key``, the rest of plain ones, so that bands are the same in every run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for values, keyed in zip(_sets(batch, words_per_shingle), _sets(batch, words_per_shingle, key), strict=True):
                if not len(values):
                    rows.append((0, 0, 0, None, None))
                    continue
                mins = signature(values)
                keys = T.mix((mins.reshape(BANDS, ROWS) * _MULTIPLIERS).sum(1, dtype=U) + np.arange(BANDS, dtype=U))
                a = T.mix(values).sum(dtype=U)
                b = T.mix(keyed).sum(dtype=U)
                rows.append((len(keyed), int(_signed(a)), int(_signed(b)), _signed(keys), (T.mix(mins) >> U(56)).astype(np.uint8).tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    return texts(docs).mapInArrow(run, _SIGNED_SCHEMA)


def full_sets(docs: DataFrame, words_per_shingle: int, key: int) -> DataFrame:
    """(id, members): the sorted shingle hashes of every document, under ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = _sets(batch, words_per_shingle, key)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "members"])

    return texts(docs).mapInArrow(run, "id long, members binary")


def _floor(threshold: float, n_a, n_b):
    """The lowest sketch agreement that does not rule a pair of set sizes out."""
    effective = np.minimum(BINS, np.maximum(n_a, n_b))
    return threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(1, effective))


def _near_sketches(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) that sizes and sketches do not rule out."""
    left = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sized = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9

    @F.pandas_udf("boolean")
    def plausible(n_a: pd.Series, n_b: pd.Series, sketch_a: pd.Series, sketch_b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(sketch_a), np.uint8).reshape(-1, BINS)
        y = np.frombuffer(b"".join(sketch_b), np.uint8).reshape(-1, BINS)
        return pd.Series((x == y).mean(1) >= _floor(threshold, n_a.to_numpy(), n_b.to_numpy()))

    return pairs.join(left, "a").join(right, "b").where(sized).where(plausible("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def reaches(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            u, v = np.frombuffer(x, U), np.frombuffer(y, U)
            both = len(u) + len(v) - len(np.union1d(u, v))
            out.append(100 * both >= percent * (len(u) + len(v) - both))
        return pd.Series(out)

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("members_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("members_b"))
    return pairs.join(left, "a").join(right, "b").where(reaches("members_a", "members_b")).select("a", "b")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; only members that two sets hold take part, in strips of bounded width."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    place = np.cumsum(shared) - 1
    mine = shared[column]
    owner, column = owner[mine], place[column[mine]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        strip = np.zeros((len(sets), width), np.float32)
        strip[owner[part], column[part] - low] = 1
        out += strip @ strip.T
    return out


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Links between components inside buckets; members: band, key, n, weight, id, component, members (their full set).

    A bucket is cut into parts of about PIECE sets or PIECE_BYTES by a hash of the id; every two parts meet in one group,
    so a group is bounded whatever the bucket's size. All pairs of a group are tested on their full sets inside the task;
    what leaves it is one link per set that joins another component there.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PIECE), F.ceil(F.col("weight") * 8 / PIECE_BYTES)).cast("int")
    cut = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "component", "members"
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, component = frame["id"].to_numpy(), frame["component"].to_numpy()
        if (component == component[0]).all():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [np.frombuffer(m, U) for m in frame["members"]]
        sizes = np.array([len(s) for s in sets], float)
        both = _intersections(sets)
        linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (component[:, None] != component[None, :])
        # Merge components greedily: a link is reported if its two components are not yet joined in this group.
        _, home = np.unique(component, return_inverse=True)
        found = []
        for x, y in zip(*np.nonzero(np.triu(linked)), strict=True):
            if home[x] != home[y]:
                found.append((ids[x], ids[y]))
                home[home == home[y]] = home[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    keys = ["band", "key", "i", "j"]
    dealt = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.groupBy(*keys).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer words than a shingle has its whole
    sequence as one shingle; null, empty and blank texts have an empty set and are linked with nothing. Two documents
    are linked when 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id reachable.
    A repeated doc_id gives one row per input row; if its texts differ, the smallest text stands for it in comparisons. A null doc_id gets the component of its class (null if it has none)
    and is never kept. Other columns are ignored. An empty table gives an empty result.
    """
    threshold = percent / 100
    secret = secrets.randbits(63)  # links are confirmed on hashes that no text can be written against
    signed = store(signatures(docs, words_per_shingle, secret))
    key = ["n_shingles", "set_a", "set_b"]
    classes = store(
        signed.where("n_shingles > 0").groupBy(*key)
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .where(F.col("id").isNotNull())
    )
    reps = classes.select("id", "n_shingles", "sketch")

    entries = store(classes.select("id", F.posexplode("bands").alias("band", "key")))
    shared = store(entries.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    placed = store(entries.join(shared, ["band", "key"]))
    stars = placed.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    candidates = placed.select(F.col("id").alias("doc_id")).distinct()
    some = texts(docs).join(candidates, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = store(full_sets(some, words_per_shingle, secret))

    links = store(_confirmed(_near_sketches(stars, reps, threshold), sets, percent))
    labels = components(links)

    labelled = store(
        placed.select("id", "band", "key").join(labels.withColumnRenamed("node", "id"), "id", "left")
        .join(classes.select("id", "n_shingles"), "id")
        .select("id", "band", "key", "n_shingles", F.coalesce("component", "id").alias("component"))
    )
    mixed = (
        labelled.groupBy("band", "key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("weight"),
             F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y"))
        .where("low <> high")
        .groupBy("n", "weight", "x", "y").agg(F.min(F.struct("band", "key")).alias("bucket"))  # buckets of the same sets are compared once
        .select("bucket.*", "n", "weight")
    )
    members = labelled.drop("n_shingles").join(store(mixed), ["band", "key"]).join(sets, "id")
    more = store(_across(members, percent).distinct())
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    joined = classes.select(*key, "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = store(joined.select(*key, F.coalesce("component", "id").alias("found")))
    return (
        signed.select("doc_id", *key).join(named, key, "left")
        .select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )

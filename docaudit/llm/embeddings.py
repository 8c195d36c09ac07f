"""Near-duplicate vectors by cross-polytope hashing.

1. Equal vectors of a label form one class, which counts with its size.
2. A table turns a vector by fast Hadamard rotations (sign flips and a Walsh-Hadamard transform, three times) and names
   the coordinate of largest size with its sign; HASHES such names are a bucket. Multiprobe: the PROBES buckets whose
   coordinates come next are entered too, so a near pair whose largest coordinates swap still meets.
3. Vectors of a bucket (inside a label) are compared in pieces of bounded size, however large the bucket. A pair meets
   in several buckets; only its first common bucket counts it, so links are counted exactly without listing pairs.
4. Every piece returns counts and a spanning set of links; contraction gives components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from docaudit.llm import text as T
from docaudit.llm.common import ready, store
from docaudit.llm.components import components

TABLES, HASHES, PROBES = 6, 2, 6
#: Vectors of one bucket compared by one task at a time.
PIECE = 512
#: Rows gathered before small buckets are compared together.
GATHER = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the row length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def signs(table: int, hash_: int, n: int) -> np.ndarray:
    return np.random.default_rng([7919, table, hash_, n]).choice([-1.0, 1.0], (3, n))


def buckets(unit: np.ndarray) -> np.ndarray:
    """Bucket codes (rows, TABLES, PROBES) of vectors of length one, the vector's own bucket first."""
    dim = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), dim))
    padded[:, : unit.shape[1]] = unit
    out = np.zeros((len(unit), TABLES, PROBES), np.int64)
    reach = min(PROBES, dim)
    for t in range(TABLES):
        names, losses = [], []
        for h in range(HASHES):
            y = padded
            for s in signs(t, h, dim):
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argsort(-size, 1, kind="stable")[:, :reach]
            names.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
            held = np.take_along_axis(size, top, 1)
            losses.append((held[:, :1] - held) ** 2)
        name, loss = names[0], losses[0]
        for more, cost in zip(names[1:], losses[1:], strict=True):
            name = (name[:, :, None] * (2 * dim) + more[:, None, :]).reshape(len(unit), -1)
            loss = (loss[:, :, None] + cost[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(loss, 1, kind="stable")[:, :PROBES]
        found = np.take_along_axis(name, best, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the largest component is scaled out first."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, single: bool) -> DataFrame:
    """Classes with their vector as bytes and their bucket codes."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            for dim in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                raw = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                codes = buckets(unit_rows(raw)).astype("<u8")
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), rows.column("size"), pa.array(np.full(n, dim, np.int32)),
                     pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array([sorted(set((c + (np.arange(TABLES, dtype="<u8") << np.uint64(56))[:, None]).ravel().astype(np.int64).tolist())) for c in codes], pa.list_(pa.int64()))],
                    ["id", "label", "size", "dim", "vector", "codes", "entered"],
                )

    return classes.mapInArrow(run, "id long, label string, size long, dim int, vector binary, codes binary, entered array<long>")


def _first_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """First table and smallest bucket in it that both rows entered, as one number; codes are (pairs, TABLES, PROBES)."""
    none = np.iinfo(np.int64).max
    found = np.full(len(x), none, np.int64)
    for t in range(TABLES):
        same = (x[:, t, :, None] == y[:, t, None, :]).any(2)
        least = np.where(same, x[:, t], none).min(1)
        found = np.where((found == none) & (least != none), least + (t << 56), found)
    return found


def _compare(rows: dict[str, np.ndarray], bucket: int, left: np.ndarray, right: np.ndarray, same: bool, least: float, out: list) -> None:
    """Add (id, links, other) of one piece: counts of pairs that meet here first, and a spanning set of links."""
    cosine = rows["unit"][left] @ rows["unit"][right].T
    i, j = np.nonzero(cosine >= least)
    if same:
        i, j = i[left[i] < right[j]], j[left[i] < right[j]]
    if not len(i):
        return
    a, b = left[i], right[j]
    for s in range(0, len(a), 1 << 16):
        u, v = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
        here = _first_common(rows["codes"][u], rows["codes"][v]) == bucket
        u, v = u[here], v[here]
        for x, y in ((u, v), (v, u)):
            at, inverse = np.unique(x, return_inverse=True)
            if len(at):
                out.append((rows["id"][at], np.bincount(inverse, rows["size"][y]).astype(np.int64), rows["id"][at]))
    members = np.unique(np.concatenate([a, b]))
    label = np.full(len(rows["id"]), -1)
    label[members] = members
    while True:  # smallest row reachable inside the piece
        low = np.minimum(label[a], label[b])
        before = label[members].copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[members] = label[label[members]]
        if (before == label[members]).all():
            break
    tied = members[label[members] != members]
    out.append((rows["id"][tied], np.zeros(len(tied), np.int64), rows["id"][label[tied]]))


def _links(pieces: DataFrame, least: float, single: bool) -> DataFrame:
    """(id, links, other): rows dealt and sorted by piece are compared piece by piece while they stream."""
    kind = np.float32 if single else np.float64

    def compare(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table[c].to_numpy() for c in ("group", "bucket", "i", "j")])
        part = table["part"].to_numpy()
        raw, codes = table["vector"].to_pylist(), table["codes"].to_pylist()
        ids, sizes = table["id"].to_numpy(), table["size"].to_numpy().astype(float)
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        out: list = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            if e - s < 2:
                continue
            rows = {
                "unit": unit_rows(np.frombuffer(b"".join(raw[s:e]), kind).reshape(e - s, -1)), "id": ids[s:e], "size": sizes[s:e],
                "codes": np.frombuffer(b"".join(codes[s:e]), "<i8").reshape(e - s, TABLES, PROBES),
            }
            own = part[s:e] == key[2, s]
            same = key[2, s] == key[3, s]
            left = np.flatnonzero(own)
            _compare(rows, int(key[1, s]), left, left if same else np.flatnonzero(~own), bool(same), least, out)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GATHER:
                table = pa.Table.from_batches(held)
                key = np.stack([table[c].to_numpy() for c in ("group", "bucket", "i", "j")])
                last = np.flatnonzero((key != key[:, -1:]).any(0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last piece may go on in the next batch
                if cut:
                    yield compare(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if n:
            yield compare(pa.Table.from_batches(held))

    keys = ["group", "bucket", "i", "j"]
    return pieces.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, links long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null and their cosine in double precision is at least ``least``;
    null, zero and zero-length vectors and those with null or non-finite components link with nothing, as do vectors
    of different length. n_links counts other vectors linked directly, copies included; component_id is the smallest
    vec_id reachable, the vector itself included. A repeated vec_id gives one row per input row and counts as another
    vector for n_links; a null vec_id takes part in counts, gets its class's component and is never kept. Other columns
    are ignored; an empty table gives an empty result.
    """
    ready(vectors.sparkSession)
    element = vectors.schema["embedding"].dataType.elementType
    single = isinstance(element, S.FloatType)
    clean = F.transform(F.col("embedding"), lambda v: v + F.lit(0).cast(element))  # -0 becomes 0
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    nonzero = F.exists("embedding", lambda v: v != 0)
    valid = F.coalesce(F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    rows = store(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), clean.alias("embedding"), F.col("label").cast("string").alias("label"), valid.alias("valid"))
        .withColumn("class", F.when(F.col("valid"), F.struct("label", F.xxhash64("embedding").alias("x"), F.md5(F.to_json("embedding").cast("binary")).alias("y"))))
    )
    classes = (
        rows.where("valid").groupBy("class")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .where("id is not null")
    )
    hashed = store(_hashed(classes.select("id", "label", "size", "embedding"), single).withColumn("group", F.xxhash64("label", "dim")))
    entries = hashed.select("id", "group", F.explode("entered").alias("bucket"))
    crowded = store(entries.groupBy("group", "bucket").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / PIECE).cast("int")
    placed = (
        entries.join(crowded, ["group", "bucket"]).withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", "group", "bucket", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    found = store(_links(placed.join(hashed.select("id", "size", "vector", "codes"), "id"), least, single))
    per_class = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found, "id", "other")
    ids = rows.where("valid").groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    known = store(
        ids.join(per_class, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    return (
        rows.select("vec_id", "class").join(known, "class", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )

"""Language identification by nearest centroid.

A text is a TF-IDF vector over hashed byte trigrams of its lower-cased letters, scaled to length one. Every language
has several centroids from spherical k-means, so mixtures of styles do not blur into one mean. The best cosine decides;
a text too far from its best centroid is rejected.

Fitting: document frequencies count all training documents. Centroids are fitted on at most SAMPLE documents per
language, chosen by a hash of doc_id. Prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docaudit.llm import text as T
from docaudit.llm.common import bounded_sample, pieces, store, texts

#: Hash buckets of trigrams, centroids per language, sampled documents per language.
BUCKETS, CENTROIDS, SAMPLE = 4096, 4, 1000
#: A vector of few trigrams cannot come near a centroid: reach(g) = sqrt(g / (g + HALF)) of the cosine is expected.
HALF = 200.0
#: Rejected below this share of the smallest ratio of cosine to reach that the language's own sample shows.
MARGIN = 0.35
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def counts(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts (rows by BUCKETS) and the number of trigrams per row; a trigram has a letter in its middle."""
    rows = [v.lower().encode() if v else b"" for v in values]
    data = np.frombuffer(b" " + b" ".join(rows) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in rows])
    starts = ends - np.array([len(r) for r in rows], np.int64)
    clean = np.where(_LETTER[data], data, 32).astype(np.uint32)
    gram = (clean[:-2] << 16) | (clean[1:-1] << 8) | clean[2:]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
    middle = _LETTER[data[1:-1]]
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        own = bucket[a - 1 : b - 1][middle[a - 1 : b - 1]]
        out[i] = np.bincount(own, minlength=BUCKETS)
    return out, out.sum(1)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(tf) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm == 0, 1, norm)


def reach(grams: np.ndarray) -> np.ndarray:
    return np.sqrt(grams / (grams + HALF))


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first seeds: centroids of length one and the cluster of every row."""
    chosen = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(x[(x @ np.stack(chosen).T).max(1).argmin()])
    centre = np.stack(chosen)
    for _ in range(rounds):
        centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        own = (x @ centre.T).argmax(1)
        centre = np.stack([x[own == j].mean(0) if (own == j).any() else centre[j] for j in range(len(centre))])
    centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32), (x @ centre.T).argmax(1)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, values: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and rejection of every text; no letter: UNKNOWN, 0, rejected."""
        known = np.array([any(map(str.isalpha, v)) if v else False for v in values])
        if not self.languages:
            return [UNKNOWN] * len(values), np.zeros(len(values)), np.ones(len(values), bool)
        tf, grams = counts(values)
        cosine = vectors(tf, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
        rejected = ~known | (score < self.floors[best] * reach(grams))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), rejected


def _document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """Over all training documents: one row per bucket and task is added up by Spark, BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in pieces(batches, "text"):
            total += (counts(batch.column("text").to_pylist())[0] > 0).sum(0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS, dtype=np.int32)), pa.array(np.concatenate([[rows], total]))], ["bucket", "n"])

    found = dict(training.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect())
    return np.array([found.get(i, 0) for i in range(BUCKETS)], float), int(found.get(-1, 0))


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from doc_id, text and lang; rows without a lang are ignored."""
    training = texts(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null")
    frequency, rows = _document_frequencies(training)
    idf = np.log((1 + rows) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    chosen = bounded_sample(training, "lang", sample)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            tf, grams = counts(batch.column("text").to_pylist())
            own = vectors(tf, idf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("n"), pa.array(grams.astype(float)), pa.array([v.tobytes() for v in own], pa.binary())],
                ["lang", "n", "grams", "vector"],
            )

    # Repeated rows of one doc_id may meet each other here; they only repeat a training vector.
    sampled = store(training.join(chosen, ["doc_id", "lang"]).mapInArrow(embed, "lang string, n int, grams double, vector binary"))

    def per_language(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["grams"] > 0].sort_values(["n", "grams"])
        if frame.empty:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        x = np.frombuffer(b"".join(frame["vector"]), np.float32).reshape(len(frame), BUCKETS)
        centre, own = cluster(x, centroids)
        ratio = (x * centre[own]).sum(1) / reach(frame["grams"].to_numpy())
        floor = MARGIN * float(ratio.min())
        rows = [(frame["lang"].iloc[0], centre[j].tobytes(), floor) for j in range(len(centre)) if (own == j).any()]
        return pd.DataFrame(rows, columns=["lang", "centroid", "floor"])

    model = sampled.groupBy("lang").applyInPandas(per_language, "lang string, centroid binary, floor double").orderBy("lang", "centroid").collect()
    flat = np.frombuffer(b"".join(r["centroid"] for r in model), np.float32).reshape(-1, BUCKETS)
    return Model(idf, [r["lang"] for r in model], flat, np.array([r["floor"] for r in model]))


def held_out(doc_id: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_language(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with one more column ``name``: a struct of lang_pred, score and rejected.

    Null texts and texts without a letter get ``und``, score 0 and are rejected. Long texts are read whole. An empty
    table gives an empty result; a model without languages answers ``und`` throughout.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(values: pd.Series) -> pd.DataFrame:
        found: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        rows, size = [], 0
        for v in [*values, None]:
            rows.append(v)
            size += len(v) if isinstance(v, str) else 0
            if size > 1 << 20 or len(rows) == 256:
                found.append(model.predict(rows))
                rows, size = [], 0
        if rows:
            found.append(model.predict(rows))
        langs = [x for f in found for x in f[0]]
        frame = pd.DataFrame({"lang_pred": langs, "score": np.concatenate([f[1] for f in found]), "rejected": np.concatenate([f[2] for f in found])})
        return frame.iloc[: len(values)]

    return docs.withColumn(name, predict(F.col("text").cast("string")))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row; other columns are ignored. See with_language."""
    found = with_language(docs.select("doc_id", "text"), model, "found")
    return found.select("doc_id", "found.lang_pred", "found.score", "found.rejected")

"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 harmful, 1 poor, 2 good. One weight vector over hashed text features is shared by all grades;
ordered thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score). The model gives the expected grade and
the tail probability P(grade >= 1) by which documents are selected.

Features: presence of every letter run and of its leading parts (so inflected forms share weight), presence of sign runs,
and bands of a few shares of the whole text (upper case, signs, digits, repeated neighbours, distinct words). Presence does not fade
in long texts: one harmful word counts the same in a page and in a book.

Fitting uses at most SAMPLE documents per grade, chosen by a hash of doc_id; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docaudit.llm import text as T
from docaudit.llm.common import bounded_sample, pieces, store, texts

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
SAMPLE = 2000
#: Selected from this probability of a grade of 1 or more.
KEEP = 0.5

U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN = ~(_LETTER | T.SPACE)
_SIGN[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BANDS = 16


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a run ends with its row."""
    mark = np.append(inside, False)
    border = np.zeros(len(mark), bool)
    border[offsets] = True
    before = np.append(False, inside)
    return np.flatnonzero(mark & (~before | border)), np.flatnonzero(before & (~mark | border))


def features(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct feature numbers of every text."""
    raw, offsets = T.block(column)
    data = T.LOWER[raw]
    starts, ends = _runs(_LETTER[data], offsets)
    sizes = ends - starts
    hashes, at = [T.span_hashes(data, starts, ends)], [starts]
    for k in PREFIXES:
        long = sizes > k
        hashes.append(T.mix(T.span_hashes(data, starts[long], starts[long] + k) + U(k)))
        at.append(starts[long])
    s, e = _runs(_SIGN[data], offsets)
    hashes.append(T.mix(T.span_hashes(data, s, np.minimum(e, s + 4)) + U(99)))
    at.append(s)
    number = (np.concatenate(hashes) % U(BUCKETS - 128)).astype(np.int64)
    place = np.concatenate(at)
    order = np.argsort(place, kind="stable")
    number, place = number[order], place[order]
    cut = np.searchsorted(place, offsets)

    total = np.maximum(1, np.diff(offsets))
    share = lambda table: np.add.reduceat(np.append(table[raw], False).astype(np.int64), offsets)[:-1] / total
    word = hashes[0]
    row = np.searchsorted(offsets, starts, side="right") - 1
    again = np.append(False, (word[1:] == word[:-1]) & (row[1:] == row[:-1])) if len(word) else np.zeros(0, bool)
    words = np.bincount(row, minlength=len(total))
    repeated = np.bincount(row, again, minlength=len(total)) / np.maximum(1, words)
    bands = [np.minimum(_BANDS - 1, (np.where(np.diff(offsets) > 0, x, 0) * _BANDS * w).astype(np.int64)) for x, w in
             ((share(_UPPER), 1), (share(_SIGN), 2), (share(_DIGIT), 2), (repeated, 1))]
    out = []
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        shape = [BUCKETS - 128 + j * _BANDS + int(x[i]) for j, x in enumerate(bands)]
        out.append(np.concatenate([np.unique(number[a:b]), shape]))
    return out


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows])


def fit_selected(rows: list[np.ndarray], grades: np.ndarray, levels: int = 3) -> Ordinal:
    """A strongly penalised fit chooses the features, a weakly penalised one weighs them."""
    first = fit_ordinal(rows, grades, levels, rounds=300, step=0.1, sparsity=2e-3)
    chosen = first.weights != 0
    chosen[BUCKETS - 128 :] = True  # every text has its bands, so no row is empty
    return fit_ordinal([r[chosen[r]] for r in rows], grades, levels, rounds=400, step=0.3, sparsity=2e-4)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int, rounds: int, step: float, sparsity: float) -> Ordinal:
    """Maximum likelihood with an L1 penalty by proximal Adagrad; every grade has the same total weight.

    Thresholds are kept in order by writing them as a first one and positive gaps.
    """
    sizes = np.array([len(r) for r in rows])
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(rows)), sizes)
    weight = 1 / np.bincount(grades, minlength=levels)[grades] / len(np.unique(grades))
    w, cuts = np.zeros(len(used)), np.concatenate([[-1.0], np.zeros(levels - 2)])
    history, cut_history = np.full(len(used), 1e-8), np.full(levels - 1, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    rank = np.arange(len(rows))
    for _ in range(rounds):
        thresholds = np.cumsum(np.concatenate([[cuts[0]], np.exp(cuts[1:])]))
        score = np.add.reduceat(w[flat], begin)
        edges = np.concatenate([np.full((len(rows), 1), -np.inf), thresholds[None, :] - score[:, None], np.full((len(rows), 1), np.inf)], 1)
        below = sigmoid(edges)
        high, low = below[rank, grades + 1], below[rank, grades]
        mass = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / mass * weight, low * (1 - low) / mass * weight
        # Gradient of the log-likelihood by the thresholds, and by the score (minus the sum of both).
        by_cut = np.zeros(levels + 1)
        np.add.at(by_cut, grades + 1, d_high)
        np.add.at(by_cut, grades, -d_low)
        by_cut = by_cut[1:levels]
        gradient = np.bincount(flat, (d_low - d_high)[owner], minlength=len(used))
        history += gradient**2
        pace = step / np.sqrt(history)
        w += pace * gradient
        w = np.sign(w) * np.maximum(0, np.abs(w) - pace * sparsity)
        later = np.cumsum(by_cut[::-1])[::-1]
        by_part = np.concatenate([[later[0]], later[1:] * np.exp(cuts[1:])])
        cut_history += by_part**2
        cuts += step * by_part / np.sqrt(cut_history)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Ordinal(weights, np.cumsum(np.concatenate([[cuts[0]], np.exp(cuts[1:])])))


def grade(quality: str = "quality", toxic: str = "toxic"):
    """0 harmful, 1 poor, 2 good; null without both labels."""
    return F.when(F.col(toxic).isNull() | F.col(quality).isNull(), None).when(F.col(toxic) > 0, 0).when(F.col(quality) > 0, 2).otherwise(1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Train on at most ``sample`` labelled documents per grade; a document with several labels counts with its lowest.

    Labels without a grade or a document are ignored. Without any, every document gets the same probabilities.
    """
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade().alias("grade")).where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = bounded_sample(graded, "grade", sample).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [r.astype(np.int32).tobytes() for r in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(rows, pa.binary())], ["doc_id", "grade", "numbers"])

    found = store(texts(docs).join(chosen, "doc_id").mapInArrow(run, "doc_id long, grade int, numbers binary")).orderBy("doc_id", "numbers").toPandas()
    if found.empty:
        return Ordinal(np.zeros(BUCKETS), np.array([-1.0, 0.0]))
    return fit_selected([np.frombuffer(n, np.int32).astype(np.int64) for n in found["numbers"]], found["grade"].to_numpy().astype(np.int64))


def rate(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, p_at_least_1, p_at_least_2, kept.

    kept is p_at_least_1 >= ``keep``. Null and empty texts have only the features of an empty text. Texts are read
    whole. Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    kept_weights = np.flatnonzero(model.weights)
    values, thresholds = model.weights[kept_weights], model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BUCKETS)
        weights[kept_weights] = values
        own = Ordinal(weights, thresholds)
        for batch in pieces(batches, "text"):
            tail = own.at_least(own.scores(features(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(tail[:, 0] >= keep)],
                ["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "kept"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean")

"""Periodic runs of words by internal pattern matching.

A run is a stretch with smallest period q and at least 4 q words (and at least 6) that no neighbour extends. Let B be the
power of two with B <= q < 2 B. Among the first B words of a run starts a dyadic block of B words (a start divisible by B)
that occurs again q words further on. So for every block the occurrences in the window of the B starts from B words
behind it on are asked for:

* a suffix array of the words gives the occurrences of a block as one interval; a wavelet matrix over the suffix array
  gives the smallest occurrence not before a place (range successor);
* one or two occurrences are candidate periods as they are;
* three or more form an arithmetic progression. Its difference p is a period of the block, and a run of period q leads
  from the block's p-periodic stretch to the next one, so q is the distance between the places where these two end.

Every candidate is extended to both sides by longest common extensions on the names of the dyadic factors; among runs over
the same stretch the smallest period is the true one. Documents of a batch lie side by side in one array, with words that
differ from document to document, so nothing reaches over a border and numpy works on all of them at once. Work is
n log n for n words, whatever they repeat.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docaudit.llm import text as T
from docaudit.llm.common import pieces, texts

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Levels of names kept for every word; longer extensions take several steps of the top level.
TOP = 10


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Number of every word in the batch's vocabulary, the first word of every row, and the vocabulary."""
    raw, offsets = T.block(column)
    starts, ends, first = T.words(raw, offsets)
    inside = ~T.SPACE[raw]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw[inside].tobytes())])
    coded = pc.dictionary_encode(values)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first, coded.dictionary.to_pylist()


def planted(words: np.ndarray, first: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """The words after the rule of the table: in a tenth of the documents a tail repeats a piece of itself.

    With h the unsigned CRC-32 of the decimal doc_id and g = h // 10, a document of n > 0 words with h % 10 = 0 gets word
    a + (i - a) % p in place of every word i >= a, where a = g % n and p = 1 + (n - a) // (3 + g % 8). A null doc_id
    changes nothing.
    """
    words = words.copy()
    for row, doc_id in enumerate(doc_ids):
        low, high = int(first[row]), int(first[row + 1])
        n = high - low
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[low + a : high] = words[low + a + np.arange(n - a) % p]
    return words


class Wavelet:
    """Wavelet matrix over an array of places: the smallest values of an interval that are not below a bound."""

    def __init__(self, values: np.ndarray):
        self._bits = max(1, int(len(values) - 1).bit_length())
        self._zeros, self._counts = [], []
        for bit in range(self._bits - 1, -1, -1):
            one = (values >> bit) & 1
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(one, out=count[1:])
            self._counts.append(count)
            self._zeros.append(len(values) - int(count[-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places low..high are less than ``bound``, which has no more bits than the values."""
        out = np.zeros(len(low), np.int64)
        for level, (count, zeros) in enumerate(zip(self._counts, self._zeros, strict=True)):
            one = (bound >> (self._bits - 1 - level)) & 1 == 1
            a, b = count[low].astype(np.int64), count[high].astype(np.int64)
            out += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value that has k smaller ones at places low..high; k is less than their number."""
        out = np.zeros(len(low), np.int64)
        for level, (count, zeros) in enumerate(zip(self._counts, self._zeros, strict=True)):
            a, b = count[low].astype(np.int64), count[high].astype(np.int64)
            left = (high - b) - (low - a)
            one = k >= left
            k = np.where(one, k - left, k)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
            out |= one.astype(np.int64) << (self._bits - 1 - level)
        return out


class Factors:
    """Names of dyadic factors and the suffix order of an array of words, refined only where factors are repeated."""

    def __init__(self, words: np.ndarray, levels: int):
        n = len(words)
        self.n = n
        _, name, size = np.unique(words, return_inverse=True, return_counts=True)
        low = np.cumsum(size) - size
        self.names: list[np.ndarray] = []  # per level up to TOP: name of the factor from every word on
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # per level: repeated blocks and their intervals
        order = np.argsort(name, kind="stable")
        rank, width = low[name], size[name]  # first place of a factor's interval in the suffix order, and its size
        for level in range(levels):
            step = 1 << level
            if level <= TOP:
                self.names.append(rank.astype(np.int32))
            at = np.arange(0, n, step)
            at = at[width[at] > 1]
            self.blocks.append((at, rank[at], rank[at] + width[at]))
            if level + 1 == levels:
                break
            # Double: only intervals with several suffixes are sorted on, by the name of what follows.
            places = np.flatnonzero(width[order] > 1)
            if not len(places):
                break
            suffix = order[places]
            follow = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)], -1 - suffix)
            key = rank[suffix]
            sort = np.lexsort((follow, key))
            suffix, follow, key = suffix[sort], follow[sort], key[sort]
            order[places] = suffix  # the intervals are the same places, now in finer order
            opens = np.ones(len(suffix), bool)
            opens[1:] = (key[1:] != key[:-1]) | (follow[1:] != follow[:-1])
            heads = np.flatnonzero(opens)
            group = np.cumsum(opens) - 1
            rank, width = rank.copy(), width.copy()
            rank[suffix] = places[heads][group]
            width[suffix] = np.diff(np.append(heads, len(suffix)))[group]
        self.order = order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor from i and from j on, i < j."""
        return self._extend(i.copy(), j.copy(), 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends before i and before j, i < j."""
        return self._extend(i.copy(), j.copy(), -1)

    def periodic(self, i: np.ndarray, j: np.ndarray, p: np.ndarray, level: int) -> np.ndarray:
        """Whether period p of the blocks of a level that start at i and at j holds from i to j; j is less than two blocks behind i."""
        if level > TOP:
            return self.forward(i, i + p) >= j - i
        return self._same(i.copy(), i + p, level, 1) & self._same(j - (1 << level), j - (1 << level) + p, level, 1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        top = len(self.names) - 1
        live = np.arange(len(i))
        while len(live):  # whole steps of the top level
            ok = self._same(i[live], j[live], top, way)
            live = live[ok]
            out[live] += 1 << top
            i[live] += way << top
            j[live] += way << top
        for level in range(top - 1, -1, -1):
            ok = np.flatnonzero(self._same(i, j, level, way))
            out[ok] += 1 << level
            i[ok] += way << level
            j[ok] += way << level
        return out

    def _same(self, i: np.ndarray, j: np.ndarray, level: int, way: int) -> np.ndarray:
        step, names = 1 << level, self.names[level]
        if way < 0:
            i, j = i - step, j - step
        inside = (i >= 0) & (j + step <= self.n)
        return inside & (names[np.where(inside, i, 0)] == names[np.where(inside, j, 0)])


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of a batch, by start, then period; ``first``: the first word of every row."""
    sizes = np.diff(first)
    longest = int(sizes.max()) if len(sizes) else 0
    none = np.zeros(0, np.int64)
    if longest < LEAST_WORDS:
        return none, none, none
    row = np.repeat(np.arange(len(sizes)), sizes)
    levels = max(1, (longest // LEAST_EXPONENT).bit_length())  # blocks of at most a quarter of the longest row
    factors = Factors(words + row * (int(words.max()) + 1), levels)
    wavelet = Wavelet(factors.order)
    starts, periods = [none], [none]
    for level, (at, low, high) in enumerate(factors.blocks):
        block = 1 << level
        some = at + block < factors.n
        at, low, high = at[some], low[some], high[some]
        before = wavelet.below(low, high, at + block)
        found = np.full((3, len(at)), factors.n, np.int64)
        asked = np.arange(len(at))
        for k in range(min(3, block)):
            asked = asked[before[asked] + k < (high - low)[asked]]
            found[k, asked] = wavelet.smallest(low[asked], high[asked], before[asked] + k)
            asked = asked[found[k, asked] < at[asked] + 2 * block]
        inside = found < at + 2 * block
        few = inside & ~inside[2]
        # A block that repeats at the same distance as the block before it lies in the same run: one of them is enough.
        codes = np.unique(np.concatenate([(found[k] - at)[few[k]] * factors.n + at[few[k]] // block for k in range(2)]))
        codes = codes[~np.isin(codes - 1, codes) | (codes % factors.n == 0)]
        starts.append(codes % factors.n * block)
        periods.append(codes // factors.n)
        many = np.flatnonzero(inside[2])
        i, j, p = at[many], found[0, many], found[1, many] - found[0, many]
        other = ~factors.periodic(i, j, p, level)  # else the block and its copies lie in one run of period p
        i, j, p = i[other], j[other], p[other]
        q = j + factors.forward(j, j + p) - i - factors.forward(i, i + p)
        good = (q >= block) & (q < 2 * block)
        starts.append(i[good])
        periods.append(q[good])
    i, q = np.concatenate(starts), np.concatenate(periods)
    left = factors.backward(i, i + q)
    right = factors.forward(i, i + q)
    start, length = i - left, left + right + q
    good = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
    start, length, q = start[good], length[good], q[good]
    sort = np.lexsort((q, length, start))
    start, length, q = start[sort], length[sort], q[sort]
    new = np.ones(len(start), bool)  # the smallest period of a stretch is its period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    sort = np.lexsort((q, start))
    return start[sort], length[sort], q[sort]


_COLUMNS = {
    "doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "n_words": pa.int64(), "n_dropped": pa.int64(),
}


def _longest_power(starts: list[int], lengths: list[int], periods: list[int]) -> int:
    """The run with the greatest exact length / period; of equal ones the first."""
    best = 0
    for k in range(1, len(starts)):
        if lengths[k] * periods[best] > lengths[best] * periods[k]:
            best = k
    return best


def _described(batch: pa.RecordBatch, plant: bool, with_text: bool) -> pa.RecordBatch:
    ids = batch.column("doc_id").to_pylist()
    words, first, vocabulary = split_words(batch.column("text"))
    if plant:
        words = planted(words, first, ids)
    start, length, period = find_runs(words, first)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone[:-1]) == 0
    edges = np.searchsorted(start, first)
    n_kept = np.concatenate([[0], np.cumsum(kept)])
    out: dict[str, list] = {name: [] for name in (*_COLUMNS, *(["collapsed", "runs"] if with_text else []))}
    for row, doc_id in enumerate(ids):
        low, high = int(first[row]), int(first[row + 1])
        own = slice(int(edges[row]), int(edges[row + 1]))
        s, l, q = (start[own] - low).tolist(), length[own].tolist(), period[own].tolist()
        best = _longest_power(s, l, q) if s else None
        body = b" ".join(map(vocabulary.__getitem__, words[low:high][kept[low:high]].tolist()))
        for name, value in (
            ("doc_id", doc_id), ("n_runs", len(s)), ("start", None if best is None else s[best]), ("length", None if best is None else l[best]),
            ("period", None if best is None else q[best]), ("exponent_milli", None if best is None else 1000 * l[best] // q[best]),
            ("runs_sha256", hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in zip(s, l, q, strict=True)).encode()).hexdigest()),
            ("collapsed_sha256", hashlib.sha256(body).hexdigest()),
            ("n_words", high - low), ("n_dropped", high - low - int(n_kept[high] - n_kept[low])),
        ):
            out[name].append(value)
        if with_text:
            out["collapsed"].append(body.decode("utf-8", "replace"))
            out["runs"].append([{"start": a, "length": b, "period": c} for a, b, c in zip(s, l, q, strict=True)])
    kinds = _COLUMNS | {"collapsed": pa.string(), "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in out.items()], list(out))


def periodic_runs(docs: DataFrame, plant: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the run of the greatest exponent (start, length, period,
    exponent_milli = floor(1000 * length / period)), runs_sha256, collapsed_sha256, n_words, n_dropped; with ``with_text``
    also collapsed (the text without the repetitions) and runs.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q and at least
    max(6, 4 q) words that no neighbour extends at that period. collapsed drops the words of every run after its first q
    and joins the others by one blank. Of runs with the same exponent the first stands in the row (smallest start, then
    period); no run gives four nulls. runs_sha256 is of one line ``start,length,period`` per run by start, then period.
    With ``plant`` the words are changed first by the rule of ``planted``. A null, empty or blank text has no words and no
    runs. Null and repeated doc_ids stay as they are, one row each. Other columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield _described(batch, plant, with_text)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
    if with_text:
        schema += ", collapsed string, runs array<struct<start: long, length: long, period: long>>"
    return texts(docs).mapInArrow(run, schema)

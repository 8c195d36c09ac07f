"""Token counts by a map-side lookup in two tiers: a broadcast table of frequent pre-tokens, then a cache in every worker.

A pre-token is a run of blanks with the characters up to the next blank; a line feed stands alone. No piece of the model
reaches over such a border, so the number of tokens of a text is the sum over its pre-tokens. The first tier is a hash
table of the lengths of frequent pre-tokens, counted over all texts and sent to all tasks once. What it misses is
looked up in the worker's own cache, and what that misses is encoded by the library and remembered. Only the counts of
distinct pre-tokens are shuffled. Both tiers compare bytes, so they decide what a count costs and never what it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docaudit.llm import text as T
from docaudit.llm.common import pieces, store, texts

BLANK_SIGN = "▁"
_BLANK, _FEED = 32, 10
#: Entries of the broadcast table, and bytes of its longest pre-token: with the hash slots at most 8 MB.
MOST_FREQUENT, LONGEST_FREQUENT = 1 << 16, 48
#: Pre-tokens a task counts before it hands them on, and rows handed on at once.
COUNTED, HANDED_ROWS = 1 << 18, 1 << 14
#: Pre-tokens a worker remembers before it starts anew; forgetting them costs time only.
MEMO = 1 << 19


class Lengths(T.SpanTable):
    """Number of tokens of every remembered pre-token."""

    def clear(self) -> None:
        super().clear()
        self.values = np.zeros(0, np.int32)

    def keep(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> None:
        self.add(hashes, data, starts, ends)
        self.values = np.concatenate([self.values, values.astype(np.int32)])


class TokenCounter:
    """Counts the tokens of a block of texts with a sentencepiece model.

    A model that could join pieces over a border (a piece with a blank sign after another character or with a line feed,
    user-defined pieces, another normalisation than escaping blanks behind one added blank) gets whole texts as units.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        self.splits = plain and not model.trainer_spec.treat_whitespace_as_suffix and not any(
            p.type == p.USER_DEFINED or BLANK_SIGN in p.piece.lstrip(BLANK_SIGN) or "\n" in p.piece for p in model.pieces
        )
        self._blank = self._size("a ") - self._size("a")  # a blank that no character follows
        self._feed = self._size("\n") - self._blank
        self.memo = Lengths(20)

    def _size(self, value: str) -> int:
        return len(self._library.encode(value))

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and known numbers of tokens (-1: look the bytes up) of pre-tokens, and the first one of every row.

        The library adds one blank, so a pre-token is looked up without its first blank (the first of a text whole), and
        one that follows a line feed without a blank together with that line feed.
        """
        rows = np.flatnonzero(np.diff(offsets))
        if not self.splits:
            starts, ends = offsets[:-1][rows], offsets[1:][rows]
            return starts, ends, np.full(len(rows), -1), np.searchsorted(starts, offsets)
        opens = np.zeros(len(raw) + 1, bool)
        opens[offsets] = True
        blank, feed = raw == _BLANK, raw == _FEED
        border = opens.copy()
        border[:-1] |= feed
        border[1:-1] |= feed[:-1] | (blank[1:] & ~blank[:-1])
        places = np.flatnonzero(border)
        starts, ends = places[:-1], places[1:]
        first, open_ = np.searchsorted(starts, offsets), opens[starts]
        known = np.full(len(starts), -1)
        is_feed = feed[starts]
        known[is_feed] = self._feed + np.where(open_[is_feed], self._blank, 0)
        after_feed = ~open_ & ~blank[starts] & ~is_feed  # the character before can only be a line feed
        starts = starts - after_feed
        starts = starts + (blank[starts] & ~open_)
        known[(starts == ends) & (known < 0)] = self._blank
        return starts, ends, known, first

    def sizes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of tokens of looked-up bytes, from the library."""
        body = raw.tobytes()
        values = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = np.array([len(i) for i in self._library.encode(values, num_threads=1)], np.int64)
        if self.splits:
            found -= np.where(raw[starts] == _FEED, self._feed + self._blank, 0)
        return found

    def count(self, column: pa.Array, frequent: Lengths | None = None) -> np.ndarray:
        """Tokens of every text."""
        if self.memo.n > MEMO:
            self.memo.clear()
        raw, offsets = T.block(pc.replace_substring(column, BLANK_SIGN, " ") if self.splits else column)
        starts, ends, values, first = self.units(raw, offsets)
        open_ = np.flatnonzero(values < 0)
        view, hashes = T.lanes(raw), T.word_hashes(raw, starts[open_], ends[open_])
        if frequent is not None:
            rows = frequent.find(hashes, view, starts[open_], ends[open_])
            hit = rows >= 0
            values[open_[hit]] = frequent.values[rows[hit]]
            open_, hashes = open_[~hit], hashes[~hit]
        s, e = starts[open_], ends[open_]
        rows = self.memo.find(hashes, view, s, e)
        new = self.memo.unknown(hashes, rows, e - s)
        if len(new):
            self.memo.keep(hashes[new], raw, s[new], e[new], self.sizes(raw, s[new], e[new]))
            rows = self.memo.find(hashes, view, s, e)
        held = rows >= 0
        values[open_[held]] = self.memo.values[rows[held]]
        if not held.all():  # very long, or of the same hash as another
            values[open_[~held]] = self.sizes(raw, s[~held], e[~held])
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first[1:]] - total[first[:-1]]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per worker process."""
    if path not in _COUNTERS:
        if not path.endswith(".model"):
            raise ValueError("token counts need a sentencepiece .model file")
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def _sampled(partition: int) -> bool:
    """All of the first 16 partitions, then 8 of every doubling. Nothing asks for it any more: all partitions are counted."""
    return partition < 16 or partition % (1 << (partition.bit_length() - 4)) == 0


def frequent_lengths(docs: DataFrame, path: str) -> Lengths:
    """The most frequent pre-tokens of all texts, with their numbers of tokens.

    Every text is read whole. A task counts in a table of bounded size and hands it on when that is full, so counts of one
    pre-token are added up behind a shuffle of (pre-token, count); at most MOST_FREQUENT rows reach the driver in all,
    beside one row per distinct count. Only these are encoded. Pre-tokens of more than LONGEST_FREQUENT bytes have no place
    in the table and are left to the caches of the workers.
    """

    def counted(units: list[bytes], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(units), HANDED_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(units[i : i + HANDED_ROWS], pa.binary()), pa.array(n[i : i + HANDED_ROWS], pa.int64())], ["unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, counts = counter(path), T.SpanTable(20), np.zeros(0, np.int64)
        for batch in pieces(batches, "text"):
            column = batch.column("text")
            raw, offsets = T.block(pc.replace_substring(column, BLANK_SIGN, " ") if own.splits else column)
            starts, ends, known, _ = own.units(raw, offsets)
            some = np.flatnonzero((known < 0) & (ends - starts <= LONGEST_FREQUENT))
            view, hashes = T.lanes(raw), T.word_hashes(raw, starts[some], ends[some])
            for i in range(0, len(some), COUNTED):  # a long text may hold more than the table has room for
                if table.n > COUNTED:
                    yield from counted([table.span(j) for j in range(table.n)], counts)
                    table.clear()
                    counts = np.zeros(0, np.int64)
                s, e, h = starts[some[i : i + COUNTED]], ends[some[i : i + COUNTED]], hashes[i : i + COUNTED]
                new = table.unknown(h, table.find(h, view, s, e), e - s)
                table.add(h[new], raw, s[new], e[new])
                rows = table.find(h, view, s, e)
                counts = np.concatenate([counts, np.zeros(len(new), np.int64)]) + np.bincount(rows[rows >= 0], minlength=table.n)
                clash = np.flatnonzero(rows < 0)  # of the same hash as another
                yield from counted([raw[a:b].tobytes() for a, b in zip(s[clash].tolist(), e[clash].tolist(), strict=True)], np.ones(len(clash), np.int64))
        yield from counted([table.span(j) for j in range(table.n)], counts)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            units = batch.column("unit").to_pylist()
            ends = np.cumsum([len(u) for u in units], dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if len(units) else ends
            sizes = own.sizes(np.frombuffer(b"".join(units), np.uint8), starts, ends)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(sizes, pa.int32())], ["unit", "n_tokens"])

    found = texts(docs).select("text").mapInArrow(run, "unit binary, n long")
    summed = store(found.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1"))
    # The least count that fits the table, from the number of pre-tokens per count: so nothing else leaves the tasks.
    least, held = 2, 0
    for n, units_ in sorted(map(tuple, summed.groupBy("n").count().collect()), reverse=True):
        if held + units_ > MOST_FREQUENT:
            least = n + 1
            break
        held += units_
    rows = summed.where(F.col("n") >= least).select("unit").mapInArrow(sized, "unit binary, n_tokens int").collect()
    table = Lengths(18)
    if rows:
        units = [bytes(r["unit"]) for r in rows]
        ends = np.cumsum([len(u) for u in units])
        starts = np.concatenate([[0], ends[:-1]])
        raw = np.frombuffer(b"".join(units), np.uint8)
        hashes = T.word_hashes(raw, starts, ends)
        once = np.sort(np.unique(np.maximum(hashes, T.U(1)), return_index=True)[1])
        values = np.array([r["n_tokens"] for r in rows])
        table.keep(hashes[once], raw, starts[once], ends[once], values[once])
    return table


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those the library gives for the whole text without begin and end signs; signs of special tokens inside a
    text are plain characters. A null text is empty; an empty text has no bytes and no tokens. Null and repeated doc_ids
    stay as they are, one row each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in pieces(batches, "text"):
            n_tokens = own.count(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(pc.binary_length(batch.column("text")), pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

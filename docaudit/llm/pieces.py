"""SentencePiece-style encoding with a unigram model: Viterbi over a double-array trie of pieces with log scores.

A text gets one blank before it and blanks become a marker; its encoding is the sequence of pieces with the highest sum
of log scores. A character that no piece of its own covers falls back to its UTF-8 bytes. Decoding joins the bytes of
all pieces, turns markers into blanks and drops the first one, so decoding an encoding gives the text back exactly.

No piece has a marker after another character and none holds a line feed, so the best path of a text is the
concatenation of the best paths of its chunks (markers and the characters up to the next one). Equal chunks are solved
once in a worker, and the unsolved chunks of a batch advance through the trie together, one array step a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docaudit.llm.common import pieces as cut
from docaudit.llm.common import texts

MARK = 0xFF  # never a byte of UTF-8
BLANK_SIGN = "▁"
#: Chunks remembered by a worker, and the longest that is solved in the common array; both cost time only.
MEMO, TOGETHER = 150_000, 48
#: An unknown character scores this much below the worst piece.
UNKNOWN_GAP = 10.0

_CHUNK = re.compile(rb"\xff*[^\xff\n]+|\xff+|\n")


class Trie:
    """Double-array trie: the child of state s by byte c is base[s] + c if check[base[s] + c] == s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = np.iinfo(np.int32).max  # taken, and no state is its parent
        todo, free = [(0, 0, len(order), 0)], 1
        while todo:
            state, low, high, depth = todo.pop()
            children: list[tuple[int, int, int]] = []
            i = low
            if len(keys[order[i]]) == depth:
                self.value[state] = order[i]
                i += 1
            while i < high:
                byte, first = keys[order[i]][depth], i
                while i < high and keys[order[i]][depth] == byte:
                    i += 1
                children.append((byte, first, i))
            if not children:
                continue
            labels = np.array([c[0] for c in children])
            at = -1
            while at < 0:  # the first place where all children fit
                if free + 4096 + 512 > len(self.check):
                    self._grow()
                while self.check[free] >= 0:
                    free += 1
                places = free + np.flatnonzero(self.check[free : free + 4096] < 0)
                places = places[places >= labels[0]]
                fits = (self.check[(places - labels[0])[:, None] + labels] < 0).all(1)
                if fits.any():
                    at = int(places[fits.argmax()])
                else:
                    free += 1024  # crowded: leave the rest of it empty
            base = at - int(labels[0])
            self.base[state] = base
            self.check[base + labels] = state
            todo += [(base + byte, first, last, depth + 1) for byte, first, last in children]

    def _grow(self) -> None:
        more = len(self.check)
        self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])


def _char_sizes(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character a lead byte starts; the marker is a character of one byte."""
    return np.select([lead == MARK, lead >= 0xF0, lead >= 0xE0, lead >= 0xC0], [1, 4, 3, 2], 1)


@dataclass
class PieceModel:
    """Pieces as bytes (marker instead of blank), their ids and log scores, and the ids of the 256 single bytes."""

    keys: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self) -> None:
        for key in self.keys:
            if MARK in key.lstrip(b"\xff") or b"\n" in key:
                raise ValueError(f"piece {key!r} crosses a chunk border")
        self.unknown = float(self.scores.min()) - UNKNOWN_GAP if len(self.scores) else -UNKNOWN_GAP
        self.memo: dict[bytes, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "_scalar")} | {"memo": {}}

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.keys)

    @cached_property
    def _scalar(self) -> dict[bytes, int]:
        return {k: i for i, k in enumerate(self.keys)}

    @cached_property
    def surface(self) -> list[bytes]:
        """Bytes of every id, markers still in place."""
        out = [b""] * (1 + max(int(self.ids.max()) if len(self.ids) else 0, int(self.byte_ids.max())))
        for key, id_ in zip(self.keys, self.ids.tolist(), strict=True):
            out[id_] = key
        for byte, id_ in enumerate(self.byte_ids.tolist()):
            out[id_] = bytes([byte])
        return out

    def solve(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of every chunk; all advance through the trie together."""
        trie, n = self.trie, len(chunks)
        sizes = np.array([len(c) for c in chunks])
        width = int(sizes.max())
        data = np.zeros((n, width + 1), np.uint8)
        data[:, :width][np.arange(width)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, how = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for s in range(width):
            row = np.flatnonzero((s < sizes) & (best[:, s] > -np.inf))
            if not len(row):
                continue
            length = _char_sizes(data[row, s])
            covered = np.zeros(len(row), bool)
            live, state, k = np.arange(len(row)), np.zeros(len(row), np.int64), 0
            while len(live):
                inside = s + k < sizes[row[live]]
                live, state = live[inside], state[inside]
                if not len(live):
                    break
                child = trie.base[state] + data[row[live], s + k]
                ok = trie.check[child] == state
                live, state, k = live[ok], child[ok], k + 1
                piece = trie.value[state]
                hit = piece >= 0
                at, piece = live[hit], piece[hit]
                covered[at[length[at] == k]] = True
                total = best[row[at], s] + self.scores[piece]
                better = total > best[row[at], s + k]
                r = row[at[better]]
                best[r, s + k], came[r, s + k], how[r, s + k] = total[better], s, piece[better]
            lone = np.flatnonzero(~covered)
            end = np.minimum(s + length[lone], sizes[row[lone]])
            total = best[row[lone], s] + self.unknown
            better = total > best[row[lone], end]
            r, e = row[lone[better]], end[better]
            best[r, e], came[r, e], how[r, e] = total[better], s, -1
        # Back from every end, all chunks together; ids are laid out from the right.
        room = np.full((n, width), -1, np.int64)
        at, fill, rows = sizes.copy(), np.full(n, width), np.arange(n)
        while len(rows):
            a = at[rows]
            piece, start = how[rows, a], came[rows, a]
            known = piece >= 0
            fill[rows[known]] -= 1
            room[rows[known], fill[rows[known]]] = self.ids[piece[known]]
            for r, x, y in zip(rows[~known].tolist(), start[~known].tolist(), a[~known].tolist(), strict=True):
                fill[r] -= y - x
                room[r, fill[r] : fill[r] + y - x] = self.byte_ids[data[r, x:y]]
            at[rows] = start
            rows = rows[start > 0]
        flat, used = room.astype("<u4"), (width - fill).tolist()
        return [flat[i, width - u :].tobytes() for i, u in enumerate(used)]

    def solve_long(self, chunk: bytes) -> bytes:
        """The same for one long chunk, byte by byte."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(chunk)
        best, came, how = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for s in range(n):
            here = best[s]
            if here == -np.inf:
                continue
            length = int(_char_sizes(np.array([chunk[s]]))[0])
            state, covered = 0, False
            for e in range(s, n):
                child = int(base[state]) + chunk[e]
                if check[child] != state:
                    break
                state = child
                piece = int(value[state])
                if piece >= 0:
                    covered |= e + 1 - s == length
                    total = here + float(self.scores[piece])
                    if total > best[e + 1]:
                        best[e + 1], came[e + 1], how[e + 1] = total, s, piece
            if not covered:
                e = min(n, s + length)
                if here + self.unknown > best[e]:
                    best[e], came[e], how[e] = here + self.unknown, s, -1
        out: list[int] = []
        at = n
        while at > 0:
            s, piece = came[at], how[at]
            out += [int(self.ids[piece])] if piece >= 0 else [int(self.byte_ids[b]) for b in chunk[s:at][::-1]]
            at = s
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, values: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text."""
        split = [_CHUNK.findall(b"\xff" + v.encode().replace(b" ", b"\xff")) for v in values]
        known = set().union(*split)
        new = [c for c in known if c not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(known)
        short = sorted((c for c in new if len(c) <= TOGETHER), key=len)
        for i in range(0, len(short), 2048):
            some = short[i : i + 2048]
            self.memo.update(zip(some, self.solve(some), strict=True))
        self.memo.update((c, self.solve_long(c)) for c in new if len(c) > TOGETHER)
        for chunks in split:
            yield np.frombuffer(b"".join(map(self.memo.__getitem__, chunks)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist())).replace(b"\xff", b" ")
        return raw[1:].decode()


def load(path: str) -> PieceModel:
    """A SentencePiece model file as a unigram model.

    Its ordinary pieces are listed by rank, so a piece gets the log probability of its rank under a 1 / rank law: a rule,
    nothing is trained.
    """
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=path)
    n = source.get_piece_size()
    bytes_ = [i for i in range(n) if source.is_byte(i)]
    plain = [i for i in range(n) if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i) or source.is_unused(i))]
    rank = np.arange(1, len(plain) + 1, dtype=float)
    keys = [source.id_to_piece(i).replace(BLANK_SIGN, "\x00").encode().replace(b"\x00", b"\xff") for i in plain]
    return PieceModel(keys, np.array(plain), -np.log(rank) - np.log((1 / rank).sum()), np.array(bytes_))


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process; a vocabulary file lies on every machine or is shipped with the job."""
    if path not in _MODELS:
        _MODELS[path] = load(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_pieces, text_sha256 and round_trip of every row of ``docs``.

    ids are those of the piece file; decoding them gives the text, which round_trip states for every row. Null counts as
    empty; an empty text is the piece of the leading blank. Texts of any length are encoded whole; literal
    marker signs in a text are spelled in bytes and come back as they were. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in cut(batches, "text", 1 << 20):
            values = batch.column("text").to_pylist()
            ids = list(own.encode(values))
            exact = [own.decode(i) == v for i, v in zip(ids, values, strict=True)]
            sizes = np.array([len(i) for i in ids])
            flat = np.concatenate(ids).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), column, pa.array(sizes), batch.column("text_sha256"), pa.array(exact)],
                ["doc_id", "ids", "n_pieces", "text_sha256", "round_trip"],
            )

    rows = texts(docs).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, text_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            found = [None if i is None else own.decode(np.array(i, np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

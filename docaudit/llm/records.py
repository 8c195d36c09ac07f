"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A data file is a sequence of frames: payload length (8 bytes, little-endian), masked CRC-32 of those 8 bytes, payload,
masked CRC-32 of the payload. A payload is doc_id, the number of tokens before it in its file, the number of its
tokens, the bytes per id (2 or 4), and the ids, little-endian. The index is a Parquet table with one row per record
(file, offset, length, n_tokens, doc_id), so a shuffled read needs no scan of the data.

Documents are range-partitioned and sorted by doc_id, so file numbers, offsets and token positions all ascend with it.
A task writes its file under a temporary name and renames it when it is complete: a repeated attempt writes the same
bytes, and what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docaudit.llm import text as T
from docaudit.llm.common import pieces, store, texts
from docaudit.session import shared_folder

U = np.uint64
_LENGTH, _CRC, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qQIB")
_NULL_ID = -(2**63)
#: Units a worker remembers before it starts anew; forgetting them costs time only.
MEMO = 1 << 20

def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, before: int, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = _HEAD.pack(_NULL_ID if doc_id is None else doc_id, before, len(ids), width) + ids.astype(f"<u{width}").tobytes()
    length = _LENGTH.pack(len(payload))
    return b"".join([length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))])


def unframe(data: memoryview | bytes, at: int = 0) -> tuple[int | None, int, np.ndarray, int]:
    """doc_id, tokens before, ids and the end of the record at ``at``; a damaged record raises ValueError."""
    head = bytes(data[at : at + 12])
    if len(head) < 12 or masked(head[:8]) != _CRC.unpack_from(head, 8)[0]:
        raise ValueError(f"damaged record length at {at}")
    size = _LENGTH.unpack_from(head)[0]
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) < size or masked(payload) != _CRC.unpack_from(data, at + 12 + size)[0]:
        raise ValueError(f"damaged record at {at}")
    doc_id, before, n, width = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", n, _HEAD.size).astype(np.uint32)
    return (None if doc_id == _NULL_ID else doc_id), before, ids, at + 16 + size


class Memo(T.SpanTable):
    """Ids of the units a worker has seen."""

    def clear(self) -> None:
        super().clear()
        self.begin, self.size, self.ids, self._filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint32), 0

    def keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the units added last, one after the other."""
        while self._filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self._filled : self._filled + len(ids)] = ids
        self.begin = np.concatenate([self.begin, self._filled + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self._filled += len(ids)


class UnitEncoder:
    """Encodes texts with a tokenizer file whose units end at white space, remembering the ids of units.

    The file drops white space and splits the rest into runs of letters, single digits and runs of signs, lower-cased,
    each ending in an id that marks the end of a unit. So a text's ids are those of its units in order. A word of plain
    ASCII is cut into units here; a word with other characters, an apostrophe (contractions) or a < (special tokens) goes
    to the library whole. A remembered unit is found by a hash and told apart by its bytes.
    """

    _PLAIN = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 digit, 3 sign, 4 left to the library
    _PLAIN[33:127] = 3
    _PLAIN[48:58] = 2
    _PLAIN[65:91] = _PLAIN[97:123] = 1
    _PLAIN[[39, 60]] = 4
    _PLAIN[T.SPACE] = 0

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._end_id = end_id
        self._last = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for piece, id_ in self._tokenizer.get_vocab().items():
            self._last[id_] = piece.endswith("</w>")
        self._memo = Memo()

    def _encode(self, values: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(values, add_special_tokens=False)]

    def _together(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of many plain units: encoded in long lines, cut after the marked ids."""
        found = [np.array(i, np.uint32) for i in self._encode([" ".join(values[i : i + 1000]) for i in range(0, len(values), 1000)])]
        ids = np.concatenate(found)
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) != len(values) or ends[-1] != len(ids):  # a file of another kind: one by one
            each = self._encode(values)
            return np.concatenate([np.array(i, np.uint32) for i in each]), np.array([len(i) for i in each])
        return ids, np.diff(ends, prepend=0)

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of the given units."""
        body = data.tobytes()
        values = [body[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if plain:
            return self._together(values)
        each = self._encode(values)
        return np.concatenate([np.array(i, np.uint32) for i in each]), np.array([len(i) for i in each], np.int64)

    def _units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and plainness of units, and the bytes to hash."""
        starts, ends, _ = T.words(raw, offsets)
        kind = self._PLAIN[raw]
        other = np.concatenate([[0], np.cumsum(kind == 4)])
        whole = other[ends] > other[starts]
        inside = np.zeros(len(raw) + 1, np.int32)
        np.add.at(inside, starts[whole], 1)
        np.add.at(inside, ends[whole], -1)
        kept = np.cumsum(inside[:-1]) > 0
        data = np.where(kept, raw, T.LOWER[raw])
        border = np.zeros(len(raw) + 1, bool)
        border[1:-1] = ~kept[1:] & (kind[1:] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        border[starts] = True
        first = np.flatnonzero(border)
        stop = np.append(first[1:], len(raw))
        word = np.searchsorted(starts, first, side="right") - 1
        return first, np.minimum(stop, ends[word]), ~whole[word], data

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text (null: empty), the end id last."""
        raw, offsets = T.block(column)
        if self._memo.n > MEMO:
            self._memo.clear()
        starts, ends, plain, data = self._units(raw, offsets)
        view, hashes = T.lanes(data), T.word_hashes(data, starts, ends)
        rows = self._memo.find(hashes, view, starts, ends)
        new = self._memo.unknown(hashes, rows, ends - starts)
        for group in (new[plain[new]], new[~plain[new]]):
            if len(group):
                ids, sizes = self._spans(data, starts[group], ends[group], bool(plain[group[0]]))
                self._memo.add(hashes[group], data, starts[group], ends[group])
                self._memo.keep(ids, sizes)
        if len(new):
            rows = self._memo.find(hashes, view, starts, ends)
        ids, begin, sizes = self._memo.ids, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        known, odd = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        begin[known], sizes[known] = self._memo.begin[rows[known]], self._memo.size[rows[known]]
        # Very long units, and those that share a hash with another, are not remembered.
        if len(odd):
            own, sizes[odd] = self._spans(data, starts[odd], ends[odd], False)
            begin[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
            ids = np.concatenate([ids, own])
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, offsets)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.append(flat[a:b], np.uint32(self._end_id))


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def encoder(path: str, end_id: int) -> UnitEncoder:
    """One encoder per worker process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = UnitEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for record files inside the shared folder."""
    base = shared_folder(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/docaudit/records-{uuid.uuid4().hex}"


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode every text (null: empty), write the files and the index, and return the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId()
        files, root = _files(folder)
        temporary, final = f"{root}/data/_{number:06d}-{context.taskAttemptId()}", f"{root}/data/{number:06d}.rec"
        stream, offset, before = None, 0, 0
        for batch in pieces(batches, "text", 1 << 20):
            if stream is None:
                files.create_dir(f"{root}/data", recursive=True)
                stream = files.open_output_stream(temporary)
            ids = batch.column("doc_id").to_pylist()
            sizes, counts = [], []
            for doc_id, tokens in zip(ids, encoder(tokenizer_path, end_id).encode(batch.column("text")), strict=True):
                data = frame(doc_id, before, tokens)
                stream.write(data)
                sizes.append(len(data))
                counts.append(len(tokens))
                before += len(tokens)
            starts = offset + np.concatenate([[0], np.cumsum(sizes)])
            offset = int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), number, np.int32)), pa.array(starts[:-1]), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), batch.column("doc_id")],
                ["file", "offset", "length", "n_tokens", "doc_id"],
            )
        if stream is not None:
            stream.close()
            if files.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
                files.move(temporary, final)
            else:  # an earlier attempt has finished: both hold the same bytes, and readers may have it open
                files.delete_file(temporary)

    dealt = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = dealt.mapInArrow(run, "file int, offset long, length long, n_tokens long, doc_id long")
    index.write.parquet(f"{folder}/index")
    return read_index(docs.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file int, offset long, length long, n_tokens long, doc_id long").parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records named by index rows, in any order: doc_id, file, before, ids. Every checksum is checked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(folder)
        for rows in frames:
            out = []
            for number, own in rows.sort_values(["file", "offset"]).groupby("file"):
                with files.open_input_file(f"{root}/data/{number:06d}.rec") as source:
                    for offset, length in zip(own["offset"], own["length"], strict=True):
                        doc_id, before, ids, _ = unframe(source.read_at(int(length), int(offset)))
                        out.append((doc_id, number, before, ids.astype("<u4").tobytes()))
            frame_ = pd.DataFrame(out, columns=["doc_id", "file", "before", "ids"])
            yield frame_.astype({"doc_id": "Int64"})

    return index.select("file", "offset", "length").mapInPandas(run, "doc_id long, file int, before long, ids binary")


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write, read back, and return one row per row of ``docs``: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it in ascending doc_id order (null ids come first, rows of one doc_id
    are ordered by text); n_tokens holds the end id; ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers. A null or empty text is the end id alone. Other columns are ignored; an empty table writes an
    empty index and gives an empty result.
    """
    folder = folder or new_folder(docs.sparkSession)
    index = write_records(docs, folder, tokenizer_path, end_id)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = store(index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    read = read_records(index, folder).select("doc_id", "file", "before", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return read.join(bases, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

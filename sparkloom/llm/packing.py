"""Bounded-space online packing of token sequences into windows of a fixed length.

Each task keeps at most `spaces` open windows. A document's full windows are cut off first; the rest goes, whole, into
the open window where it fits best. Where none fits, the fullest is topped up with the head of the rest and emitted,
so emitted windows have no padding. What stays open at a task's end is merged in bounded groups of tasks; the last
tokens of a group are laid out as windows of powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, text_chunks
from sparkloom.llm.tokens import WordTokenizer

WINDOW = 2048
SPACES = 32
END_ID = 1
#: So many tasks' open windows are merged by one task.
MERGE_TASKS = 64

_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64())]
_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"

Piece = tuple[object, int, np.ndarray, int]  # the document's id, ids before the piece, the piece's ids, ids of the document


class OpenWindows:
    """Windows that fill up; complete ones gather in done as lists of pieces."""

    def __init__(self, window: int, spaces: int):
        self.window, self.spaces, self.done = window, spaces, []
        self.free: list[tuple[int, int]] = []  # (free tokens, key), sorted
        self.held: dict[int, list[Piece]] = {}
        self.next = 0

    def _put(self, key: int, room: int, piece: Piece) -> None:
        self.held[key].append(piece)
        if room == len(piece[2]):
            self.done.append(self.held.pop(key))
        else:
            insort(self.free, (room - len(piece[2]), key))

    def add(self, doc: object, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.done.append([(doc, at, ids[at : at + self.window], total)])
            at += self.window
        while at < total:
            size = total - at
            i = bisect_left(self.free, (size, -1))
            if i < len(self.free):
                room, key = self.free.pop(i)
            elif len(self.free) < self.spaces:
                room, key = self.window, self.next
                self.held[key] = []
                self.next += 1
            else:
                room, key = self.free.pop(0)  # the fullest
            self._put(key, room, (doc, at, ids[at : at + min(size, room)], total))
            at += min(size, room)


def _batch(pieces: list[tuple[Piece, int, int]], id_col: str, id_type: pa.DataType, with_ids: bool, part: int | None) -> pa.RecordBatch:
    raw = [p[2].astype("<u4").tobytes() for p, _, _ in pieces]
    columns = [
        pa.array([p[0] for p, _, _ in pieces], id_type), pa.array([p[1] for p, _, _ in pieces], pa.int64()), pa.array([len(p[2]) for p, _, _ in pieces], pa.int64()),
        pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([p[3] for p, _, _ in pieces], pa.int64()), pa.array([s for _, s, _ in pieces], pa.int64()), pa.array([o for _, _, o in pieces], pa.int64()),
        pa.array(raw if with_ids or part is not None else [None] * len(raw), pa.binary()), pa.array([part] * len(pieces), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [id_col, *[n for n, _ in _FIELDS]])


def _laid(windows: list[list[Piece]], first: int) -> list[tuple[Piece, int, int]]:
    out = []
    for k, pieces in enumerate(windows):
        at = 0
        for p in pieces:
            out.append((p, first + k, at))
            at += len(p[2])
    return out


def _merged(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """The pieces one after the other in full windows; the tail in windows of falling powers of two."""
    left = sum(len(p[2]) for p in pieces)
    sizes = [window] * (left // window) + [1 << b for b in range(window.bit_length(), -1, -1) if (left % window) >> b & 1]
    out, k, room = [], 0, sizes[0] if sizes else 0
    current: list[Piece] = []
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            take = min(room, len(ids) - at)
            current.append((doc, start + at, ids[at : at + take], total))
            at, room = at + take, room - take
            if not room:
                out.append(current)
                current, k = [], k + 1
                room = sizes[k] if k < len(sizes) else 0
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, spaces: int = SPACES, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset; with_ids adds ids (little-endian uint32).

    A null or empty text is the end id alone. Rows that repeat an id are packed each for itself, so its ids appear once
    per row. Every sequence has `window` tokens or a power of two. An empty table gives an empty result. Other columns
    are ignored.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = WordTokenizer.load(tokenizer_path).encode, TaskContext.get().partitionId()
        open_, count, kind = OpenWindows(window, spaces), 0, None
        for batch in text_chunks(batches, "_text"):
            kind = batch.column(id_col).type
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column("_text").to_pylist(), strict=True):
                open_.add(doc, np.array([*encode(text or ""), end_id], np.uint32))
            yield _batch(_laid(open_.done, (part << 32) + count), id_col, kind, with_ids, None)
            count, open_.done = count + len(open_.done), []
        if kind is not None:
            yield _batch(_laid(list(open_.held.values()), 0), id_col, kind, with_ids, part)

    def second(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        rows = zip(batch.column(id_col).to_pylist(), batch.column("start").to_pylist(), batch.column("ids").to_pylist(), batch.column("doc_tokens").to_pylist(), strict=True)
        pieces = [(d, s, np.frombuffer(x, "<u4"), t) for d, s, x, t in rows]
        made = _batch(_laid(_merged(pieces, window), (1 << 62) + (key[0].as_py() << 32)), id_col, batch.schema.field(id_col).type, with_ids, None)
        return pa.Table.from_batches([made])

    schema = f"`{id_col}` {id_kind}, {_COLUMNS}"
    held = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(first, schema)
    placed = materialize(held)
    merged = placed.where("part is not null").groupBy(F.floor(F.col("part") / MERGE_TASKS).alias("_group")).applyInArrow(second, schema)
    out = placed.where("part is null").unionByName(merged).drop("part")
    return out if with_ids else out.drop("ids")

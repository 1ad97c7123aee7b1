"""Packing by the sum of squares: each document goes where the open windows' fill levels stay most even."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .pretokens import SpacedIds

VOCABULARY = "byte_bpe_50k.json"
END = (1).to_bytes(4, "little")
#: Windows that a task holds open, with the ids of their pieces: 4,096 of them are 32 MB of ids at most.
MOST_OPEN = 4096
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NONE = np.iinfo(np.int64).max


class Piece(NamedTuple):
    """A run of a document's tokens, as little-endian 32-bit ids."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * at]), self._replace(start=self.start + at, ids=self.ids[4 * at :])


class Windows:
    """The open windows by fill level, and the level array: how many there are of each."""

    def __init__(self, capacity: int, most_open: int = MOST_OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.closed: list[list[Piece]] = []
        self.open = 0

    def level(self, size: int) -> int:
        """The fill level to add `size` tokens to (0: a new window) so that the sum of squared counts over the partially filled
        levels grows least. A full window is counted nowhere. Ties fall to the fullest."""
        now, then = self.counts[: self.capacity + 1 - size], self.counts[size:]
        change = 2 * (then - now) + 2
        change[-1] -= 1
        change[now == 0] = NONE
        change[0] = 2 * then[0] + 1
        return len(change) - 1 - int(change[::-1].argmin())

    def place(self, piece: Piece) -> None:
        size = piece.length
        if size == self.capacity:
            self.closed.append([piece])
            return
        at = self.level(size)
        window = []
        if at:
            window = self.levels[at].pop()
            self.counts[at] -= 1
            self.open -= 1
        window.append(piece)
        if at + size == self.capacity:
            self.closed.append(window)
            return
        self._keep(window, at + size)
        if self.open > self.most_open:
            self.top_up(self.most_open // 2)

    def _keep(self, window: list[Piece], fill: int) -> None:
        self.levels[fill].append(window)
        self.counts[fill] += 1
        self.open += 1

    def top_up(self, most: int) -> None:
        """Fill the fullest windows with what the emptiest hold, cutting a piece where it must be, until `most` are open."""
        windows = [(fill, w) for fill in range(self.capacity - 1, 0, -1) for w in self.levels[fill]]
        for level in self.levels:
            level.clear()
        self.counts[:] = 0
        self.open = 0
        first, last = 0, len(windows) - 1
        while last - first + 1 > most and first < last:
            fill, window = windows[first]
            while fill < self.capacity and first < last:
                left, donor = windows[last]
                piece = donor.pop()
                if piece.length > self.capacity - fill:
                    piece, rest = piece.cut(self.capacity - fill)
                    donor.append(rest)
                window.append(piece)
                fill += piece.length
                windows[last] = left - piece.length, donor
                last -= not donor
            windows[first] = fill, window
            if fill == self.capacity:
                self.closed.append(window)
                first += 1
        for fill, window in windows[first : last + 1]:
            self._keep(window, fill)

    def finish(self) -> None:
        """Close all windows. The one that stays partially filled is cut at powers of two, which need no padding."""
        self.top_up(1)
        if self.open:
            fill = int(self.counts.argmax())
            window = self.levels[fill].pop()[::-1]
            while fill:
                room = 1 << fill.bit_length() - 1
                fill -= room
                sequence: list[Piece] = []
                while room:
                    piece = window.pop()
                    if piece.length > room:
                        piece, rest = piece.cut(room)
                        window.append(rest)
                    sequence.append(piece)
                    room -= piece.length
                self.closed.append(sequence)
        self.counts[:] = 0
        self.open = 0


def _rows(windows: Windows, sequence: int, keep_ids: bool) -> pa.RecordBatch:
    """The pieces of the closed windows, which are numbered from `sequence`."""
    columns: list[list] = [[] for _ in range(8)]
    for k, window in enumerate(windows.closed, sequence):
        offset = 0
        for piece in window:
            for column, value in zip(columns, (piece.doc_id, piece.start, piece.length, zlib.crc32(piece.ids), piece.doc_tokens, k, offset, piece.ids), strict=True):
                column.append(value)
            offset += piece.length
    windows.closed.clear()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kept = 8 if keep_ids else 7
    return pa.record_batch([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns[:kept], names, strict=False)], names[:kept])


def _stream(batches: Iterator[pa.RecordBatch], capacity: int, name: str, most_open: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    words, windows, sequence = SpacedIds(name), Windows(capacity, most_open), TaskContext.get().partitionId() << 32
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = words.ids(text or "") + END
            whole = len(ids) // 4
            for at in range(0, whole, capacity):
                windows.place(Piece(doc, at, ids[4 * at : 4 * (at + capacity)], whole))
            if len(windows.closed) >= 1024:
                count = len(windows.closed)
                yield _rows(windows, sequence, keep_ids)
                sequence += count
    windows.finish()
    yield _rows(windows, sequence, keep_ids)


def pack_stream(docs: DataFrame, capacity: int = 2048, name: str = VOCABULARY, most_open: int = MOST_OPEN, keep_ids: bool = False) -> DataFrame:
    """Token ids of every whole text, then id 1, placed in sequences of at most `capacity` tokens, a document at a time.

    Each task is a stream of its own over its part of the table. Documents longer than a window give full windows first; what is
    left of them, and every other document, goes whole to the fill level that `Windows.level` names. Windows that no document
    comes to fit are topped up with cut pieces once more than `most_open` are open, and at the stream's end; its last window is
    cut at powers of two. So no sequence is padded, a task holds a bounded number of windows, and nothing is shuffled or
    sent to the driver; a task that is run again gives the same rows, for a stream depends on its own rows and their order alone.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (unique to the task), offset, and on request the ids as
    little-endian 32-bit bytes. A null or empty text is the one token 1; a null doc_id is kept; repeated rows are packed as often as
    they occur; an empty table gives none. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _stream(it, capacity, name, most_open, keep_ids), PLACED + (", ids binary" if keep_ids else ""))

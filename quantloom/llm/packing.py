"""Best-fit packing by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pretokens import SpacedIds
from .ranks import rank_in_group
from .shared import stash

VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, name: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    words, most = SpacedIds(name), 4 * capacity
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = words.ids(text or "") + b"\0\0\0\0"
            first = len(ids) % most or most
            at = 0
            for k, end in enumerate(range(first, len(ids) + 1, most)):
                part = ids[at:end]
                for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                    column.append(value)
                at = end
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        yield pa.record_batch(columns if keep_ids else columns[:-1], names if keep_ids else names[:-1])


def token_pieces(docs: DataFrame, capacity: int = 2048, name: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Each document's token ids, then id 0, as pieces of at most `capacity` ids; of a longer document only the first piece may
    be shorter. Columns: doc_id, piece, start, length, ids_crc32, and on request the ids as little-endian 32-bit bytes.

    A null or empty text is the single id 0. A null doc_id is kept. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _pieces(it, capacity, name, keep_ids), PIECES + (", ids binary" if keep_ids else ""))


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the lengths available, so many of each as fill a bin that holds the longest one as full as can be.

    Bit s of `reach` is set when some combination of the lengths seen so far sums to s; halves of a count are tried as
    powers of two. The states before each step tell, backwards, which steps the best sum took.
    """
    longest = max(counts)
    room = capacity - longest
    used, reach, steps, whole = {longest: 1}, 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        lot = 1
        while left > 0 and not reach >> room & 1:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= reach << length * lot & whole
            left -= lot
            lot *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    for length, lot, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + lot
            best -= length * lot
    return used


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack: the fullest combination is removed, as often as the counts allow, until nothing is left.

    Each entry is a bin's content (length to number) and the number of such bins.
    """
    counts, plan = dict(counts), []
    while counts:
        used = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in used.items())
        plan.append((used, times))
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return plan


def _places(batches: Iterator[pa.RecordBatch], keys: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
        row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
        slot = rank - row[:, 0]
        columns = [*batch.columns[:-1], pa.array(row[:, 2] + slot // row[:, 1]), pa.array(row[:, 3] + slot % row[:, 1] * length)]
        yield pa.record_batch(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece (doc_id, piece, length and any further columns) its sequence_id and offset.

    The plan needs only how many pieces there are of each length, at most `capacity` numbers; the driver makes it. A
    piece's rank among those of its length then finds its bin. Equal lengths of any number are ranked in small buckets.
    No sequence holds more than `capacity` tokens or a gap. Further columns may have any names; columns sequence_id and offset
    are replaced. A null doc_id is kept, repeated pieces each have a place, and an empty table gives none.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    used: dict[int, int] = {}
    table, sequence = [], 0
    for content, times in slack_plan(counts, capacity):
        offset = 0
        for length, k in sorted(content.items(), reverse=True):
            table.append((length, used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * times
            offset += length * k
        sequence += times
    table.sort()
    found = np.array(table or [(0, 0, 1, 0, 0)], np.int64)
    keys, places = found[:, 0] << 44 | found[:, 1], found[:, 1:]
    whole = pieces.drop("sequence_id", "offset")
    ordered = whole.select(F.struct("*").alias("row"), "length", F.xxhash64("doc_id", "piece", "start").alias("order"), "doc_id", "piece", "ids_crc32")
    ranked = rank_in_group(ordered, "length", "order", ["doc_id", "piece", "ids_crc32"], rows).select("row.*", F.col("rank").alias(f"rank_{uuid.uuid4().hex}"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    return ranked.mapInArrow(lambda it: _places(it, keys, places), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, name: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, cut the longer ones, and pack all pieces into as few sequences as the method finds."""
    return pack(stash(token_pieces(docs, capacity, name, keep_ids)), capacity)

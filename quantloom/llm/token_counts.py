"""Token counts from pre-token frequencies: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .pretokens import byte_characters, tokenizer, words_of

VOCABULARY = "word_bpe_49k.json"
#: Documents of a block: what one group of the last step holds. A place in a block fits 16 bits.
BLOCK = 1024
PACKED = "block long, bucket int, doc_ids array<long>, n_bytes array<long>, known array<long>, words binary, holders binary, places binary, times binary, sums binary"


@functools.cache
def single_pieces(name: str) -> frozenset[str]:
    """Words of the vocabulary file that are one piece: at most as many as the file has entries."""
    t = tokenizer(name)
    byte = {c: b for b, c in enumerate(byte_characters())}
    words = []
    for piece in t.get_vocab():
        if piece.endswith("</w>"):
            raw = bytes(byte[c] for c in piece[:-4])
            try:
                words.append(raw.decode())
            except UnicodeDecodeError:
                continue
    words = [w for w in words if words_of(w, name) == [w]]
    return frozenset(w for w, e in zip(words, t.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Places(dict):
    """Each new word gets the next number."""

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out


#: Columns of what one block sends: its documents, or the frequencies of its words of one bucket, or sums for its documents.
COLUMNS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((n, pa.list_(pa.int64())) for n in ("doc_ids", "n_bytes", "known")), *((n, pa.binary()) for n in ("words", "holders", "places", "times", "sums"))])


def _packed(**columns: list) -> pa.RecordBatch:
    rows = len(columns["block"])
    return pa.record_batch([pa.array(columns.get(f.name, [None] * rows), f.type) for f in COLUMNS], schema=COLUMNS)


def _frequencies(batches: Iterator[pa.RecordBatch], name: str, buckets: int) -> Iterator[pa.RecordBatch]:
    single, block = single_pieces(name), TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            sizes, known, held, words, times = [], [], [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                counts = Counter(words_of(text, name))
                own = [w for w in counts if w not in single]
                k = [counts[w] for w in own]
                sizes.append(len(text.encode()))
                known.append(counts.total() - sum(k))
                held.append(len(own))
                words += own
                times += k
            yield _packed(block=[block], bucket=[block % buckets], doc_ids=[part.column(0).to_pylist()], n_bytes=[sizes], known=[known])
            numbers = Places()
            word = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            place, times = np.repeat(np.arange(len(held)), held), np.array(times, np.uint32)
            names = np.array([*numbers, None], object)[:-1]
            bucket = np.array([xxhash.xxh32_intdigest(w) % buckets for w in names], np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            new = np.empty_like(by_bucket)
            new[by_bucket] = np.arange(len(by_bucket))
            order = np.argsort(new[word], kind="stable")
            holders, place, times = np.bincount(word, minlength=len(names))[by_bucket], place[order], times[order]
            cuts, ends = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1)), np.concatenate(([0], np.cumsum(holders)))
            full = [(b, i, j) for b, (i, j) in enumerate(pairwise(cuts.tolist())) if i < j]
            yield _packed(
                block=[block] * len(full),
                bucket=[b for b, _, _ in full],
                words=["\n".join(names[by_bucket[i:j]]).encode() for _, i, j in full],
                holders=[holders[i:j].astype(np.uint16).tobytes() for _, i, j in full],
                places=[place[ends[i] : ends[j]].astype(np.uint16).tobytes() for _, i, j in full],
                times=[times[ends[i] : ends[j]].tobytes() for _, i, j in full],
            )
            block += 1


class Pieces(dict):
    """Pre-token to its number of pieces, counted when it is first met; a task that meets more than MOST starts anew."""

    MOST = 2_000_000

    def __init__(self, name: str):
        t = tokenizer(name)
        self.model, self.characters = t.model, byte_characters()
        self.special = {a.content for a in t.get_added_tokens_decoder().values()}

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        out = self[word] = 1 if word in self.special else len(self.model.tokenize(word.encode().decode("latin-1").translate(self.characters)))
        return out


def _counted(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Replace words and frequencies by what they add to each document of their block."""
    pieces = Pieces(name)
    for batch in batches:
        sums = []
        for words, *packed in zip(*(batch.column(n).to_pylist() for n in ("words", "holders", "places", "times")), strict=True):
            if words is None:
                sums.append(None)
                continue
            words = words.decode().split("\n")
            each = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))
            holders, places, times = (np.frombuffer(x, t) for x, t in zip(packed, (np.uint16, np.uint16, np.uint32), strict=True))
            sums.append(np.bincount(places, times * np.repeat(each, holders), BLOCK).astype(np.int64).tobytes())
        none = pa.nulls(batch.num_rows, pa.binary())
        yield pa.record_batch([none if f.name in ("words", "holders", "places", "times") else pa.array(sums, pa.binary()) if f.name == "sums" else batch.column(f.name) for f in COLUMNS], schema=COLUMNS)


def _sums(rows: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for s in rows["sums"].drop_null().to_pylist():
        total += np.frombuffer(s, np.int64)
    docs = next(r for r in rows.select(["doc_ids", "n_bytes", "known"]).to_pylist() if r["doc_ids"] is not None)
    n = np.array(docs["known"], np.int64)
    return pa.table({"doc_id": pa.array(docs["doc_ids"], pa.int64()), "n_bytes": pa.array(docs["n_bytes"], pa.int64()), "n_tokens": pa.array(n + total[: len(n)], pa.int64())})


def count_tokens(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text, as the library of the vocabulary gives them.

    Blocks of documents give, for each of their distinct pre-tokens, the documents that hold it and how often. Pre-tokens
    that the vocabulary file has whole count one piece; the file bounds their number. All others go, packed by the bucket of
    their hash, to that bucket's task, where each distinct pre-token's pieces are counted once and joined to the blocks'
    frequencies; what they add to a document goes back to its block and is summed. A word that every document holds is
    one entry a block, so no bucket is larger for it; no ids are kept.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id is kept; repeated rows are counted each. An empty table
    gives none. Other columns, whatever their names, are not read.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = rows.mapInArrow(lambda it: _frequencies(it, name, 4 * tasks), PACKED)
    counted = packed.repartition(tasks, "bucket").mapInArrow(lambda it: _counted(it, name), PACKED).select("block", "doc_ids", "n_bytes", "known", "sums")
    return counted.groupBy("block").applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")

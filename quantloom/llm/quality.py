"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Labelled rows of each class that the model is fitted on, at most; which ones, a hash of doc_id decides.
SAMPLE_PER_CLASS = 1000
EPOCHS, BATCH, RATE = 8, 32, 2.0
#: Texts whose new words are looked up together.
TOGETHER = 256
#: What stands for a word that repeats the one before it.
AGAIN = "⟲"
MULTIPLIER, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    words = text.split()
    return [AGAIN if w == before else w for w, before in zip(words, [None, *words], strict=False)]


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words, and for each the place of its word.

    A word's features are itself and the character n-grams of it between < and >. An n-gram's hash is a polynomial in its
    characters; all of them come from shifted sums over the words' characters at once.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    found, place = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], np.int64)], [np.arange(len(words))]
    total = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        total = total * MULTIPLIER
        total[: len(codes) - n + 1] += codes[n - 1 :]
        if n in GRAMS:
            whole = left >= n
            mixed = total[whole] * MIX + np.uint64(n)
            found.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            place.append(of[whole])
    return np.concatenate(found), np.concatenate(place)


@dataclass
class Model:
    """The class margin of each bucket's vector, folded from embeddings and output layer; averages of it score a text."""

    margin: np.ndarray
    bias: float


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Bucket vectors and a two-class softmax, by mini-batch gradient descent; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    ids, weights = [], []
    for text in texts:
        counts = Counter(words_of(text))
        own, place = hashed(list(counts))
        times = np.fromiter(counts.values(), np.float32, len(counts))[place]
        own, place = np.unique(own, return_inverse=True)
        times = np.bincount(place, times, len(own))
        ids.append(own)
        weights.append(times / max(1, times.sum()))
    y = np.array(labels, np.int64)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    weight = 0.5 / np.maximum(share, 1e-9)
    for epoch in range(EPOCHS if len(y) else 0):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            row = np.repeat(np.arange(len(docs)), [len(ids[d]) for d in docs])
            flat, w = np.concatenate([ids[d] for d in docs]), np.concatenate([weights[d] for d in docs])
            hidden = np.stack([np.bincount(row, w * vectors[flat, j], len(docs)) for j in range(DIMENSIONS)], 1)
            z = hidden @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            p *= weight[y[docs]][:, None]
            back = p @ out
            out -= rate / len(docs) * p.T @ hidden
            bias -= (0.1 * rate / len(docs) * p.sum(0)).astype(np.float32)
            used, place = np.unique(flat, return_inverse=True)
            for j in range(DIMENSIONS):
                vectors[used, j] -= rate * np.bincount(place, w * back[row, j], len(used)).astype(np.float32) * 4
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


class Margins(dict):
    """Word to (sum of its buckets' margins, number of its buckets)."""

    def __init__(self, model: Model, most: int = 300_000):
        self.most, self.bias, self.margin = most, model.bias, model.margin

    def learn(self, words: list[str]) -> None:
        ids, place = hashed(words)
        sums, numbers = np.bincount(place, self.margin[ids], len(words)), np.bincount(place, minlength=len(words))
        self.update(zip(words, zip(sums.tolist(), numbers.tolist(), strict=True), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        counted = [Counter(words_of(t)) for t in texts]
        if len(self) > self.most:
            self.clear()
        if new := [w for w in set().union(*counted) if w not in self]:
            self.learn(new)
        out = []
        for counts in counted:
            total, n = 0.0, 0
            for w, k in counts.items():
                s, c = self[w]
                total += k * s
                n += k * c
            z = total / max(1, n) + self.bias
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most `per_class` labelled rows of each quality that are not held out: a bounded, hash-chosen sample.

    Of rows that share a doc_id the smallest text counts, once, so that repeated ids add nothing. Labels that are null or
    neither 0 nor 1 take no part; a doc_id labelled both ways counts for both.
    """
    named = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).dropDuplicates()
    picked = None
    for quality in (0, 1):
        part = named.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(picked), "doc_id").collect()
    rows = sorted(((r["doc_id"], r["text"] or "", r["quality"]) for r in rows))
    return train([t for _, t, _ in rows], [q for _, _, q in rows])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    margins = Margins(model.value)
    for batch in batches:
        scores = []
        for at in range(0, batch.num_rows, TOGETHER):
            scores += margins.scores([t or "" for t in batch.column("text").slice(at, TOGETHER).to_pylist()])
        names = [n for n in batch.schema.names if n != "score"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `score`, the probability of label 1, from the whole text alone.

    A null or empty text has no features and scores the bias. Null ids, repeated rows and further columns stay as they are; a
    column called score is replaced. An empty table gives none. Without labels every score is one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score")
    return docs.mapInArrow(lambda it: _scored(it, shared), f"{kinds}, score double")

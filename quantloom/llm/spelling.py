"""Spelling variants of a corpus's words: pairs one edit apart by letter-parity masks, and each word's commoner form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import drop, stash

#: Fixed value: the letters by how common they are, so that each band gets common and rare ones.
BY_FREQUENCY = "etaoinshrdlucmfwypvbgkjqxz"
BITS = 63
#: Distinct words that a task counts before it sends them on.
MOST_COUNTED = 500_000
#: Words of a band's group that meet in one task.
MOST = 4096
KEY = ["band", "value", "cell", "sub", "sub_value", "low", "high"]


def _bit(letter: str) -> int:
    """The letter's place in a mask. Letters beyond a to z share places; an edit still flips two bits at most."""
    at = BY_FREQUENCY.find(letter)
    return at if at >= 0 else len(BY_FREQUENCY) + ord(letter) % (BITS - len(BY_FREQUENCY))


LETTERS = {chr(c): 1 << _bit(chr(c)) for c in (*range(97, 123), *range(0xC0, 0x100))}


def _dealt(bits: list[int]) -> list[int]:
    return [sum(1 << b for b in bits[k::3]) for k in range(3)]


#: The three bands of a mask, and for each the three bands of the other bits.
BANDS = _dealt(list(range(BITS)))
SUBS = [_dealt([b for b in range(BITS) if not band >> b & 1]) for band in BANDS]


def parity_mask(word: str) -> int:
    """Bit by bit whether the word has an odd number of the letters there. One edit flips two bits at most."""
    mask = 0
    for letter in word:
        mask ^= LETTERS[letter]
    return mask


def _counted(batches: Iterator[pa.RecordBatch], least_length: int, misspell: int | None) -> Iterator[pa.RecordBatch]:
    runs, counts = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}").findall, Counter()

    def rows() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(runs((text or "").encode().lower().decode()))
            if misspell is None:
                counts.update(found)
                continue
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, k in found.items():
                h = zlib.crc32(run.encode(), seed)
                if h % misspell == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += k
        if len(counts) > MOST_COUNTED:
            yield rows()
    yield rows()


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, misspell: int | None = None) -> DataFrame:
    """(word, n): the maximal runs of Latin letters of at least `least_length` code points, A to Z lower-cased, with at least
    `least_count` occurrences in all whole texts.

    With `misspell`, a run whose checksum with its doc_id that number divides loses a letter first: errors to measure the
    grouping by. A null doc_id counts as none there. Null and empty texts have no words; repeated rows count each; an empty
    table gives none. Words are counted in the tasks that read them before they are shuffled. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    counted = rows.mapInArrow(lambda it: _counted(it, least_length, misspell), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = pa.array(map(parity_mask, batch.column("word").to_pylist()), pa.int64())
        yield pa.record_batch([batch.column("word"), batch.column("n"), masks], ["word", "n", "mask"])


def _slices(a: np.ndarray, b: np.ndarray, mask: np.ndarray, flips: int, apart: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a times b, a slice of a at a time, the pairs of which at most `flips` bits differ and whose bands `apart` all do."""
    for at in range(0, len(a), step := max(1, (1 << 18) // max(1, len(b)))):
        part = a[at : at + step]
        x = mask[part][:, None] ^ mask[b][None, :]
        keep = np.bitwise_count(x) <= flips
        if a is b:
            keep &= part[:, None] < b[None, :]
        for band in apart:
            keep &= (x & band) != 0
        i, j = np.nonzero(keep)
        if len(i):
            yield part[i], b[j]


def _letters(words: list[bytes], rows: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), length)


def _one_edit(words: list[bytes], i: np.ndarray, j: np.ndarray, cell: int, longer: bool) -> np.ndarray:
    """Which of the pairs (i has `cell` letters, j as many or one more) are one edit apart."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), step := max(1, (1 << 22) // cell)):
        a, b = _letters(words, i[at : at + step], cell), _letters(words, j[at : at + step], cell + longer)
        if longer:
            head = np.minimum.accumulate(a == b[:, :-1], axis=1).sum(1)
            tail = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
            out[at : at + step] = head + tail >= cell
        else:
            out[at : at + step] = (a != b).sum(1) == 1
    return out


def _near(rows: pa.Table) -> pa.Table:
    """Of one bucket of groups, the pairs of each group that are one edit apart, both ways round."""
    rows = rows.sort_by([(k, "ascending") for k in KEY])
    keys = [rows[k].to_numpy() for k in KEY]
    new = np.zeros(rows.num_rows, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    cuts = [0, *np.nonzero(new)[0].tolist(), rows.num_rows]
    strings, n, mask, own = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["mask"].to_numpy(), rows["own"].to_numpy()
    words = [w.encode("latin-1") for w in strings]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    left, right = [], []
    for start, end in pairwise(cuts):
        if end - start < 2:
            continue
        band, _, cell, sub, _, low, high = (int(k[start]) for k in keys)
        apart = BANDS[:band] + (SUBS[band][:sub] if sub >= 0 else [])
        here = np.arange(start, end)
        same, more = here[sizes[start:end] == cell], here[sizes[start:end] > cell]
        if low == high:
            meetings = [(same, same, 2), (same, more, 1)]
        else:
            a, b, c, d = same[own[same] == low], same[own[same] == high], more[own[more] == low], more[own[more] == high]
            meetings = [(a, b, 2), (a, d, 1), (b, c, 1)]
        for a, b, flips in meetings:
            for i, j in _slices(a, b, mask, flips, apart):
                ok = _one_edit(words, i, j, cell, flips == 1)
                left.append(i[ok])
                right.append(j[ok])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    at, to = np.concatenate([i, j]), np.concatenate([j, i])
    string = rows["word"].combine_chunks()
    return pa.table({"word": string.take(pa.array(at)), "near": string.take(pa.array(to)), "near_n": pa.array(n[to])})


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n): every two of the distinct words that are one inserted, deleted or replaced letter apart, both ways.

    An edit flips at most two bits of a parity mask, so at least one of its three bands is equal. Words of equal length meet by
    (band, its bits, length); words one letter shorter join the group of the longer. The first equal band alone reports a
    pair. The other bits of a group of more than `most` words differ by two at most as well: they are split into three bands again,
    and what is still larger is met a pair of chunks at a time, so that no group fills a task.
    """
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masked = stash(words.select("word", "n").mapInArrow(_masked, "word string, n long, mask long"))
    long = lambda x: F.lit(x).cast("long")
    keys = [
        F.struct(F.lit(k).alias("band"), F.col("mask").bitwiseAND(long(bits)).alias("value"), (F.length("word") - shorter).alias("cell"))
        for k, bits in enumerate(BANDS)
        for shorter in (0, 1)
    ]
    rows = masked.withColumn("key", F.explode(F.array(*keys))).select("word", "n", "mask", "key.*")
    crowds = rows.groupBy("band", "value", "cell").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most)
    met = rows.join(crowds, ["band", "value", "cell"], "left")
    subs = F.array(*[F.struct(F.lit(s).alias("sub"), F.element_at(F.array(*[F.col("mask").bitwiseAND(long(SUBS[k][s])) for k in range(3)]), F.col("band") + 1).alias("sub_value")) for s in range(3)])
    whole = F.array(F.struct(F.lit(-1).alias("sub"), long(0).alias("sub_value")))
    met = met.withColumn("key", F.explode(F.when(F.col("members").isNull(), whole).otherwise(subs))).select("word", "n", "mask", "band", "value", "cell", "key.*")
    group = ["band", "value", "cell", "sub", "sub_value"]
    crowds = met.where("sub >= 0").groupBy(*group).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most)
    chunks = F.coalesce(F.ceil(F.col("members") / most), F.lit(1))
    met = met.join(crowds, group, "left").withColumn("chunks", chunks.cast("int")).withColumn("own", F.pmod(F.xxhash64("word"), "chunks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    buckets = max(4 * tasks, masked.count() * 6 // 65536)
    dealt = met.select("word", "n", "mask", *KEY, "own", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(_near, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = 5, most: int = MOST) -> DataFrame:
    """For each distinct word (word, n) its near words' number, its form and its root.

    The form is the near word of largest n (ties: smallest in code-point order) where that is at least `times` the word's own n,
    else null; form_n is its n. The root is the last form on the way from word to form, the word itself where it has none. Forms
    grow by a factor, so the ways are short: pointer doubling ends after a logarithm of their length. A word must consist of
    the letters a to z and those from U+00C0 to U+00FF; null words and those with a null n are left out; an empty table gives none.
    """
    words = stash(words.where("word is not null and n is not null").select("word", F.col("n").cast("long")))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form")))
    near = near_pairs(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = -F.col("best.order") >= times * F.col("n")
    found = stash(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.order")).alias("form_n")
        )
    )
    jumps = stash(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = stash(jumps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop(jumps)
        moved = not doubled.where("moved").isEmpty()
        jumps = doubled
        if not moved:
            break
    return found.join(jumps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Suffix-array deduplication: bytes of strings that start in an earlier document go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .induced import U, permuted_common_prefixes, suffix_array

#: Strings of LENGTH bytes are compared. Each has one anchor: the GRAM-byte string in it whose hash is least, the last of ties.
LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1


@dataclass(frozen=True)
class Sizes:
    """None of them changes a result. Documents of a block, and its bytes if it holds more than one; bytes of snippets in one
    suffix array, about; entries beyond which an anchor's strings are dealt out one by one; bytes of texts for each task, about."""

    block: int = 1024
    block_bytes: int = 4 << 20
    shard_bytes: int = 4 << 20
    hot: int = 4096
    task_bytes: int = 24 << 20


TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * TURNS[3]
    return x ^ (x >> U(29))


BYTE = mixed(np.arange(1, 257, dtype=U) * TURNS[0])


def _joined(h: np.ndarray, g: np.ndarray, by: int) -> np.ndarray:
    """Hash of two neighbouring strings, the second `by` bytes after the first, at every place."""
    out = h * TURNS[2]
    out[: len(out) - by] += g[by:]
    return out ^ (out >> U(31))


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place on."""
    eight = BYTE[buf]
    for by in (1, 2, 4):
        eight = _joined(eight, eight, by)
    return mixed(_joined(_joined(eight, eight, 8), eight, 16) * TURNS[1])


def string_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from every place on: three overlapping grams."""
    h = gram_hashes(buf)
    return mixed(_joined(_joined(h, h, GRAM), h, LENGTH - GRAM) * TURNS[0])


def anchors(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts joined in `buf`: of each anchor its hash, its text, the first string (its start) it is the anchor of, and
    how many strings from there it is. Every string of LENGTH bytes within a text belongs to one anchor."""
    ends = np.cumsum(lengths)
    start = np.flatnonzero(np.arange(len(buf)) + LENGTH <= np.repeat(ends, lengths))
    if not len(start):
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    least, span = gram_hashes(buf), 1
    while 2 * span <= WINDOW:
        least = np.append(np.minimum(least[:-span], least[span:]), least[-span:])
        span *= 2
    rest = WINDOW - span
    if rest and len(least) > rest:
        least = np.append(np.minimum(least[:-rest], least[rest:]), least[-rest:])
    starts = np.repeat(ends - lengths, lengths)
    value, text_start = least[start], starts[start]
    new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (text_start[1:] != text_start[:-1]))))
    count = np.diff(np.append(new, len(start)))
    # one hash value may be met again beyond a window's reach: such a run is cut so that its strings hold one anchor each
    long = count > WINDOW
    if long.any():
        pieces = [np.arange(a, a + n, WINDOW) if n > WINDOW else np.array([a]) for a, n in zip(new.tolist(), count.tolist(), strict=True)]
        new = np.concatenate(pieces)
        count = np.diff(np.append(new, len(start)))
    text = np.repeat(np.arange(len(lengths)), lengths)[start[new]]
    return value[new], text, start[new] - (ends - lengths)[text], count


# --- packed rows -----------------------------------------------------------------------------------------------------

#: A block's documents (ids and text hashes), or its entries of one bucket; an entry has a place (document) and further numbers.
FIELDS = {"place": np.uint16, "lo": np.uint32, "n": np.uint8, "key": np.uint64, "hot": np.uint8, "hi": np.uint32, "doc": np.int64, "many": np.uint32, "kept": np.uint64}
COLUMNS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), *((f, pa.binary()) for f in FIELDS), ("snippets", pa.binary())])
PACKED = "block long, bucket int, ids array<long>, ths array<long>, place binary, lo binary, n binary, key binary, hot binary, hi binary, doc binary, many binary, kept binary, snippets binary"


def _packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in COLUMNS], schema=COLUMNS)


#: Numbers that rise within a row: their differences are kept.
RISING = (np.uint16, np.int64)


def _planes(x: np.ndarray, kind: type) -> bytes:
    """The numbers' lowest bytes, then the next, and so on, compressed."""
    x = x.astype(kind)
    if kind in RISING:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if kind in RISING else x


def _entries(block: int, bucket: np.ndarray, buckets: int, **numbers: np.ndarray) -> list[dict]:
    """Entries, sorted by bucket already, as a row for each bucket."""
    cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    return [{"block": block, "bucket": b, **{f: _planes(x[i:j], FIELDS[f]) for f, x in numbers.items()}} for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]


def _blocks(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """Number, rows and texts' bytes of each block: of sizes.block documents at most, and of sizes.block_bytes if of more than one."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        lengths, at = pc.binary_length(batch.column("text").cast(pa.binary())).to_numpy(), 0
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            most = ends[at] - lengths[at] + sizes.block_bytes
            end = min(at + sizes.block, max(at + 1, int(np.searchsorted(ends, most, side="right"))))
            part = batch.slice(at, end - at)
            yield block, part, part.column("text").cast(pa.binary()).to_pylist()
            block, at = block + 1, end


def _key(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash, and the hash as its key, buckets first."""
    bucket = ((h & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64)
    return bucket, (bucket.astype(U) << U(32)) | (h >> U(32))


def _anchored(batches: Iterator[pa.RecordBatch], buckets: int, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Each block's entries: what anchors its documents have and where.

    Of an anchor that several documents of the block hold, one entry goes to the anchor's bucket and says how many there are; the
    others are kept for the block. So a bucket gets no more entries of a hot anchor than there are blocks.
    """
    for block, part, texts in _blocks(batches, sizes):
        lengths = np.array([len(t) for t in texts], np.int64)
        h, place, lo, n = anchors(np.frombuffer(b"".join(texts), np.uint8), lengths)
        bucket, key = _key(h, buckets)
        order = np.argsort(key, kind="stable")  # places rise already
        k, p = key[order], place[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
        held = np.diff(np.append(starts, len(k)))
        shared = p[starts] != p[starts + held - 1]
        many, stays = np.ones(len(k), np.int64), np.zeros(len(k), bool)
        many[order[starts[shared]]] = held[shared]
        stays[order] = np.repeat(shared, held)
        stays[order[starts]] = False
        rows = [{"block": block, "bucket": block % buckets, "ids": part.column("doc_id").to_pylist(), "ths": part.column("th").to_pylist()}]
        if stays.any():
            rows.append({"block": block, "bucket": block % buckets, **{f: _planes(x[stays], FIELDS[f]) for f, x in (("place", place), ("lo", lo), ("n", n), ("kept", key))}})
        going = np.flatnonzero(~stays)
        going = going[np.argsort(bucket[going], kind="stable")]
        yield _packed(rows + _entries(block, bucket[going], buckets, place=place[going], lo=lo[going], n=n[going], key=key[going], many=many[going]))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], dict[int, list[dict]]]]:
    """A task's rows: those of documents, those kept for their block and those settled already, and the others by bucket."""
    documents, buckets = [], {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] is None:
                documents.append(r)
            else:
                buckets.setdefault(r["bucket"], []).append(r)
    yield documents, buckets


def _gathered(rows: list[dict], *fields: str) -> tuple[np.ndarray, ...]:
    """Of a bucket's rows the entries' row numbers and the fields."""
    parts = [[_numbers(r[f], FIELDS[f]) for r in rows] for f in fields]
    of = np.repeat(np.arange(len(rows)), [len(x) for x in parts[0]])
    return of, *(np.concatenate(p) for p in parts)


def _split(rows: list[dict], of: np.ndarray, **numbers: np.ndarray) -> list[dict]:
    """The entries (ordered by row) given back to their blocks."""
    cuts = np.searchsorted(of, np.arange(len(rows) + 1)).tolist()
    return [{"block": rows[k]["block"], **{f: _planes(x[i:j], FIELDS[f]) for f, x in numbers.items()}} for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]


def _repeated(batches: Iterator[pa.RecordBatch], limits: Sizes) -> Iterator[pa.RecordBatch]:
    """The anchors that more than one document holds."""
    for documents, buckets in _by_bucket(batches):
        yield _packed(documents)
        for rows in buckets.values():
            of, place, lo, n, key, many = _gathered(rows, "place", "lo", "n", "key", "many")
            doc = of.astype(np.int64) << 16 | place
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(starts, len(k)))
            whole = np.add.reduceat(many[order].astype(np.int64), starts)
            several = np.repeat((d[starts] != d[starts + sizes - 1]) | (whole > sizes), sizes)
            hot = np.zeros(len(k), np.uint8)
            hot[order] = np.repeat(whole > limits.hot, sizes)
            keep = np.sort(order[several])
            yield _packed(_split(rows, of[keep], place=place[keep], lo=lo[keep], n=n[keep], key=key[keep], hot=hot[keep]))


def _to_documents(rows: pa.Table, fields: tuple[str, ...]) -> pa.Table:
    """A block's entries by document; those that were kept for it are as hot as the one of their anchor that was sent."""
    rows = rows.to_pylist()
    documents = next(r for r in rows if r["ids"] is not None)
    kept = [r for r in rows if r["kept"] is not None]
    entries = [r for r in rows if r["ids"] is None and r["kept"] is None]
    out: dict[str, list] = {f: [] for f in ("id", "th", *fields)}
    if entries:
        _, place, *numbers = _gathered(entries, "place", *fields)
        if kept:
            _, at, lo, n, key = _gathered(kept, "place", "lo", "n", "kept")
            sent, hot = numbers[2], numbers[3]
            by_key = np.argsort(sent, kind="stable")
            more = (lo, n, key, hot[by_key[np.searchsorted(sent[by_key], key)]])
            place, numbers = np.concatenate((place, at)), [np.concatenate(x) for x in zip(numbers, more, strict=True)]
        order = np.lexsort((numbers[0], place))
        place, numbers = place[order], [x[order] for x in numbers]
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(place)], strict=True):
            p = int(place[i])
            for f, v in zip(out, (documents["ids"][p], documents["ths"][p], *(_planes(x[i:j], FIELDS[f]) for f, x in zip(fields, numbers, strict=True))), strict=True):
                out[f].append(v)
    kinds = [pa.int64(), pa.int64(), *(pa.binary() for _ in fields)]
    return pa.table({f: pa.array(v, t) for (f, v), t in zip(out.items(), kinds, strict=True)})


def _numbered(keys: np.ndarray, snippets: list[bytes]) -> np.ndarray:
    """One number for each different (key, snippet), compared byte by byte."""
    seen: dict[tuple[int, bytes], int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in zip(keys.tolist(), snippets, strict=True)), np.int64, len(snippets))


def _least(number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry the smallest document of those with its number."""
    least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    return least[number]


def _snipped(batches: Iterator[pa.RecordBatch], buckets: int, limits: Sizes) -> Iterator[pa.RecordBatch]:
    """Around each anchor the bytes of all the strings it is the anchor of.

    Of equal snippets in a block only those of the smallest document go on: the other documents' strings start in it too,
    so their ranges are settled here. A hot anchor's strings go on one by one, each under its own hash.
    """
    for block, part, texts in _blocks(batches, limits):
        lo, n, key, hot = ([_numbers(x, FIELDS[f]) for x in part.column(f).to_pylist()] for f in ("lo", "n", "key", "hot"))
        place = np.repeat(np.arange(len(lo)), [len(x) for x in lo])
        lo, n, key, hot = (np.concatenate(x) for x in (lo, n, key, hot))
        lo, n = lo.astype(np.int64), n.astype(np.int64)
        doc = part.column("doc_id").to_numpy()[place]
        snippets = [texts[p][a : a + k + LENGTH - 1] for p, a, k in zip(place.tolist(), lo.tolist(), n.tolist(), strict=True)]
        own = doc == _least(_numbered(key, snippets), doc)
        settled = {"block": block, "bucket": block % buckets, "place": _planes(place[~own], np.uint16), "lo": _planes(lo[~own], np.uint32), "hi": _planes((lo + n + LENGTH - 1)[~own], np.uint32)}
        going = np.flatnonzero(own)
        place, lo, n, key, hot, doc, snippets = place[going], lo[going], n[going], key[going], hot[going].astype(bool), doc[going], [snippets[k] for k in going.tolist()]
        bucket = ((key >> U(32)) % U(buckets)).astype(np.int64)
        if hot.any():
            which = np.flatnonzero(hot)
            joined = np.frombuffer(b"".join(snippets[k] for k in which.tolist()), np.uint8)
            sizes = n[which]
            first = np.repeat(np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1), sizes)
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own_bucket, own_key = _key(string_hashes(joined)[first + step], buckets)
            of = np.repeat(which, sizes)
            strings = [snippets[k][j : j + LENGTH] for k, j in zip(of.tolist(), step.tolist(), strict=True)]
            rest = np.flatnonzero(~hot)
            bucket, key = np.concatenate((bucket[rest], own_bucket)), np.concatenate((key[rest], own_key))
            place, doc = np.concatenate((place[rest], place[of])), np.concatenate((doc[rest], doc[of]))
            lo, n, snippets = np.concatenate((lo[rest], lo[of] + step)), np.concatenate((n[rest], np.ones(len(of), np.int64))), [*(snippets[k] for k in rest.tolist()), *strings]
        order = np.lexsort((place, bucket))
        rows = _entries(block, bucket[order], buckets, place=place[order], lo=lo[order], n=n[order], key=key[order], doc=doc[order])
        i = 0
        for r in rows:
            j = i + len(_numbers(r["n"], FIELDS["n"]))
            r["snippets"] = zstandard.compress(b"".join([snippets[k] for k in order[i:j].tolist()]), 3)
            i = j
        documents = {"block": block, "bucket": block % buckets, "ids": part.column("doc_id").to_pylist(), "ths": part.column("th").to_pylist()}
        yield _packed([documents, *([] if own.all() else [settled]), *rows])


def _covered(doc: np.ndarray, n: np.ndarray, snippets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of snippets with their documents: (snippet, first, last) of the runs of strings that start in an earlier document too.

    One suffix array of all snippets brings equal strings together; where the permuted common prefixes reach LENGTH bytes,
    suffixes are in one run, and the smallest document of a run keeps its own.
    """
    t = np.frombuffer(b"".join(snippets), np.uint8)
    sizes = n + LENGTH - 1
    of = np.repeat(np.arange(len(n)), sizes)
    at = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = at < n[of]
    order = suffix_array(t)
    order = order[own[order]]
    run = np.flatnonzero(permuted_common_prefixes(t, order, LENGTH)[order] < LENGTH)
    docs = doc[of[order]]
    least = np.repeat(np.minimum.reduceat(docs, run), np.diff(np.append(run, len(order))))
    gone = np.zeros(len(t), bool)
    gone[order[docs > least]] = True
    part = of[1:] != of[:-1]
    first = np.flatnonzero(gone & np.concatenate(([True], ~gone[:-1] | part)))
    last = np.flatnonzero(gone & np.concatenate((~gone[1:] | part, [True])))
    return of[first], at[first], at[last]


def _deduplicated(batches: Iterator[pa.RecordBatch], limits: Sizes) -> Iterator[pa.RecordBatch]:
    """For each bucket's snippets the byte ranges to remove, by block and place."""
    for documents, buckets in _by_bucket(batches):
        yield _packed(documents)
        while buckets:
            _, rows = buckets.popitem()
            of, place, lo, n, key, doc = _gathered(rows, "place", "lo", "n", "key", "doc")
            lo, n = lo.astype(np.int64), n.astype(np.int64)
            blob, ends = b"".join(zstandard.decompress(r["snippets"]) for r in rows), np.cumsum(n + LENGTH - 1).tolist()
            snippets = [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            number = _numbered(key, snippets)
            copies = doc > _least(number, doc)  # the same bytes around the anchor, in an earlier document
            found = [(np.flatnonzero(copies), lo[copies], lo[copies] + n[copies] + LENGTH - 1)]
            keys, which = np.unique(key, return_inverse=True)
            several = np.full(len(keys), -1)
            np.maximum.at(several, which, number)
            least = np.full(len(keys), len(key))
            np.minimum.at(least, which, number)
            rest = np.flatnonzero(~copies & (several > least)[which])
            rest = rest[np.argsort(key[rest], kind="stable")]
            sizes = np.cumsum(n[rest] + LENGTH - 1)
            part = sizes // limits.shard_bytes
            part = part[np.searchsorted(key[rest], key[rest])] if len(rest) else part  # a key is in one array
            for p in np.unique(part).tolist():
                own = rest[part == p]
                which, first, last = _covered(doc[own], n[own], [snippets[k] for k in own.tolist()])
                found.append((own[which], lo[own[which]] + first, lo[own[which]] + last + LENGTH))
            entry, begin, end = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            turn = np.argsort(entry, kind="stable")
            entry, begin, end = entry[turn], begin[turn], end[turn]
            yield _packed(_split(rows, of[entry], place=place[entry], lo=begin, hi=end))


def _kept(batches: Iterator[pa.RecordBatch], keep_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, lo, hi in zip(*(batch.column(f).to_pylist() for f in ("text", "lo", "hi")), strict=True):
            raw = (text or "").encode()
            parts, runs, removed, end = [], 0, 0, 0
            if lo is not None:
                lo, hi = _numbers(lo, np.uint32), np.maximum.accumulate(_numbers(hi, np.uint32))
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                for a, b in zip(lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist(), strict=True):
                    parts.append(raw[end:a])
                    runs, removed, end = runs + 1, removed + b - a, b
            kept = b"".join(parts) + raw[end:]
            for column, value in zip(out, (len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 5 if keep_bytes else 4]
        yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns) + 1])


def deduplicate(docs: DataFrame, keep_bytes: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and on request the bytes kept.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Each such
    string has an anchor within it, chosen by its own bytes alone. Anchors that one document alone holds settle their
    strings; the snippets around the others go to the shard of their anchor, of those equal in all bytes within a block of
    documents only the first. A shard's different snippets make one string, whose suffix array is induced; where the permuted
    common prefixes of its neighbours reach LENGTH, strings are equal and the earliest document keeps its own. An anchor that
    very many places hold has its strings dealt out one by one, by their own bytes, so that no shard takes them all. Texts are
    shuffled once, by doc_id, and travel packed by blocks; tasks are as many as the texts' bytes ask for.

    A null or empty text has no bytes; a row without doc_id is kept whole and is nobody's earlier document; repeated rows give a
    row each and, being of one doc_id, keep their bytes. A very long text is a block of its own. An empty table gives none. Other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // sizes.task_bytes)
    buckets = 4 * tasks
    # keys without nulls, so that both joins below read one shuffle of the texts; no named row has a nameless one's hash
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.isnull("doc_id")).alias("th"))
    dealt = rows.repartition(tasks, "id", "th")
    named = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", "text", "th")
    held = named.mapInArrow(lambda it: _anchored(it, buckets, sizes), PACKED).repartition(tasks, "bucket").mapInArrow(lambda it: _repeated(it, sizes), PACKED)
    at = held.groupBy("block").applyInArrow(lambda t: _to_documents(t, ("lo", "n", "key", "hot")), "id long, th long, lo binary, n binary, key binary, hot binary")
    at = at.groupBy("id", "th").agg(*(F.first(f).alias(f) for f in ("lo", "n", "key", "hot")))
    snippets = dealt.join(at.hint("merge"), ["id", "th"]).select("doc_id", "th", "text", "lo", "n", "key", "hot").mapInArrow(lambda it: _snipped(it, buckets, sizes), PACKED)
    gone = snippets.repartition(tasks, "bucket").mapInArrow(lambda it: _deduplicated(it, sizes), PACKED)
    spans = gone.groupBy("block").applyInArrow(lambda t: _to_documents(t, ("lo", "hi")), "id long, th long, lo binary, hi binary")
    spans = spans.groupBy("id", "th").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    both = dealt.join(spans.hint("merge"), ["id", "th"], "left").select("doc_id", "text", "lo", "hi")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return both.mapInArrow(lambda it: _kept(it, keep_bytes), kinds)

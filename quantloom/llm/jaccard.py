"""N-gram Jaccard join by PartEnum signatures, and the groups its links form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import drop, stash

WIDTH = 5
#: Links: PARTS * intersection >= SHARE * union.
SHARE, PARTS = 75, 100
#: Largest set sizes of the bands grow by this factor. In a band the feature domain is cut into so many parts a size, and these
#: into groups of GROUP; the subsets of a group without one of its parts are enumerated.
BAND, PARTS_A_SIZE, LEAST_PARTS, GROUP = 8, 4 / 7, 16, 2
#: Shingles in this many different sets of one batch are counted; of those, so many of the most frequent are known to all tasks.
LOCAL_SETS, KNOWN_FREQUENT = 4, 100_000
#: Sets that share a signature: up to SMALL_GROUP are paired with each other, beyond it with HUBS of them first. So many of a
#: set's signatures, its least, tell in which of the groups that two sets share they meet.
SMALL_GROUP, HUBS, LEAST_SIGNS = 12, 3, 8
#: Members of a large group that are compared with one another in one task; shares into which its rows are cut for a join.
CHUNK, SALTS = 1024, 16
#: Rows of signatures that one task sorts, about, and signatures a shingle; bits of the filter of ids.
ROWS_A_TASK, SIGNS_A_SHINGLE, FILTER_BITS = 700_000, 0.4, 1 << 24

U = np.uint64
TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * TURNS[3]
    x = (x ^ (x >> U(29))) * TURNS[4]
    return x ^ (x >> U(32))


BYTE = mixed(np.arange(1, 257, dtype=U) * TURNS[0])
#: What undoes a multiplication by the polynomial's base.
BACK = U(pow(int(TURNS[1]), -1, 1 << 64))
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lower-cased texts, and how many words each text has.

    A word's hash is a polynomial in its bytes, from sums over all bytes at once, mixed with its length.
    """
    raw = b" ".join(texts).lower()
    if not raw:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    buf = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[buf], [True])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sums = np.concatenate(([U(0)], np.cumsum(BYTE[buf] * np.cumprod(np.full(len(buf), TURNS[1])))))
    back = np.concatenate(([U(1)], np.cumprod(np.full(len(buf), BACK))))
    found = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(U) * TURNS[0])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return found, np.diff(np.searchsorted(begin, starts))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's five-word shingles; of fewer words the sequence is the only one.

    Words are what ASCII white space parts, with A-Z in lower case: bytes.lower() changes just these.
    """
    ids, counts = word_hashes([(t or "").encode() for t in texts])

    def combined(ids: np.ndarray, width: int) -> np.ndarray:
        total = np.full(max(0, len(ids) - width + 1), width, U)
        for j in range(width):
            total += ids[j : len(ids) - width + 1 + j] * TURNS[j]
            total ^= total >> U(31)
        return mixed(total)

    every, at, out = combined(ids, WIDTH), 0, []
    for n in counts.tolist():
        out.append(np.unique(every[at : at + n - WIDTH + 1]) if n >= WIDTH else combined(ids[at : at + n], n) if n else np.zeros(0, U))
        at += n
    return out


def bands(size: int) -> list[int]:
    """Largest sizes of the bands in which a set of that size meets its partners: its own, and the next if a partner may be there."""
    top = BAND
    while top < size:
        top *= BAND
    return [top] if size * PARTS // SHARE <= top else [top, top * BAND]


def sketch(s: np.ndarray) -> bytes:
    """For each band of the set one bit for each of the band's cells: whether the shingles in the cell are odd in number.

    Where the bits of two sets differ their shingles do: the sets differ in as many shingles at least as bits.
    """
    out = [b""]
    for top in bands(len(s)) if len(s) else ():
        cell = ((s >> U(20)) % U(cells(top))).astype(np.int64)
        out.append(np.packbits((np.bincount(cell, minlength=cells(top)) & 1).astype(bool)).tobytes())
    return b"".join(out)


def cells(top: int) -> int:
    """A multiple of 8. At so many cells, sets of a band that share half their shingles differ in too many bits for a link."""
    return 16 + top


# --- sets, and frequent shingles -------------------------------------------------------------------------------------


#: Texts whose words are hashed together.
TOGETHER = 256


def _digests(batches: Iterator[pa.RecordBatch], local_sets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, sketches, seen = [], [], [], {}
        for at in range(0, batch.num_rows, TOGETHER):
            for s in shingle_sets(batch.column(1).slice(at, TOGETHER).to_pylist()):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(len(s))
                digests.append(digest)
                sketches.append(sketch(s))
                seen[digest] = s
        n = batch.num_rows
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int64())], names=["doc_id", "n", "digest", "sketch", "shingle"])
        hashes, counts = np.unique(np.concatenate([np.zeros(0, U), *seen.values()]), return_counts=True)
        hashes, counts = hashes[counts >= local_sets], counts[counts >= local_sets]
        yield pa.record_batch([pa.nulls(len(hashes), pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(hashes), pa.binary()), pa.nulls(len(hashes), pa.binary()), pa.array(hashes.view(np.int64))], names=["doc_id", "n", "digest", "sketch", "shingle"])


# --- signatures ------------------------------------------------------------------------------------------------------


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set of shingle hashes.

    In a band the domain of shingles is cut into groups of GROUP parts. Of each group all subsets of GROUP - 1 parts are
    enumerated; what the set holds in such a subset is a signature. Sets A and B that link differ in at most
    d = (|A| + |B|) / 7 shingles. A part that differs spoils the GROUP - 1 subsets with it, so all but (GROUP - 1) d signatures
    agree, and in one order for all sets the first (GROUP - 1) d + 1 of A and of B share one: so few are kept. The order puts
    first those with many shingles that are not known to be frequent, then large ones, so that what many documents hold comes
    last, and subsets that hold nothing after all others.
    """
    out = []
    spread = mixed(s * TURNS[2])
    place = np.searchsorted(frequent, s)
    rare = frequent[np.minimum(place, len(frequent) - 1)] != s if len(frequent) else np.ones(len(s), bool)
    for top in bands(len(s)):
        parts = -(-max(LEAST_PARTS, int(top * PARTS_A_SIZE)) // GROUP) * GROUP
        apart = (len(s) + min(len(s) * PARTS // SHARE, top)) * (PARTS - SHARE) // (PARTS + SHARE)
        part = (spread >> U(33)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        own = part[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        held = own[starts]
        groups, of = np.unique(held // GROUP, return_inverse=True)
        cells = (of, held % GROUP)
        sums, sizes, rares = np.zeros((len(groups), GROUP), U), np.zeros((len(groups), GROUP), np.int64), np.zeros((len(groups), GROUP), np.int64)
        sums[cells] = mixed(np.add.reduceat(spread[order], starts) + (held.astype(U) + U(1)) * TURNS[4])
        sizes[cells] = np.diff(np.concatenate((starts, [len(s)])))
        rares[cells] = np.add.reduceat(rare[order].astype(np.int64), starts)
        without = (groups[:, None] * GROUP + np.arange(GROUP)).astype(U)  # a subset is named by the part it leaves out
        found = mixed((sums.sum(1, keepdims=True) - sums) * TURNS[1] + mixed((without + U(1)) * TURNS[0] + U(top))).ravel()
        size, rarity = (sizes.sum(1, keepdims=True) - sizes).ravel(), (rares.sum(1, keepdims=True) - rares).ravel()
        keep = (GROUP - 1) * apart + 1  # never more than there are: a band's parts are 4 / 7 of its largest size, d is 2 / 7
        filled = np.flatnonzero(size)
        first = filled[np.lexsort((found[filled], -size[filled], -rarity[filled]))[:keep]]
        out.append(found[first])
        if keep > len(filled):
            empty = np.setdiff1d(np.arange(parts), without.ravel()[filled].astype(np.int64)).astype(U)
            nothing = np.sort(mixed(mixed((empty + U(1)) * TURNS[0] + U(top))))
            out.append(nothing[: keep - len(filled)])
    return np.concatenate(out)


#: Signatures by bucket: those of some documents, with the documents and their sets' sizes, as compressed bytes.
PACKED = "bucket int, signs binary, docs binary, ns binary"
#: Bits of a signature that tell it from others of its bucket.
SIGN_BITS = 40


def _squeezed(x: np.ndarray, width: int) -> bytes:
    """The numbers' lowest `width` bytes, all lowest ones first."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes(), 1)


def _numbers(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.int64).ravel()


def _signed(batches: Iterator[pa.RecordBatch], frequent, buckets: int) -> Iterator[pa.RecordBatch]:
    """The signatures of the documents that name their class."""
    for batch in batches:
        signs, docs, ns = [], [], []
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            for doc, of, s in zip(part.column("doc_id").to_pylist(), part.column("of").to_pylist(), shingle_sets(part.column("text").to_pylist()), strict=True):
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == of:
                    found = signatures(s, frequent.value)
                    signs.append(found)
                    docs.append(np.full(len(found), doc))
                    ns.append(np.full(len(found), len(s)))
        if not signs:
            continue
        sign, doc, n = np.concatenate(signs), np.concatenate(docs), np.concatenate(ns)
        bucket = ((sign & U(0xFFFFFF)) % U(buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        sign, doc, n = (sign[order] >> U(64 - SIGN_BITS)).astype(np.int64), doc[order], n[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        rows = [(k, _squeezed(sign[i:j], SIGN_BITS // 8), _squeezed(np.diff(doc[i:j], prepend=0), 8), _squeezed(n[i:j], 4)) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "signs", "docs", "ns"])


# --- candidates ------------------------------------------------------------------------------------------------------

CANDIDATES = "a long, b long, sign long, n int"


def _rows(a: np.ndarray, b: np.ndarray | None, sign: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    column = lambda x, kind: pa.nulls(len(a), kind) if x is None else pa.array(x, kind)
    return pa.record_batch([pa.array(a, pa.int64()), column(b, pa.int64()), column(sign, pa.int64()), column(n, pa.int32())], names=["a", "b", "sign", "n"])


def _near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return PARTS * np.minimum(n, m) >= SHARE * np.maximum(n, m)


def _pairs(chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not chunks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*chunks, strict=True))
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return found[:, 0], found[:, 1]


def _met(batches: Iterator[pa.RecordBatch], small_group: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a task's signature groups, and the members of those too large to be paired."""
    signs, docs, ns = [], [], []
    for batch in batches:
        for bucket, raw, doc_raw, n_raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "signs", "docs", "ns")), strict=True):
            signs.append(bucket << SIGN_BITS | _numbers(raw, SIGN_BITS // 8))
            docs.append(np.cumsum(_numbers(doc_raw, 8)))
            ns.append(_numbers(n_raw, 4))
    if not signs:
        return
    sign, doc, n = np.concatenate(signs), np.concatenate(docs), np.concatenate(ns)
    signs.clear(), docs.clear(), ns.clear()
    order = np.lexsort((mixed(doc.view(U)), sign))
    sign, doc, n = sign[order], doc[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(sign)])))
    of, place = np.repeat(np.arange(len(starts)), sizes), np.arange(len(sign)) - np.repeat(starts, sizes)
    left = sizes[of] - place - 1
    chunks = []
    for step in range(1, min(small_group, int(sizes.max(initial=1)))):
        i = np.flatnonzero((left >= step) & (sizes[of] <= small_group))
        i = i[_near(n[i], n[i + step]) & (doc[i] != doc[i + step])]
        chunks.append((doc[i], doc[i + step]))
    large = sizes[of] > small_group
    for hub in range(HUBS):
        i = np.flatnonzero(large & (place > hub))
        h = starts[of[i]] + hub
        near = _near(n[i], n[h]) & (doc[i] != doc[h])
        chunks.append((doc[i[near]], doc[h[near]]))
    yield _rows(*_pairs(chunks), None, None)
    yield _rows(doc[large], None, sign[large], n[large])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of chunks of large groups, the pairs of members in different components whose sketches allow a link.

    Two members that have some of their least signatures in common meet in the group of the first of these alone; others meet
    in every group they share.
    """
    read = [(*(b.column(i).to_numpy() for i in range(7)), b.column(7).to_pylist(), b.column(8).to_pylist()) for b in batches]
    if not read:
        return
    sign, doc, n, label, chunk, left, right = (np.concatenate(x) for x in list(zip(*read, strict=True))[:7])
    sketches, least = [x for r in read for x in r[7]], [frozenset(x) for r in read for x in r[8]]
    order = np.lexsort((mixed(doc.view(U)), chunk, right, left, sign))
    sign, doc, n, label, chunk, left, right = (x[order] for x in (sign, doc, n, label, chunk, left, right))
    starts = np.flatnonzero(np.concatenate(([True], (sign[1:] != sign[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
    chunks = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sign)], strict=True):
        if (label[a:b] == label[a]).all():
            continue
        top = bands(int(n[a:b].max()))[0]  # a signature is of one band; its sets meet in the largest one's
        inside = [top in bands(int(x)) for x in n[a:b].tolist()]
        rows = np.stack([_cells(sketches[k], int(m), top) if i else np.zeros(cells(top) // 8, np.uint8) for k, m, i in zip(order[a:b].tolist(), n[a:b].tolist(), inside, strict=True)])
        inside, own, this = np.array(inside), [least[k] for k in order[a:b].tolist()], int(sign[a])
        across = left[a] != right[a]
        second = int(np.searchsorted(chunk[a:b], right[a])) if across else 0
        for h in range(second if across else b - a - 1):
            begin = second if across else h + 1
            i = begin + np.flatnonzero((label[a + begin : b] != label[a + h]) & _near(n[a + begin : b], n[a + h]) & inside[begin:] & inside[h])
            apart = np.bitwise_count(rows[i] ^ rows[h]).sum(1, dtype=np.int64)
            i = i[apart * (PARTS + SHARE) <= (n[a + i] + n[a + h]) * (PARTS - SHARE)]
            i = i[[not both or min(both) == this for both in (own[h] & own[k] for k in i.tolist())]] if len(i) else i
            chunks.append((doc[a + i], np.full(len(i), doc[a + h])))
        if sum(len(x) for x, _ in chunks) > 500_000:
            chunks = [_pairs(chunks)]
    yield _rows(*_pairs(chunks), None, None)


def _cells(raw: bytes, size: int, top: int) -> np.ndarray:
    """A set's sketch in the band up to `top`."""
    return np.frombuffer(raw, np.uint8)[sum(cells(t) // 8 for t in bands(size) if t < top) :][: cells(top) // 8]


# --- verification ----------------------------------------------------------------------------------------------------


def _bits(ids: DataFrame) -> np.ndarray:
    """A one-hash filter of the ids: FILTER_BITS bits, whatever their number."""
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(h, 5).cast("int").alias("w"), F.pmod(h, F.lit(32)).cast("int").alias("bit"))
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("x")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["x"].to_numpy(np.int64)
    return out


def _sets(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    filter_ = bits.value
    for batch in batches:
        h = batch.column("h").to_numpy()
        batch = batch.filter(pa.array((filter_[h >> 5] >> (h & 31) & 1).astype(bool)))
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield pa.record_batch([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text").to_pylist())], pa.binary())], names=["id", "shingles"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            place = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = int((x[place] == y).sum())
            keep.append(PARTS * both >= SHARE * (len(x) + len(y) - both))
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(keep))


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches don't rule out a link: J >= s means a difference of at most (1 - s) / (1 + s) of the sizes' sum."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
            low, high = sorted((bands(n), bands(m)))
            top = high[0]
            if top not in low:
                keep.append(False)
                continue
            x, y = _cells(x, n, top), _cells(y, m, top)
            keep.append(int(np.bitwise_count(x ^ y).sum()) * (PARTS + SHARE) <= (n + m) * (PARTS - SHARE))
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _plausible(pairs: DataFrame, sized: DataFrame) -> DataFrame:
    """The candidate pairs whose sketches allow a link."""
    of = lambda id_, n, x: sized.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias(id_), F.col("n").alias(n), F.col("sketch").alias(x))
    return stash(pairs.join(of("b", "m", "y"), "b").join(of("a", "n", "x"), "a").select("a", "b", "n", "m", "x", "y").mapInArrow(_maybe, "a long, b long"))


def _verified(left: DataFrame, rows: DataFrame) -> DataFrame:
    """The links among the candidate pairs that sketches have left.

    Whole sets are compared: first each document with one partner, then the pairs that these links have not brought into one
    component.
    """
    spark = left.sparkSession
    ids = stash(left.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    if ids.isEmpty():
        drop(ids)
        return spark.createDataFrame([], "u long, v long")
    bits = spark.sparkContext.broadcast(_bits(ids))
    hashed = rows.where("doc_id is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    sets = stash(hashed.mapInArrow(lambda it: _sets(it, bits), "id long, shingles binary").join(ids, "id", "left_semi"))

    def compared(some: DataFrame) -> DataFrame:
        right = some.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        both = right.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        return stash(both.select("a", "b", "x", "y").mapInArrow(_links, "u long, v long"))

    links = compared(left.groupBy("b").agg(F.min("a").alias("a")))
    if links.isEmpty():
        links = compared(left)
        drop(ids, sets)
        return links
    names = components(links)
    named = lambda id_, label: names.select(F.col("id").alias(id_), F.col("component").alias(label))
    apart = left.join(named("a", "_a"), "a", "left").join(named("b", "_b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    apart = stash(apart)
    more = compared(apart)
    drop(ids, sets, apart)
    return links.unionByName(more)


def groups(docs: DataFrame, small_group: int = SMALL_GROUP, chunk_size: int = CHUNK, local_sets: int = LOCAL_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document.

    Equal sets are one class, named by its smallest doc_id; only class names are joined. Signatures bring together the
    classes that may link; every candidate pair is verified on its whole sets. Members of a large signature group meet a few
    hubs first; those that are then in different components meet, chunk by chunk, where their sketches allow a link, so that no
    link between components is lost, while copies of one text are never paired with each other.

    A null or empty text has no shingles and its own component. A row without doc_id has n_shingles and no component. Repeated
    rows give a row each. An empty table gives none. Other columns are not read. Shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = stash(rows.mapInArrow(lambda it: _digests(it, local_sets), "doc_id long, n long, digest binary, sketch binary, shingle long"))
    known = seen.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(KNOWN_FREQUENT).toPandas()
    frequent = spark.sparkContext.broadcast(np.sort(known["shingle"].to_numpy(np.int64).view(U)))
    sized = seen.where("shingle is null").select("doc_id", "n", "digest", "sketch")
    classes = sized.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class"), F.max("n").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    named = classes.select(F.col("digest").alias("of"), F.col("class").alias("doc_id"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * SIGNS_A_SHINGLE) // ROWS_A_TASK)
    buckets = 4 * tasks
    packed = rows.join(named, "doc_id").select("doc_id", "text", "of").mapInArrow(lambda it: _signed(it, frequent, buckets), PACKED)
    met = stash(packed.repartition(tasks, "bucket").mapInArrow(lambda it: _met(it, small_group), CANDIDATES))
    pairs, large = met.where("b is not null").select("a", "b").distinct(), met.where("b is null").select("sign", F.col("a").alias("doc_id"), "n")
    plausible = _plausible(pairs, sized)
    links = _verified(plausible, rows)
    drop(plausible)
    found = components(links)
    if not large.isEmpty():
        labels = found.select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
        rest = large.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        several = rest.groupBy("sign").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count(F.lit(1)) / chunk_size).cast("int").alias("chunks")).where("low <> high")
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        open_ = rest.withColumn("salt", salt).join(several.select("sign", "chunks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["sign", "salt"])
        open_ = open_.groupBy("doc_id", "n", "label").agg(F.sort_array(F.collect_list(F.struct("sign", "chunks"))).alias("groups"))
        sketched = open_.join(sized.where("n > 0 and doc_id is not null").select("doc_id", "sketch"), "doc_id")
        members = sketched.select(F.explode("groups").alias("g"), "doc_id", "n", "label", "sketch", F.transform(F.slice("groups", 1, LEAST_SIGNS), lambda g: g["sign"]).alias("least"))
        chunk = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("g.chunks")).cast("int")
        members = members.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g.chunks") - 1)))
        members = members.select(F.col("g.sign").alias("sign"), "doc_id", "n", "label", "chunk", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "sketch", "least")
        more = stash(members.repartition(tasks, "sign", "left", "right").mapInArrow(_rest, CANDIDATES).select("a", "b").distinct())
        new = _verified(more, rows) if not more.isEmpty() else more
        drop(met)
        if not new.isEmpty():
            links = stash(links.unionByName(new))
            found = components(links)
    names = found.select(F.col("id").alias("class"), "component")
    by_set = classes.select("digest", "class").join(names, "class", "left").select("digest", F.coalesce("component", "class").alias("component"))
    out = sized.join(by_set, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

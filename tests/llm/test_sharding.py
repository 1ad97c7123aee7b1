import zlib
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from quantloom.llm.sharding import interleave


def test_counts_mixture_and_slots(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = interleave(odd_docs, 4).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    hot = Counter(r.shard for r in got if r.doc_id and r.doc_id >= 100)
    assert max(hot.values()) - min(hot.values()) <= 3
    assert interleave(no_docs).count() == 0
    assert {tuple(r) for r in interleave(odd_docs.repartition(7), 4).collect()} == {tuple(r) for r in got}


def plain_shards(rows, shards):
    """(doc_id, crc, size, source): rows ranked in their source by (hash, doc_id, crc, size), then in all by fractional rank."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    placed = []
    for source, own in by_source.items():
        own.sort(key=lambda r: (r.shuffled % 2**64 >> 42, r.shuffled, r.doc_id is not None, r.doc_id or 0, r.crc, r.size))
        placed += [(Fraction(2 * k + 1, 2 * len(own)), "" if source is None else f"={source}", k, r) for k, r in enumerate(own)]
    placed.sort(key=lambda x: x[:3])
    shard = [k * shards // len(placed) for k in range(len(placed))]
    slots = Counter()
    out = Counter()
    for s, (*_, r) in zip(shard, placed):
        out[r.doc_id, r.size, r.crc, s, slots[s]] += 1
        slots[s] += 1
    return out


def test_shards_are_the_plain_ones(spark):
    """Sources of several sizes, none, ties of the whole row; each shard has each source in proportion, to within one row a cut."""
    sources = ["hot"] * 300 + ["b"] * 90 + ["c"] * 7 + [None] * 20
    docs = spark.createDataFrame([(k // 2 if k % 11 == 0 else k, f"text {k % 50}" if k % 13 else None, s) for k, s in enumerate(sources)] + [(1, "text 1", "hot")] * 3, "doc_id long, text string, source string")
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", crc.alias("crc"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.xxhash64(F.lit(20240229), F.col("doc_id"), crc).alias("shuffled")).collect()
    for shards in (4, 16):
        got = interleave(docs.repartition(5), shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == plain_shards(rows, shards)
    own = {(r.doc_id, r.crc, r.size): r.source for r in rows}
    for source, n in Counter(r.source for r in rows).items():
        held = Counter(r.shard for r in got if own[r.doc_id, r.text_crc32, r.size] == source)
        assert all(abs(held[s] - n / 16) < 2.5 for s in range(16)), (source, held)

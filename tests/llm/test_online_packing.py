import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quantloom.llm.online_packing import Piece, Windows, pack_stream
from quantloom.llm.pretokens import tokenizer

BYTES = "byte_bpe_50k.json"


def squares(counts, capacity):
    return sum(n * n for fill, n in counts.items() if 0 < fill < capacity)


def check(pieces, docs, capacity):
    """Each token in one piece, sequences without gaps, and none that would be padded."""
    t = tokenizer(BYTES)
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    ids, times = {}, Counter()
    for d in docs:
        ids[d.doc_id] = [*t.encode(d.text or "", add_special_tokens=False).ids, 1]
        times[d.doc_id] += 1
    assert {k for k, _ in parts} == set(ids)
    for (doc, tokens), spans in parts.items():
        assert tokens == len(ids[doc])
        covered = Counter()
        for start, length, crc in spans:
            covered.update(range(start, start + length))
            assert crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
        assert covered == Counter({k: times[doc] for k in range(tokens)})
    return sequences


def test_whole_table(odd_docs, no_docs):
    rows = odd_docs.collect()
    for most_open in (4096, 6):
        got = pack_stream(odd_docs.repartition(3), 128, most_open=most_open).collect()
        sequences = check(got, rows, 128)
        assert sum(sum(n for _, n in s) < 128 for s in sequences.values()) <= 3 * 7
    assert pack_stream(no_docs).count() == 0
    kept = pack_stream(odd_docs, 128, keep_ids=True)
    assert kept.where("length(ids) != 4 * length").count() == 0
    assert {tuple(r) for r in pack_stream(odd_docs.coalesce(1), 128).collect()} == {tuple(r) for r in pack_stream(odd_docs.coalesce(1), 128).collect()}


def test_columns_of_other_names(odd_docs):
    same = odd_docs.coalesce(1)
    wider = same.withColumns({n: F.lit(n) for n in ("start", "length", "sequence_id", "offset", "ids")})
    assert sorted(map(str, pack_stream(wider, 128).collect())) == sorted(map(str, pack_stream(same, 128).collect()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_each_level_is_the_one_with_the_least_sum_of_squares(sizes):
    windows, counts = Windows(12), Counter()
    for k, size in enumerate(sizes):
        if size < 12:
            at = windows.level(size)
            sums = {}
            for h in range(13 - size):
                if h == 0 or counts[h]:
                    then = counts.copy()
                    then[h] -= 1
                    then[h + size] += 1
                    sums[h] = squares(then, 12)
            assert at == max(h for h in sums if sums[h] == min(sums.values()))
            counts[at] -= 1
            counts[at + size] += 1
        windows.place(Piece(k, 0, b"abcd" * size, size))
        assert all(windows.counts[h] == counts[h] == len(windows.levels[h]) for h in range(1, 12))
    windows.finish()
    assert sum(p.length for w in windows.closed for p in w) == sum(sizes)
    assert windows.open == 0


def test_a_bounded_number_of_windows_is_open():
    """Documents of which no two fit together stay open in any online packing; here they are cut to top up each other."""
    windows = Windows(100, most_open=50)
    for k in range(1000):
        windows.place(Piece(k, 0, b"abcd" * 60, 60))
        assert windows.open <= 50
    windows.finish()
    assert len(windows.closed) == 600 and all(sum(p.length for p in w) == 100 for w in windows.closed)


def test_fitting_sizes_leave_documents_whole():
    """Sizes that fill windows perfectly are packed with a vanishing share of cut documents."""
    windows, sizes = Windows(100), np.random.default_rng(1).permutation([30] * 3000 + [70] * 3000)
    for k, size in enumerate(sizes.tolist()):
        windows.place(Piece(k, 0, b"abcd" * size, size))
    windows.finish()
    assert sum(len(w) for w in windows.closed) - len(sizes) < 0.02 * len(sizes)

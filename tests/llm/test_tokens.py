import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from quantloom.llm.packing import fullest, pack, pack_documents, slack_plan, token_pieces
from quantloom.llm.pretokens import SpacedIds, tokenizer, words_of
from quantloom.llm.token_counts import VOCABULARY, count_tokens

BYTES = "byte_bpe_50k.json"
mixed = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" '  \n\t<|>endoftext|startoftext"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(mixed)
def test_words_and_ids_are_the_librarys(text):
    t = tokenizer(VOCABULARY)
    assert sum(len(t.encode(w, add_special_tokens=False).ids) for w in words_of(text, VOCABULARY)) == len(t.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(SpacedIds(BYTES).ids(text), "<u4").tolist() == tokenizer(BYTES).encode(text, add_special_tokens=False).ids


def test_counts(odd_docs, no_docs):
    t = tokenizer(VOCABULARY)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert Counter(tuple(r) for r in count_tokens(odd_docs).select("doc_id", "n_bytes", "n_tokens").collect()) == want
    assert count_tokens(no_docs).count() == 0


def check_packing(pieces, docs, capacity):
    t = tokenizer(BYTES)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    return len(sequences)


def test_packing(odd_docs, no_docs):
    got = pack_documents(odd_docs, 128).collect()
    used = check_packing(got, odd_docs.collect(), 128)
    assert used <= 1.02 * sum(r.length for r in got) / 128 + 1
    assert pack_documents(no_docs).count() == 0
    assert token_pieces(odd_docs, keep_ids=True).where("length(ids) != 4 * length").count() == 0


def test_packing_keeps_further_columns(odd_docs):
    pieces = token_pieces(odd_docs, 128).withColumns({n: F.lit(n) for n in ("rank", "order", "_order", "_bucket", "group_rows", "row", "offset")})
    got = pack(pieces, 128)
    assert got.columns == [*pieces.drop("offset").columns, "sequence_id", "offset"]
    assert all(r["rank"] == "rank" and r["row"] == "row" and r["_order"] == "_order" for r in got.collect())
    check_packing(got.collect(), odd_docs.collect(), 128)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8))
def test_the_fullest_bin_is_the_fullest(counts):
    sums = {0}
    longest = max(counts)
    for n, k in counts.items():
        for _ in range(k - (n == longest)):
            sums |= {s + n for s in sums}
    used = fullest(counts, 50)
    assert all(used[n] <= counts[n] for n in used)
    assert sum(n * k for n, k in used.items()) == longest + max(s for s in sums if s <= 50 - longest)
    left = Counter(counts)
    for content, times in slack_plan(counts, 50):
        left.subtract({n: k * times for n, k in content.items()})
    assert not any(left.values())

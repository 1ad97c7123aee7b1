import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from quantloom.llm import induced, suffixes


def brute(rows):
    least = {}
    for d, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            s = raw[i : i + 50]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49 if d is not None else 0):
            if least[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.text("ab", max_size=200).map(str.encode), st.text("ab", min_size=1, max_size=6).map(lambda s: (s * 40).encode())))
def test_suffix_array_and_common_prefixes(raw):
    t = np.frombuffer(raw, np.uint8)
    got = induced.suffix_array(t).tolist()
    assert got == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = induced.permuted_common_prefixes(t, np.array(got, np.int64), 50)
    for a, b in zip(got, got[1:]):
        assert shared[b] == min(50, next((k for k, (x, y) in enumerate(zip(raw[a:], raw[b:])) if x != y), len(raw) - max(a, b)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_names_are_sorted_by_recursion(names):
    names = np.unique(np.array(names, np.int64), return_inverse=True)[1]
    want = sorted(range(len(names)), key=lambda i: names[i:].tolist())
    assert induced.suffix_array(names, int(names.max(initial=-1)) + 1).tolist() == want


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(12)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 400, "ab" * 100, "ab" * 90 + "c" + "ab" * 70]
    for _ in range(150):
        parts = [r.choice([r.choice(passages), r.choice(passages)[r.randint(0, 40) :], " ".join(word() for _ in range(12))]) for _ in range(r.randint(1, 6))]
        texts.append("\n".join(parts))
    texts += [texts[20], texts[30][:-3] + "zz", "line " * 30]
    rows = [(r.randint(0, 10**6), t) for t in texts]
    return [*rows, (None, texts[40]), rows[25], (rows[26][0], texts[50])]


def test_against_brute_force(spark):
    """With large blocks and small ones; with anchors that are hot from two entries on."""
    for seed, sizes in (1, suffixes.Sizes()), (2, suffixes.Sizes(block_bytes=300, shard_bytes=700)), (3, suffixes.Sizes(block_bytes=2000, hot=1, task_bytes=20_000)), (4, suffixes.Sizes(block=7, shard_bytes=900, hot=5)):
        rows = corpus(seed)
        frame = spark.createDataFrame([(*x, "other", "x") for x in rows], "doc_id long, text string, lo string, hot string").repartition(3)
        got = sorted((tuple(x) for x in suffixes.deduplicate(frame, sizes=sizes).collect()), key=str)
        assert got == brute(rows), seed


def test_odd_and_very_long_documents(spark, odd_docs):
    long = "".join(f"{i * 7919 % 100003} " for i in range(60_000))
    frame = odd_docs.select("doc_id", "text", "rank").union(spark.createDataFrame([(9000, long, "x"), (9001, "head " + long, "x"), (9001, long[5000:5049], "x")], "doc_id long, text string, rank string"))
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert sorted((tuple(x) for x in suffixes.deduplicate(frame).collect()), key=str) == brute(rows)


def test_kept_bytes(spark, no_docs):
    frame = spark.createDataFrame([(1, "a" * 60), (2, "é" + "a" * 60 + "b")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in suffixes.deduplicate(frame, keep_bytes=True).collect()} == {1: b"a" * 60, 2: "éb".encode()}
    assert suffixes.deduplicate(no_docs).count() == 0


def test_a_hot_anchor_is_one_entry_a_block(spark):
    """A line of every document: its anchors' bucket gets an entry of each block, whatever its number of documents."""
    r = random.Random(8)
    line = "this work is licensed to everybody under the terms of the public licence of the land, all rights reserved"
    rows = [(k, "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 120))) + line + str(k)) for k in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = suffixes.Sizes(block=100, hot=50)
    named = frame.selectExpr("doc_id", "text", "xxhash64(text, false) as th")
    sent = named.mapInArrow(lambda it: suffixes._anchored(it, 8, sizes), suffixes.PACKED).where("key is not null").select("block", "key").collect()
    held = {}
    for x in sent:
        for k in suffixes._numbers(bytes(x.key), np.uint64).tolist():
            held.setdefault(k, []).append(x.block)
    blocks = {x.block for x in sent}
    assert max(map(len, held.values())) == len(blocks) < 20
    assert sorted((tuple(x) for x in suffixes.deduplicate(frame, sizes=sizes).collect()), key=str) == brute(rows)

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quantloom.llm import jaccard
from quantloom.llm.components import components


def brute(rows):
    """n_shingles and component of each row, from all pairs of sets of word tuples."""
    sets = []
    for _, text in rows:
        words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            x, y = sets[i], sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def family(r, size, copies, edits, vocabulary="w{}"):
    base = [vocabulary.format(r.randint(0, 5000)) for _ in range(size)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [None, "", "one", "One", "one two", "one two three four", "  a b c d e  ", "A b\x0bc d E"]
    for size in (5, 6, 7, 8, 9, 12, 20, 40, 70, 150, 520):
        for _ in range(3):
            texts += family(r, size, r.randint(2, 6), max(1, size // 25))
    texts += family(r, 60, 40, 3)
    texts += family(r, 4600, 3, 120) if seed == 1 else []
    texts += [f"{passage} " + " ".join(f"x{r.randint(0, 10**6)}" for _ in range(r.randint(5, 60))) for _ in range(40)]
    rows = list(enumerate(texts, 10))
    r.shuffle(rows)
    return [*rows, (None, texts[-1]), rows[0], rows[20]]


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"small_group": 3, "chunk_size": 2, "local_sets": 2}), (3, {"small_group": 2, "chunk_size": 1000})])
def test_groups_against_all_pairs(spark, seed, limits):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*x, *["other"] * 6) for x in rows], "doc_id long, text string, component_id string, n string, digest string, of string, sign string, class string").repartition(3)
    got = sorted((tuple(x) for x in jaccard.groups(frame, **limits).collect()), key=str)
    assert got == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 700), st.integers(0, 2**32 - 1))
def test_linked_sets_share_a_signature(size, seed):
    """Whatever the order makes of frequent shingles: two sets that link meet in at least one subset of parts."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size, np.uint64))
    frequent = np.sort(np.concatenate((rng.choice(a, len(a) // 3, replace=False), rng.integers(0, 2**63, 50, np.uint64))))
    most = max(0, len(a) // 7)
    lost, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
    b = np.union1d(rng.choice(a, len(a) - lost, replace=False), rng.integers(0, 2**63, new, np.uint64))
    both = len(np.intersect1d(a, b))
    if 100 * both >= 75 * (len(a) + len(b) - both):
        assert np.intersect1d(jaccard.signatures(a, frequent), jaccard.signatures(b, frequent)).size


def test_packed_numbers():
    x = np.array([0, 5, -3, 2**40 - 1, 2**62])
    assert jaccard._numbers(jaccard._squeezed(x, 8), 8).tolist() == x.tolist()
    assert jaccard._numbers(jaccard._squeezed(x[[0, 1, 3]], 5), 5).tolist() == [0, 5, 2**40 - 1]


def test_odd_documents(spark, odd_docs):
    assert sorted((tuple(x) for x in jaccard.groups(odd_docs).collect()), key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_none(no_docs):
    assert jaccard.groups(no_docs).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(r.randint(1000, 1100), r.randint(1000, 1100)) for _ in range(70)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for a in sorted(near):
        todo = [a] if a not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = a
                todo += near[x]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if len(near[k] - {k})}

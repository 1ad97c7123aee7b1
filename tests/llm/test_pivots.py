import math
import random
from collections import Counter

import pytest

from quantloom.llm import pivots
from quantloom.llm.pivots import top_k

KINDS = "vec_id long, embedding array<float>, score string, rank string, number string"


def brute(frame, every, k):
    data = [(x.vec_id, [math.floor(1024 * v) for v in x.embedding]) for x in frame.collect() if x.vec_id is not None and x.embedding is not None and all(v is not None and math.isfinite(v) for v in x.embedding)]
    out = Counter()
    for q, v in data:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q and len(w) == len(v))[:k]
            out.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    return out


@pytest.mark.parametrize("most", [300, 16 << 20])
def test_against_brute_force(spark, monkeypatch, most):
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.25, r.uniform(-1, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [math.nan] * 6), (600, [math.inf] * 6), (None, [1.0] * 6), (700, [0.5, 0.5]), (701, [0.5, -0.5]), (800, []), (3, [0.9] * 6)]
    rows += [(50, rows[50][1]), (50, [0.7] * 6), (100, rows[100][1]), (100, rows[100][1])]  # query rows that occur again
    frame = spark.createDataFrame([(*x, "x", "y", "z") for x in rows], KINDS).repartition(3)
    monkeypatch.setattr(pivots, "QUERY_BYTES", most)
    got = top_k(frame, k=5, every=50)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(frame, 50, 5)
    assert top_k(frame.limit(0)).count() == 0


def test_ties_fall_to_the_smaller_id(spark):
    frame = spark.createDataFrame([(i, [0.5] * 4, None, None, None) for i in range(300)], KINDS)
    assert [(x.rank, x.vec_id) for x in top_k(frame, every=1000).orderBy("rank").collect()] == [(n, n) for n in range(1, 11)]


def test_near_clusters_are_eliminated():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.rint(np.concatenate([c + rng.normal(size=(500, 16)) for c in rng.normal(size=(8, 16)) * 200]))
    chosen = pivots.spread_out(x[::7].tolist(), 24)[16]
    table, norm2 = pivots.distances(x, chosen), (x**2).sum(1)
    q = pivots.Best(0, 0, x[0].astype(np.int64), table[0], norm2[0], 10)
    scored = q.meet(np.arange(len(x)), x, table, norm2)
    assert scored < len(x) / 4
    assert q.ids.tolist() == np.lexsort((np.arange(1, len(x)), -(x[1:] @ x[0])))[:10].__add__(1).tolist()

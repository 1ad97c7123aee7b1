"""Retrieval by the index is the full scan's, and on series of recurring shapes it looks at few windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import pattern_index as ix, patterns as pat

LENGTH, WEIGHTS, CAPS = 8, {"price": 0.6, "volume": 0.3, "delta": 0.1}, {"price": 1.0, "volume": 1.0, "delta": 3.0}


@pytest.fixture(scope="module")
def windows(spark):
    """Bars that repeat one of a few shapes of eight bars with small noise, and some that follow none."""
    rng = np.random.default_rng(2)
    shapes = rng.uniform(0.2, 3, (12, LENGTH, 4))
    rows = []
    for name in ("a", "b"):
        price, t = 100.0, pd.Timestamp("2024-01-01")
        for _ in range(250):
            shape = shapes[rng.integers(12)] if rng.random() < 0.9 else rng.uniform(0.2, 3, (LENGTH, 4))
            for body, up, down, size in (shape * rng.uniform(0.98, 1.02, shape.shape)).tolist():
                close = price + body * (1 if size > 1.5 else -1)
                rows.append((name, "1m", t.to_pydatetime(), price, max(price, close) + up, min(price, close) - down, close, size * 10, (size - 1) * 5))
                price, t = close, t + pd.Timedelta(minutes=1)
    bars = spark.createDataFrame(rows, "instrument string, timeframe string, time timestamp_ntz, open double, high double, low double, close double, volume double, delta double")
    return pat.windows(bars, LENGTH)


def rows(df):
    return [(r.instrument, r.start_index, round(r.score, 9)) for r in df.collect()]


def test_search_is_the_full_scan(windows):
    index = ix.build(windows, LENGTH, 4, 64)
    assert index.windows.count() == windows.count() == index.leaves.agg(F.sum("n")).first()[0]
    for start, n, tolerance in ((40, 10, 0.0), (777, 25, 0.9), (1503, 1, 0.0), (40, 10, 0.9999)):
        wanted = pat.reference(windows, "a", start)
        found, looked = ix.search(index, wanted, WEIGHTS, CAPS, n, tolerance)
        full = pat.similarity(windows, wanted, WEIGHTS, CAPS).where(F.col("score") >= tolerance)
        assert rows(found) == rows(pat.top(full, n))
        share = looked.first().share
        print(f"share of windows refined: {share:.3f}")
        assert share < 0.1


def test_bounds_hold(windows):
    index = ix.build(windows, LENGTH, 2, 32)
    wanted = pat.reference(windows, "b", 5)
    score = pat.similarity(index.windows, wanted, WEIGHTS, CAPS)
    own = ix._bound(index, wanted, WEIGHTS, CAPS, "means", "means")
    box = ix._bound(index, wanted, WEIGHTS, CAPS, "least", "most")
    assert score.join(index.leaves, "leaf").where((own + ix.SLACK < F.col("score")) | (box + ix.SLACK < own)).isEmpty()


def test_written_index(windows, tmp_path):
    index = ix.build(windows.where("start_index < 60"), LENGTH, 2, 8)
    index.write(str(tmp_path))
    again = ix.read(windows.sparkSession, str(tmp_path), LENGTH, 2)
    wanted = pat.reference(windows, "b", 5)
    assert rows(ix.search(again, wanted, WEIGHTS, CAPS)[0]) == rows(ix.search(index, wanted, WEIGHTS, CAPS)[0])
    none = ix.build(windows.where("false"), LENGTH, 2)
    assert rows(ix.search(none, wanted, WEIGHTS, CAPS)[0]) == []

"""One long series: what runs in blocks gives what a walk over all its rows gives."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from quantloom.operators import balances, bars as b
from quantloom.operators.rotations import rotations
from quantloom.sources.tables import SERIES, indexed

N = 20_000


@pytest.fixture(scope="module")
def series():
    """Minute bars of one instrument with pauses, and a short second one; prices walk at random and stand still at first."""
    rng = np.random.default_rng(11)
    close = 1000 + np.cumsum(rng.normal(0, 1, N)).round(2)
    close[:4] = close[0]
    high, low = close + rng.uniform(0, 1, N).round(2), close - rng.uniform(0, 1, N).round(2)
    high[:4], low[:4] = high[0], low[0]
    steps = np.where(rng.random(N) < 0.002, 500, 1)
    time = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)) for m in np.cumsum(steps)]
    one = pd.DataFrame({"instrument": "hot", "timeframe": "1m", "time": time, "open": close, "high": high, "low": low, "close": close, "volume": rng.integers(1, 50, N).astype(float), "delta": rng.integers(-9, 9, N).astype(float)})
    return pd.concat([one, one.head(40).assign(instrument="small")], ignore_index=True)


@pytest.fixture(scope="module")
def long_bars(spark, series):
    made = spark.createDataFrame(series).withColumn("time", F.col("time").cast("timestamp_ntz"))
    return spark.createDataFrame(made.repartition(4).collect(), made.schema)


def plain_rotations(p):
    out, way, last = [], None, None
    for k, r in enumerate(p.itertuples()):
        if last is not None:
            own = "up" if r.high > last.high else "down" if r.low < last.low else way
            if own is not None and own != way:
                out.append([own, k - 1, k, last.close, r.close, last.volume + r.volume])
            elif own is not None:
                out[-1][2], out[-1][4] = k, r.close
                out[-1][5] += r.volume
            way = own
        last = r
    return [tuple(x) for x in out]


def plain_clusters(rows, gap_seconds, width, least):
    """Rows (start_time, end_time, start_price, end_price) in order; the cluster of each, those of too few members without one."""
    names, cluster, low, high, end = [], -1, 0.0, 0.0, None
    for start, stop, a, z in rows:
        lo, hi = min(a, z), max(a, z)
        if end is None or (start - end).total_seconds() > gap_seconds or max(hi, high) - min(lo, low) > width:
            cluster, low, high = cluster + 1, lo, hi
        else:
            low, high = min(lo, low), max(hi, high)
        end = stop
        names.append(cluster)
    sizes = pd.Series(names).value_counts()
    return [n if sizes[n] >= least else None for n in names]


def test_rotations_of_a_long_series(series, long_bars):
    got = rotations(long_bars).orderBy("rotation_index").collect()
    for name, p in series.groupby("instrument"):
        mine = [r for r in got if r.instrument == name]
        assert [r.rotation_index for r in mine] == list(range(len(mine)))
        assert [(r.direction, r.start_index, r.end_index, r.start_price, r.end_price, r.volume) for r in mine] == plain_rotations(p)


def test_whipsaws_across_blocks(long_bars):
    got = [r for r in rotations(long_bars, 0.5, 2, 3).orderBy("instrument", "rotation_index").collect()]
    for k, r in enumerate(got):
        beside = [o for o in (got[k - 1] if k else None, got[k + 1] if k + 1 < len(got) else None) if o and o.instrument == r.instrument]
        assert r.valid == (r.amplitude >= 0.5 and not (r.bar_count <= 3 and any(o.bar_count <= 3 for o in beside)))


@pytest.mark.parametrize(("gap", "width"), [(3, 8.0), (3, 40.0), (1e6, 40.0), (1e6, 0.5), (3, None), (1e6, None)])
def test_clusters_of_a_long_series(long_bars, gap, width):
    """Clusters of one, of tens and of thousands of rotations, with and without pauses."""
    made = rotations(long_bars, 0.4)
    rows = made.where("valid").orderBy("instrument", "rotation_index").collect()
    got = {(r.instrument, r.rotation_index): r.cluster for r in balances.clustered(made, gap, width, 2, 60).collect()}
    want = {}
    for name in ("hot", "small"):
        own = [r for r in rows if r.instrument == name]
        names = plain_clusters([(r.start_time, r.end_time, r.start_price, r.end_price) for r in own], gap * 60, np.inf if width is None else width, 2)
        want |= {(name, r.rotation_index): n for r, n in zip(own, names) if n is not None}
    assert got == want


@pytest.mark.parametrize("horizon", [1, 3, 12, 4096, 9000, 50_000])
def test_forward_extrema(series, long_bars, horizon):
    got = {(r.instrument, r.time): (r.next_high, r.next_low, r.next_bars) for r in b.forward_extrema(long_bars, horizon).collect()}
    assert len(got) == len(series)
    for name, p in series.groupby("instrument"):
        ahead = p[["high", "low"]].iloc[::-1].shift(1).rolling(horizon, min_periods=1)
        high, low = ahead["high"].max().iloc[::-1], ahead["low"].min().iloc[::-1]
        left = np.minimum(len(p) - 1 - np.arange(len(p)), horizon)
        for t, h, lo, n in zip(p["time"], high, low, left):
            assert got[name, t.to_pydatetime()] == ((h, lo, n) if n else (None, None, 0))


def test_frames_across_blocks(long_bars):
    w = W.partitionBy(*SERIES).orderBy("time")
    x = long_bars.withColumn("before", F.lag("close").over(w)).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before"))))
    x = x.withColumn("tra", F.when(F.col("before").isNotNull(), F.col("tr")))
    mean = F.coalesce(F.avg("tra").over(w.rowsBetween(-13, 0)), F.lit(0.0))
    x = x.withColumns({"atr": mean, "mean_volume": F.avg("volume").over(w.rowsBetween(-30, 0)), "bar_index": F.row_number().over(w) - 1})
    x = x.withColumn("atr_after", F.coalesce(F.lead("atr", 5).over(w), F.last("atr").over(w.rowsBetween(0, W.unboundedFollowing))))
    near = lambda df, *names: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("instrument", "time", *names).collect()}
    assert near(b.atr_partial(long_bars), "atr") == near(x, "atr")
    assert near(b.lead_atr(long_bars), "atr_after") == near(x, "atr_after")
    assert near(b.trailing_means(long_bars), "mean_volume") == near(x, "mean_volume")
    assert near(indexed(long_bars), "bar_index") == near(x, "bar_index")


def test_one_instrument_is_in_many_tasks(spark, long_bars):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (indexed(long_bars), b.atr_strict(long_bars), b.forward_extrema(long_bars, 10)):
            held = [r["count"] for r in df.where("instrument = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
            assert len(held) > 2 and max(held) < 0.6 * N
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

"""Small hand-computed cases, one for each rule; their numbers are those of FIXTURES.md, section C."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars
from quantloom.operators import bars as b, breakouts as bo, features as feat, levels, rotations as rot
from quantloom.plans import spec
from quantloom.sources.bar_files import read_bars, validated

BARS = "instrument string, timeframe string, time timestamp_ntz, open double, high double, low double, close double, volume double, delta double"
START = dt.datetime(2024, 1, 1)


def series(spark, rows, instrument="X"):
    """Hourly bars of (open, high, low, close)."""
    return spark.createDataFrame([(instrument, "1 hour", START + dt.timedelta(hours=i), *map(float, x), 1.0, 1.0) for i, x in enumerate(rows)], BARS)


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 4.0), (None, 6.0)], "g string, v double")


def test_metrics_count_nulls_apart(grouped):
    got = {r.g: (r.rows_total, r.rows_valid, r.result) for r in spec.run(grouped, {"metric": "mean", "value_field": "v", "group_by": ["g"]}).collect()}
    assert got == {"a": (3, 2, 1.5), "b": (1, 1, 4.0), None: (1, 1, 6.0)}
    std = {r.g: r.result for r in spec.run(grouped, {"metric": "std", "value_field": "v", "group_by": ["g"]}).collect()}
    assert std == {"a": 0.5, "b": 0.0, None: 0.0}


def test_unequal_leaves_out_null(grouped):
    q = {"metric": "count", "filters": [{"field": "v", "operator": "!=", "value": 1}]}
    assert spec.run(grouped, q).first().result == 3


def test_probability(spark):
    df = spark.createDataFrame([(True, True), (True, False), (True, None), (False, True), (None, True)], "c boolean, e boolean")
    is_true = lambda name: {"field": name, "operator": "==", "value": True}
    r = spec.run(df, {"metric": "probability", "event_predicate": is_true("e"), "condition_predicate": is_true("c")}).first()
    assert (r.rows_total, r.rows_valid, r.condition_count, r.event_and_condition_count, r.result) == (5, 4, 2, 1, 0.5)


def test_ranking_ties_follow_the_label(spark):
    df = spark.createDataFrame([(2, 1.0), (10, 1.0)], "hour int, v double")
    got = spec.run(df, {"metric": "ranking", "score_metric": "mean", "value_field": "v", "group_by": ["hour"], "sort_direction": "desc"})
    assert [r.hour for r in got.orderBy("rank").collect()] == [10, 2]


def test_bad_specs_are_refused(grouped):
    for bad in ({"metric": "nothing"}, {"metric": "mean"}, {"metric": "mean", "value_field": "absent"}, {"metric": "ranking", "score_metric": "mean", "value_field": "v", "group_by": []}):
        with pytest.raises(ValueError):
            spec.run(grouped, bad)


HIGH_LOW = [(9, 10, 8, 9), (9, 11, 9, 10), (9, 11, 9, 10), (9, 10, 7, 8), (8, 12, 6, 11)]


def test_rotations_and_whipsaw(spark):
    got = rot.rotations(series(spark, HIGH_LOW), whipsaw_bars=2).orderBy("rotation_index").collect()
    assert [(r.direction, r.start_index, r.end_index, r.bar_count, r.valid) for r in got] == [("up", 0, 2, 3, True), ("down", 2, 3, 2, False), ("up", 3, 4, 2, False)]


def test_half_even_bins(spark):
    assert spark.range(1).select(scalars.half_even_bin(F.lit(2.5), 1.0)).first()[0] == 2.0


def test_value_area(spark):
    profile = spark.createDataFrame([("k", 10.0, 5.0), ("k", 11.0, 20.0), ("k", 12.0, 20.0), ("k", 13.0, 5.0)], "k string, price double, volume double")
    r = levels.value_area(profile, ["k"]).first()
    assert (r.poc, r.val, r.vah) == (11.0, 11.0, 12.0)


def test_follow_through_and_class(spark):
    closes = [95, 100, 101, 102, 105, 99, 107]
    bars = series(spark, [(x, x, x, x) for x in closes])
    ranges = spark.createDataFrame([("X", "1 hour", "r", 100.0, 90.0, 1)], "instrument string, timeframe string, range_id string, high double, low double, end_index int")
    r = bo.classified(bo.follow_through(bo.breakouts(bars, ranges, "close_only"), bars)).first()
    assert (r.bar_index, r.max_excursion, r.max_excursion_bars, r.retracement_depth, r.retracement_bars) == (2, 7.0, 3, 8.0, 2)
    assert (r.time_to_retest_boundary, r.failure_bars_from_breakout, r.post_breakout_volatility) == (2, 2, 4.25)
    assert (r.breakout_type, r.is_failed) == ("false_breakout", True)


def test_half_of_a_body_outside(spark):
    rows = spark.createDataFrame([(98.0, 105.0, 97.0, 104.0)], "open double, high double, low double, close double")
    assert rows.select(bo.leaves("body_50", F.lit(100.0), F.lit(90.0))).first()[0] == "up"


def test_buckets_of_atr(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (2.5,), (None,)], "atr_before double")
    assert [r.atr_bucket for r in feat.bucketed(df, "atr_bucket").collect()] == [None, "atr_0_5_1_0", "atr_2_5_plus", None]


def test_primary_target(spark):
    df = spark.createDataFrame([(2.0, 2.0), (1.0, 2.0), (None, 2.0), (5.0, 0.0)], "max_excursion double, atr_before double")
    assert [r.target_primary for r in feat.primary_target(df, 1.0).collect()] == [True, False, False, None]


def test_strict_atr_needs_a_whole_window(spark):
    got = [r.atr for r in b.atr_strict(series(spark, [(1, 2, 1, 2)] * 14)).orderBy("time").collect()]
    assert got[:13] == [None] * 13 and got[13] is not None


def test_overnight_session(spark):
    inside = spark.createDataFrame([(4 * 60,), (12 * 60,), (23 * 60,)], "m int").select(levels.in_session(F.col("m"), 22 * 60, 5 * 60)).collect()
    assert [r[0] for r in inside] == [True, False, True]


def test_payload(spark):
    df = spark.createDataFrame([("{'max_excursion': 7.5, 'failure_price': None}",), ("not a payload",), (None,)], "p string")
    got = df.select(scalars.payload(F.col("p"), "max_excursion double, failure_price double")["max_excursion"]).collect()
    assert [r[0] for r in got] == [7.5, None, None]


def test_bar_files(spark, tmp_path):
    folder = tmp_path / "X" / "5m" / "data"
    folder.parent.mkdir(parents=True)
    text = "﻿Name;Index;DateTime;High;Low;Open;Close;BidVolume;AskVolume\nX;0;02/01/2024 10:00:00;11,5;9;10;11;3;5\nX;1;02/01/2024 10:05:00;12;10;11;11,25;4;1\n"
    (tmp_path / "X" / "5m" / "data_2024.txt").write_text(text, encoding="utf-8")
    got = validated(read_bars(spark, str(tmp_path), "X", "5m", dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31))).orderBy("time").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.delta) for r in got] == [(10.0, 11.5, 9.0, 11.0, 8.0, 2.0), (11.0, 12.0, 10.0, 11.25, 5.0, -3.0)]

"""Scans, validators and sinks: round trips through small files."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars
from quantloom.operators import balances, breakouts as bo, dashboards as dash, levels
from quantloom.plans import detection
from quantloom.sources import bar_files, event_files as ev, exports
from quantloom.sources.stash import stash
from quantloom.sources.tables import bars

SMALL = "/root/testdata/sf0.001"
RANGE = dt.datetime(2023, 1, 1), dt.datetime(2024, 12, 31)
HEADER = "Name;Index;DateTime;High;Low;Open;Close;BidVolume;AskVolume"


@pytest.fixture
def bar_root(tmp_path):
    folder = tmp_path / "X" / "5m"
    folder.mkdir(parents=True)
    (folder / "data_2023.txt").write_text(f"{HEADER}\nX;1;31/12/2023 10:00:00;2,5;1;1,5;2;3;4\n\n{HEADER}\nX;2;31/12/2023 10:05:00;3;1;2;3;1;1\n", "utf-8")
    (folder / "data_2024.txt").write_text(f"{HEADER}\nX;1;02/01/2024 10:00:00;4;1;1,5;2;;4\nX;2;no time;4;1;1;2;1;1\nX;3;03/01/2024 10:00:00;bad;1;1;2;1;1\n", "utf-8")
    return str(tmp_path)


def test_bars_by_position_and_by_name(spark, bar_root):
    one = bar_files.read_bars(spark, bar_root, "X", "5m", dt.datetime(2023, 1, 1), dt.datetime(2023, 12, 31, 10, 0))
    assert [(r.open, r.high, r.low, r.close, r.volume, r.delta) for r in one.collect()] == [(1.5, 2.5, 1.0, 2.0, 7.0, 1.0)]
    named = bar_files.read_named_bars(spark, bar_root, "X", "5m", *RANGE).orderBy("time").collect()
    assert [(r.time.year, r.high, r.volume, r.delta) for r in named] == [(2023, 2.5, 7.0, 1.0), (2023, 3.0, 2.0, 0.0), (2024, 4.0, 4.0, 4.0), (2024, None, 2.0, 0.0)]
    with pytest.raises(FileNotFoundError):
        bar_files.read_named_bars(spark, bar_root, "X", "5m", dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1))


def test_other_timeframes_and_sources(spark, bar_root):
    source = bar_files.TextBars(spark, bar_root)
    dataset = {"instrument": "X", "timeframe": "1h", "start": dt.datetime(2023, 1, 1), "end": dt.datetime(2023, 12, 31, 23)}
    assert bar_files.at_timeframe(source, dataset, "5m").count() == 2
    with pytest.raises(ValueError):
        bar_files.at_timeframe(source, dataset, "5x")
    central = bar_files.CentralBars(lambda config: spark.createDataFrame([(config["instrument"], config["source"])], "i string, s string"), {"source": "s", "version": 1})
    assert tuple(central.fetch("Y", "5m", *RANGE).first()) == ("Y", "s")
    with pytest.raises(ValueError):
        bar_files.CentralBars(lambda config: None, {"source": "s"})


def test_events_round_trip(spark, tmp_path):
    events = stash(detection.whole_chain(spark, SMALL))
    path = f"{tmp_path}/out"
    exports.write_events(events, path)
    back = ev.read_csv(spark, f"{path}/events")
    assert back.count() == events.count() > 0
    assert [r.breakout_time for r in back.orderBy("breakout_time").collect()] == sorted(r.breakout_time for r in back.collect())
    ev.check_version(back)
    assert tuple(events.columns) == ev.EVENT_COLUMNS
    ev.check_columns(back)
    with pytest.raises(ValueError):
        ev.check_columns(back.drop("rotation_context"))
    manifest = json.loads(Path(f"{path}/manifest.json").read_text())
    assert manifest["rows"] == back.count() and manifest["schema_version"] == "1.1.0"
    narrow = ev.narrowed(back)
    assert narrow.columns[: len(ev.REQUIRED)] == list(ev.REQUIRED)
    want = {r.breakout_id: r.follow_through.max_excursion for r in events.collect()}
    assert {r.breakout_id: pytest.approx(r.max_excursion) for r in narrow.collect()} == want
    assert {r.breakout_id: pytest.approx(r.max_excursion) for r in ev.narrowed(events).collect()} == want
    with pytest.raises(ValueError, match="direction"):
        ev.narrowed(back.withColumn("direction", F.when(F.col("breakout_bar_index") != back.first().breakout_bar_index, F.col("direction"))))
    with pytest.raises(ValueError):
        ev.check_version(back.withColumn("schema_version", F.lit("1.0")))


def test_json_events_and_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"breakouts": [{"breakout_id": "b1", "follow_through": {"max_excursion": 1.5}}, {"breakout_id": "b2", "follow_through": None}]}))
    assert [r.breakout_id for r in ev.read_events(spark, f"{tmp_path}/a.json").collect()] == ["b1", "b2"]
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "e.csv").write_text("breakout_id,x\n")
    for bad in ("b.json", "e.csv"):
        with pytest.raises(ValueError):
            ev.read_events(spark, f"{tmp_path}/{bad}")
    found = levels.session_levels(bars(spark, SMALL), bin_size=25.0)
    exports.write_levels(found, f"{tmp_path}/levels")
    back = ev.read_levels(spark, f"{tmp_path}/levels")
    key = lambda r: (r.instrument.upper(), str(r.date), r.session_name, round(r.session_high, 6))
    assert sorted(map(key, back.collect())) == sorted(map(key, found.collect()))
    exports.write_bars(bars(spark, SMALL), f"{tmp_path}/bars")
    assert ev.read_csv(spark, f"{tmp_path}/bars").count() == bars(spark, SMALL).count()
    exports.write_master(found, f"{tmp_path}/master")
    assert Path(f"{tmp_path}/master/summary.txt").read_text().startswith(f"rows: {found.count()}\n")


def test_pattern_runs(spark, tmp_path):
    matches = spark.createDataFrame([("X", "1h", dt.datetime(2024, 1, 2), 0.9), ("X", "1h", dt.datetime(2024, 1, 1), 0.7)], "instrument string, timeframe string, start_time timestamp_ntz, score double")
    name = scalars.short_id("pat_", {"length": 3, "x": float("nan")})
    assert name == scalars.short_id("pat_", {"x": None, "length": 3}) and len(name) == 20
    stats = exports.pattern_stats(matches, name, 3)
    assert tuple(stats.first()) == (name, 3, 2, 0.9)
    one = bars(spark, SMALL).limit(5)
    for k in range(2):
        exports.write_pattern_run(matches.repartition(k + 1), stats, one, {"b": 1, "a": 2}, f"{tmp_path}/run{k}", parquet=True)
    assert Path(f"{tmp_path}/run0/config.json").read_text() == '{"a":2,"b":1}'
    assert json.loads(Path(f"{tmp_path}/run0/manifest.json").read_text())["matches"] == json.loads(Path(f"{tmp_path}/run1/manifest.json").read_text())["matches"]
    none = matches.limit(0)
    exports.write_pattern_run(none, exports.pattern_stats(none, name, 3), one, {}, f"{tmp_path}/hand", manual=True)
    for bad in (none, matches.union(matches.withColumn("instrument", F.lit("Y")))):
        with pytest.raises(ValueError):
            exports.write_pattern_run(bad, stats, one, {}, f"{tmp_path}/bad")


def test_reports_and_checks(spark, tmp_path):
    report = {"meta": {}, "summary": {"x": float("inf")}, "insights": [{"type": "scalar", "metric_value": 1, "rows_valid": 5, "class": "B", "severity": 0.2}]}
    exports.check_findings(report)
    exports.write_report(spark, f"{tmp_path}/report.json", report)
    assert json.loads(Path(f"{tmp_path}/report.json").read_text())["summary"] == {"x": None}
    for bad in ({"meta": {}}, {**report, "insights": [{}]}, {**report, "meta": []}):
        with pytest.raises(ValueError):
            exports.check_findings(bad)
    ev.check_rising({"a": [1, 2, 3]})
    with pytest.raises(ValueError):
        ev.check_rising({"a": [1, 2, 2]})
    df = spark.createDataFrame([("x", 1, True)], "s string, n int, b boolean")
    ev.check_categorical(df, "s")
    for name in ("n", "b", "absent"):
        with pytest.raises(ValueError):
            ev.check_categorical(df, name)


def test_text_becomes_typed(spark):
    df = spark.createDataFrame([("1", "True", "", "0.10", 'say "no"\n')], "a string, b string, c string, d string, e string")
    assert json.loads(exports.as_json_rows(df).first()[0]) == {"a": 1, "b": True, "c": None, "d": "0.10", "e": 'say "no"\n'}
    got = df.select(scalars.number(F.lit("1,5")), scalars.number(F.lit("x")), scalars.number(F.lit("NaN")), scalars.moment(F.lit("31/12/2024 10:00:00")), scalars.moment(F.lit("2024"))).first()
    assert tuple(got) == (1.5, None, None, dt.datetime(2024, 12, 31, 10), None)
    assert scalars.end_of_day("2024-02-29") == dt.datetime(2024, 2, 29, 23, 59, 59)


def test_targets_and_previews(spark):
    assert dash.target_columns(["t1", "t1_0_5ATR", "t2_10ticks", "t2_clean_10ticks", "is_clean_quant", "tx", "t1_5"]) == {"clean_quant": ["is_clean_quant"], "clean_tick": ["t2_clean_10ticks"], "atr_scan": ["t1_0_5ATR"], "tick_scan": ["t2_10ticks"], "direct": ["t1"]}
    df = spark.createDataFrame([(str(k), k, [k]) for k in range(200)], "z string, direction long, nested array<long>")
    assert dash.preview(df).columns == ["direction", "z"] and dash.preview(df).count() == 100


def test_month_before_and_filters(spark):
    rows = [("X", "1 hour", dt.datetime(2024, m, 5, 10), 1.0, float(m), 0.5, 1.0, 2.0, 0.0) for m in (1, 2, 4)]
    data = spark.createDataFrame(rows, "instrument string, timeframe string, time timestamp_ntz, open double, high double, low double, close double, volume double, delta double")
    assert [(r.date, r.prev_month_high, r.prev_month_vwap) for r in levels.previous_period(data, "month").collect()] == [(dt.date(2024, 2, 5), 1.0, 1.0)]
    matches = data.select(F.col("time").alias("start_time"), (F.col("high") / 10).alias("score"))
    assert dash.match_filters(matches, "2024-01-05", "2024-02-05", "09:00", "10:00", 0.15).count() == 1
    assert dash.match_filters(matches, to_clock="09:59").count() == 0 and dash.match_filters(matches).count() == 3


def test_low_volume_level_makes_the_sixth_score(spark):
    """An event at a low-volume level beyond the middle scores 1, one whose levels lie elsewhere 0; a range at the filter's border
    loses its share, one that is too restless is told so."""
    rows = [("X", "1 hour", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), 10.0, 11.0, 9.0, 10.0 + k / 10, 2.0, 1.0) for k in range(6)]
    data = spark.createDataFrame(rows, "instrument string, timeframe string, time timestamp_ntz, open double, high double, low double, close double, volume double, delta double")
    events = spark.createDataFrame([("X", "1 hour", n, 5, 10.4, 8.0, 10.5, "up", 2.0, 1.0, lvn, ratio, 1 / (1 + ratio)) for n, lvn, ratio in (("a", [10.3, 8.1], 0.6), ("b", [8.1], 0.52), ("c", [], 0.3))], "instrument string, timeframe string, range_id string, bar_index long, range_high double, range_low double, breakout_price double, direction string, initial_volume double, initial_delta double, lvn array<double>, compression_ratio double, stability_score double")
    got = {r.range_id: r for r in bo.strength(events, data).collect()}
    assert [got[k].hvn_lvn_break_score for k in "abc"] == [1.0, 0.0, 0.0]
    assert [got[k].volatility_filter_pass for k in "abc"] == [True, True, False]
    assert got["b"].volatility_score == pytest.approx(0.7 * got["a"].volatility_score)
    assert got["a"].overall_strength_score == pytest.approx(got["c"].overall_strength_score + 0.7)


def test_a_bar_alone_is_calm(spark):
    data = spark.createDataFrame([("X", "1 hour", 0, dt.datetime(2024, 1, 1), 2.0, 1.0, 1.5, 3.0)], "instrument string, timeframe string, cluster int, time timestamp_ntz, high double, low double, close double, volume double")
    r = balances.volatility(data, balances.KEYS).first()
    assert (r.internal_atr, r.internal_volatility, r.compression_ratio, r.stability_score) == (0.0, 0.0, 0.0, 0.0)

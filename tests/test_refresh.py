"""Levels that are written again for some dates, by hand and from a stream, and bar files as a data source."""

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.operators.levels import session_levels
from quantloom.sources import bar_files, event_files as ev, exports
from quantloom.sources.bar_source import BarFiles
from quantloom.sources.tables import bars, ticks
from quantloom.streaming import closed_bars
from quantloom.streaming.levels import affected, levels_of_stream, refresh, refreshed

SMALL = "/root/testdata/sf0.001"


def near(df):
    rows = df.select(sorted(df.columns)).collect()
    return sorted(str(tuple(round(x, 5) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def long_bars(spark):
    """Two copies of the bars, the second three months on, so that many dates are far from a changed one."""
    one = bars(spark, SMALL)
    both = one.unionByName(one.withColumn("time", (F.col("time") + F.expr("interval 90 days")).cast("timestamp_ntz")))
    return spark.createDataFrame(both.collect(), both.schema)


def test_one_new_day(spark, long_bars, tmp_path):
    days = sorted(r[0] for r in long_bars.select(F.to_date("time")).distinct().collect())
    new = days[-1]
    path = str(tmp_path / "levels")
    exports.write_levels(session_levels(long_bars.where(F.to_date("time") < F.lit(new)), bin_size=25.0), path)
    before = {p: p.stat().st_mtime_ns for p in Path(path).glob("date=*/*.csv")}
    time.sleep(0.05)
    refresh(long_bars, [new], path, 25.0)
    want = session_levels(long_bars, bin_size=25.0)
    assert near(ev.read_levels(spark, path)) == near(want.withColumn("instrument", F.upper("instrument")))
    kept = {p.parent.name for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert kept == {f"date={d}" for d in days if d not in affected([new])} and kept


def test_refreshed_rows_are_those_of_a_full_run(long_bars):
    full = session_levels(long_bars, bin_size=25.0)
    for day in (dt.date(2024, 1, 1), dt.date(2024, 1, 31), dt.date(2024, 4, 14)):
        mine = [d for d in affected([day])]
        assert near(refreshed(long_bars, [day], 25.0)) == near(full.where(F.col("date").isin(mine)))


def test_levels_of_a_stream(spark, tmp_path):
    source, store, path = (str(tmp_path / x) for x in ("ticks", "bars", "levels"))
    given = ticks(spark, SMALL)
    first, last = given.agg(F.min("time"), F.max("time")).first()
    for k in range(3):  # a file after the other, in order of time
        part = F.least(F.floor((F.unix_micros(F.col("time").cast("timestamp")) - F.lit(int(first.replace(tzinfo=dt.UTC).timestamp() * 1e6))) / F.lit((last - first).total_seconds() / 3 * 1e6)), F.lit(2))
        given.where(part == k).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = levels_of_stream(closed_bars(stream), store, path, 25.0)
    query = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert query.awaitTermination(300) and query.exception() is None
    closed = spark.read.parquet(store).drop("batch")
    last = closed.agg(F.max(F.to_date("time"))).first()[0]
    got = ev.read_levels(spark, path)
    assert near(got) == near(session_levels(closed, bin_size=25.0).withColumn("instrument", F.upper("instrument")))
    full = session_levels(bars(spark, SMALL), bin_size=25.0).withColumn("instrument", F.upper("instrument"))
    own = [c for c in full.columns if c.startswith(("session_", "day_", "prev_day_")) or c in ("instrument", "date")]
    days = closed.where(F.to_date("time") < F.lit(last)).select(F.to_date("time").alias("date")).distinct()
    assert near(got.select(own).join(days, "date", "left_semi")) == near(full.select(own).join(days, "date", "left_semi"))


HEADS = ("Name;Index;DateTime;High;Low;Open;Close;BidVolume;AskVolume", "DateTime;Open;High;Low;Close;AskVolume;BidVolume;Other")


@pytest.fixture
def folder(tmp_path):
    """Two years whose headers differ in order, decimal commas, blank lines, repeated headers and values that are none."""
    at = tmp_path / "X" / "5m"
    at.mkdir(parents=True)
    first = [HEADS[0], *(f"X;{k};{1 + k % 28:02d}/0{1 + k // 28}/2023 10:00:00;{k},5;{k}.25;{k};{k}.4;3;4" for k in range(200)), "", HEADS[0], "X;1;not a time;1;1;1;1;1;1"]
    second = ["﻿" + HEADS[1], *(f"{1 + k % 28:02d}/0{1 + k // 28}/2024 10:05:00;{k};{k},5;{k}.25;{'?' if k == 7 else k};{'' if k == 9 else 4};3;z" for k in range(150))]
    (at / "data_2023.txt").write_text("\n".join(first) + "\n")
    (at / "data_2024.txt").write_text("\n".join(second))
    return str(tmp_path)


def test_bar_source(spark, folder):
    spark.dataSource.register(BarFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    want = bar_files.read_named_bars(spark, folder, "X", "5m", dt.datetime(2023, 1, 1), dt.datetime(2024, 12, 31))
    assert want.count() == 350
    for split in (1 << 20, 997, 64):
        read = spark.read.format("bar_files").options(root=folder, instrument="X", timeframe="5m", split=split).load()
        assert near(read) == near(want)
    assert read.rdd.getNumPartitions() > 100
    pruned = spark.read.format("bar_files").options(root=folder, instrument="X", timeframe="5m").load().where("time >= timestamp_ntz'2024-01-03 00:00:00'")
    assert near(pruned) == near(want.where("time >= timestamp_ntz'2024-01-03 00:00:00'"))
    assert pruned.rdd.getNumPartitions() == 1


def test_a_large_csv_is_split(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(40_000).selectExpr("id", "repeat('x, \"y\";', 20) as text").coalesce(1).write.options(header=True, escape='"').csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        split = ev.read_csv(spark, path, spans_lines=False)
        assert split.rdd.getNumPartitions() > 3 and ev.read_csv(spark, path).rdd.getNumPartitions() == 1
        assert split.count() == 40_000 and split.where("text <> repeat('x, \"y\";', 20)").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

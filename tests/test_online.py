"""Rotations and clusters on a stream are those of the batch operators, after a restart and with late ticks too."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators.balances import clustered
from quantloom.operators.rotations import rotations
from quantloom.sources.tables import bars_from_ticks, ticks
from quantloom.streaming import closed_bars
from quantloom.streaming.online import online_clusters, online_rotations, with_state_store

SMALL = "/root/testdata/sf0.01"
GAP, WIDTH = 6, 300.0


def near(df):
    """Rows with rounded numbers: sums that are taken in parts differ in their last bits."""
    rows = df.select(sorted(df.columns)).collect()
    return {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows}


def parts(spark, folder):
    """The ticks in four files; a quarter of an hour's ticks of each hour come a file late. The last file's one tick moves the clock."""
    all_ticks = ticks(spark, SMALL)
    bounds = all_ticks.agg(F.min("time"), F.max("time")).first()
    third = (bounds[1] - bounds[0]) / 3
    number = sum((F.col("time") > F.lit(bounds[0] + third * k)).cast("int") for k in (1, 2))
    late = (F.minute("time") >= 45) & (F.hour("time") == 0)
    cut = all_ticks.withColumn("part", F.least(number + late.cast("int"), F.lit(2)))
    for k in range(3):
        cut.where(f"part = {k}").drop("part").coalesce(1).write.parquet(f"{folder}/{k}")
    clock = all_ticks.limit(1).withColumns({"instrument": F.lit("clock"), "time": F.lit(bounds[1]) + F.expr("interval 400 days")})
    clock.coalesce(1).write.parquet(f"{folder}/3")
    return all_ticks


def run(spark, tmp_path, make, name, given):
    """A query that is stopped after each file and started again from its checkpoint."""
    source, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    schema = spark.read.parquet(f"{given}/0").schema
    for k in range(4):
        spark.read.parquet(f"{given}/{k}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = make(stream).writeStream.format("parquet").option("path", out).outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).start()
        assert query.awaitTermination(300)
        assert query.exception() is None
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.fixture(scope="module")
def given(store, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ticks"))
    return folder, bars_from_ticks(parts(store, folder))


def test_rotations(store, tmp_path, given):
    folder, bars = given
    late = "60 days"  # the parts are as long as that: no tick is too late
    got = run(store, tmp_path, lambda t: online_rotations(closed_bars(t, late=late, watermarked=True), 2.0, 2, 3, silence=86400 * 100), "rotations", folder)
    want = rotations(bars, 2.0, 2, 3)
    assert near(got.where("instrument <> 'clock'")) == near(want) and want.where("not valid").count() > 5


def test_clusters(store, tmp_path, given):
    folder, bars = given
    make = lambda t: online_clusters(closed_bars(t, late="60 days", watermarked=True), GAP, WIDTH, 2, 3600, 2.0, silence=86400 * 100)
    got = run(store, tmp_path, make, "clusters", folder)
    want = clustered(rotations(bars, 2.0), GAP, WIDTH, 2, 3600)
    assert near(got) == near(want) and want.select("cluster").distinct().count() > 5


def test_what_is_open_waits(store, tmp_path, given):
    """Without silence the last rotation of a series is not told."""
    folder, bars = given
    got = run(store, tmp_path, lambda t: online_rotations(closed_bars(t, late="60 days")), "open", folder)
    want = rotations(bars)
    last = want.groupBy("instrument").agg(F.max("rotation_index").alias("rotation_index"))
    assert near(got.where("instrument <> 'clock'")) == near(want.join(last, ["instrument", "rotation_index"], "left_anti"))

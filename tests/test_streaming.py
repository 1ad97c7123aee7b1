"""Streams give what the batch operators give, for the bars that the watermark has closed."""

from pyspark.sql import functions as F

from quantloom.sources.tables import bars, ticks
from quantloom.streaming import closed_bars, sessions_of_activity

SMALL = "/root/testdata/sf0.01"


def streamed(spark, tmp_path, make, name):
    source = str(tmp_path / "ticks")
    ticks(spark, SMALL).repartitionByRange(3, "time").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 3).parquet(source)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(300)
    return spark.table(name)


def test_closed_bars(spark, tmp_path):
    near = lambda rows: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows}  # noqa: E731  (sums of parts differ in their last bits)
    got = near(streamed(spark, tmp_path, closed_bars, "closed_bars").drop("timeframe").collect())
    expected = near(bars(spark, SMALL).drop("timeframe").collect())
    assert got and got <= expected
    assert {r[:2] for r in expected - got} <= {r[:2] for r in sorted(expected, key=lambda r: r[1])[-40:]}  # the last are open


def test_spells_of_activity(spark, tmp_path):
    got = streamed(spark, tmp_path, sessions_of_activity, "spells")
    assert got.where(F.col("end") <= F.col("start")).isEmpty() and got.count() > 0

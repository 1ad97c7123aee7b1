"""Early signs on streams are those of the batch operator."""

import datetime as dt

from pyspark.sql import functions as F

from quantloom.operators.breakouts import early_signs
from quantloom.plans.catalog import events, ranges
from quantloom.sources.tables import bars
from quantloom.streaming.early import early_signs_of_stream

SMALL = "/root/testdata/sf0.01"


def test_early_signs(spark, tmp_path):
    found = events(spark, SMALL).join(ranges(spark, SMALL).select("range_id", "start_time"), "range_id")
    lower = bars(spark, SMALL, "15 minutes").select("instrument", "time", "close")
    far = dt.datetime(2030, 1, 1)
    clock_event = spark.createDataFrame([("clock", "clock_x", "up", 1.0, far, far)], "instrument string, range_id string, direction string, boundary_price double, breakout_time timestamp_ntz, start_time timestamp_ntz")
    clock_bar = spark.createDataFrame([("clock", far, 0.0)], "instrument string, time timestamp_ntz, close double")
    e_path, b_path, out = (str(tmp_path / x) for x in ("events", "lower", "out"))
    columns = clock_event.columns
    times = sorted(r.breakout_time for r in found.collect())
    middle = times[len(times) // 2]
    halves = [lambda df, t: df.where(F.col(t) <= F.lit(middle)), lambda df, t: df.where(F.col(t) > F.lit(middle))]
    for half, clock in ((halves[0], False), (halves[1], False), (None, True)):
        e, b = (clock_event, clock_bar) if clock else (half(found, "breakout_time"), half(lower, "time"))
        e.select(columns).coalesce(1).write.mode("append").parquet(e_path)
        b.coalesce(1).write.mode("append").parquet(b_path)
        read = lambda path, like: spark.readStream.schema(like.schema).parquet(path)
        made = early_signs_of_stream(read(e_path, clock_event), read(b_path, clock_bar), "start_time", "3 days", min_run=2, max_lead_minutes=180)
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(300) and query.exception() is None
    rows = lambda df: sorted((r.instrument, r.range_id, str(r.breakout_time), str(r.early_time), round(r.early_price, 6), round(r.lead_minutes, 6)) for r in df.collect())
    want = early_signs(found, lower, "start_time", 2, max_lead_minutes=180)
    assert rows(spark.read.parquet(out)) == rows(want) and want.count() > 5
    state = query.recentProgress[-1]["stateOperators"]
    assert sum(s["numRowsTotal"] for s in state) <= 4  # the clocks alone

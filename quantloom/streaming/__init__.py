"""The batch operators on streams. A bar is final once the watermark has passed its end, so only closed bars are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import TimestampType


def timed(ticks: DataFrame, late: str) -> DataFrame:
    """Ticks with a watermark, which needs an instant: a time without zone is read in the session's zone (set it to UTC)."""
    return ticks.withColumn("time", F.col("time").cast(TimestampType())).withWatermark("time", late)


def closed_bars(ticks: DataFrame, timeframe: str = "1 hour", late: str = "10 minutes", watermarked: bool = False) -> DataFrame:
    """Bars of a stream of ticks (instrument, time, price, size, side, seq); later ticks than the watermark are dropped.

    With `watermarked` a column closed_at, the end of the bar, carries the watermark on to operators with timers."""
    order, kind = F.struct("time", "seq"), ticks.schema["time"].dataType
    windowed = timed(ticks, late).groupBy(F.window("time", timeframe), "instrument")
    made = windowed.agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
        F.sum(F.col("size") * F.col("side")).alias("delta"),
    )
    columns = ["instrument", F.lit(timeframe).alias("timeframe"), F.col("window.start").cast(kind).alias("time"), "open", "high", "low", "close", "volume", "delta"]
    return made.select(*columns, F.window_time("window").alias("closed_at")) if watermarked else made.select(*columns)


def sessions_of_activity(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Spells of ticks without a pause longer than the gap."""
    kind = ticks.schema["time"].dataType
    grouped = timed(ticks, late).groupBy("instrument", F.session_window("time", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("ticks"), F.sum("size").alias("volume")).select("instrument", F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "ticks", "volume")

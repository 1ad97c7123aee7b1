"""The domain's inputs as views of event and fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scans import numbered

SERIES = ["instrument", "timeframe"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_ticks(ticks: DataFrame, timeframe: str = "1 hour") -> DataFrame:
    """Bars of ticks (instrument, time, price, size, side, seq): one aggregation, partial before its shuffle.

    Open and close are the first and last price by (time, seq); delta is the size bought minus the size sold.
    """
    order = F.struct("time", "seq")
    start = F.window("time", timeframe)["start"]
    return (
        ticks.groupBy("instrument", start.alias("start"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            F.sum(F.col("size") * F.col("side")).alias("delta"),
        )
        .select("instrument", F.lit(timeframe).alias("timeframe"), F.col("start").alias("time"), "open", "high", "low", "close", "volume", "delta")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as ticks: the type is the instrument, even ids are bought and odd ones sold."""
    side = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), F.col("ts").alias("time"), F.col("value").alias("price"), F.col("value").alias("size"), side.alias("side"), F.col("event_id").alias("seq"))


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1 hour") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), timeframe)


def indexed(df: DataFrame) -> DataFrame:
    """Bars with their place in their series, from 0. Days are counted apart, so a series is no single task."""
    return numbered(df, SERIES, "time", "bar_index", F.to_date("time"))


def placed(df: DataFrame) -> DataFrame:
    """The same, where the bars have no place yet."""
    return df if "bar_index" in df.columns else indexed(df)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row like a breakout event for each order line: what the metric and feature queries run on at scale."""
    c = F.col
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("breakout_id"),
        F.when(c("l_linenumber") == 7, None).when(c("l_linestatus") == "O", "up").otherwise("down").alias("direction"),
        F.when(c("l_returnflag") == "R", "false_breakout").when(c("l_returnflag") == "A", "failed_follow_through").when(c("l_linenumber") % 2 == 0, "clean").alias("breakout_type"),
        (c("l_returnflag") == "R").alias("is_failed"),
        c("l_quantity").alias("balance_range_size"),
        F.round(c("l_discount") * 30, 2).alias("atr_before"),
        F.round(c("l_extendedprice") / 100, 4).alias("breakout_price"),
        F.round(c("l_extendedprice") / 100 - c("l_quantity") / 2, 4).alias("balance_midpoint"),
        F.round(c("l_extendedprice") / 50 - 600, 4).alias("initial_delta"),
        (c("l_quantity") * 20).alias("initial_volume"),
        F.when(c("l_linenumber") == 5, None).otherwise(F.round(c("l_tax") * 50 + c("l_linenumber"), 2)).alias("max_excursion"),
        F.round(c("l_discount") * 20 + c("l_linenumber") / 2, 2).alias("retracement_depth"),
        c("l_linenumber").cast("long").alias("total_score"),
        F.col("l_shipdate").alias("breakout_time"),
    )

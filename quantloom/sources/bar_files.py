"""Bar files: semicolon text by instrument, timeframe and year; validators; a pluggable source of bars."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import known, moment, number

#: The file's columns in their order.
COLUMNS = "name string, number string, stamp string, high string, low string, open string, close string, bid string, ask string"
UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
REQUIRED = ("open", "high", "low", "close", "volume")


class BarsSource(Protocol):
    """Whatever gives bars of an instrument and timeframe between two times, both included."""

    def fetch(self, instrument: str, timeframe: str, start: datetime, end: datetime) -> DataFrame: ...


def timeframe_text(timeframe: str) -> str:
    """'5m' as '5 minutes'."""
    m = re.fullmatch(r"(\d+)([smhd])", timeframe.strip().lower())
    if not m or int(m[1]) <= 0:
        raise ValueError(f"not a timeframe: {timeframe!r}")
    return f"{int(m[1])} {UNITS[m[2]]}"


def year_files(spark: SparkSession, root: str, instrument: str, timeframe: str, start: datetime, end: datetime) -> list[str]:
    """The files that are there of the years from start to end; none at all is an error."""
    folder = f"{root}/{instrument}/{timeframe}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f"{folder}/data_{y}.txt" for y in range(start.year, end.year + 1)]
    found = [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]
    if not found:
        raise FileNotFoundError(f"no bar file in {folder} for {start.year} to {end.year}")
    return found


def read_bars(spark: SparkSession, root: str, instrument: str, timeframe: str, start: datetime, end: datetime) -> DataFrame:
    """Bars from root/instrument/timeframe/data_year.txt, start and end included.

    Only the years' files are listed and read. Blank lines and repeated headers are left out; a number or time that can't be
    read fails the query. Decimal commas are points; volume is bid + ask and delta ask - bid.
    """
    found = year_files(spark, root, instrument, timeframe, start, end)
    raw = spark.read.csv(found, sep=";", schema=COLUMNS, header=False, encoding="UTF-8")
    rows = raw.where("stamp is not null and stamp <> 'DateTime'")
    number = lambda n: F.regexp_replace(n, ",", ".").cast("double")
    bars = rows.select(
        F.lit(instrument).alias("instrument"),
        F.lit(timeframe).alias("timeframe"),
        F.to_timestamp("stamp", "dd/MM/yyyy HH:mm:ss").cast("timestamp_ntz").alias("time"),
        *(number(n).alias(n) for n in ("open", "high", "low", "close")),
        (number("bid") + number("ask")).alias("volume"),
        (number("ask") - number("bid")).alias("delta"),
    )
    return bars.where(F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


#: The columns of files that are read by their header.
NAMED = ("DateTime", "Open", "High", "Low", "Close", "BidVolume", "AskVolume")


def read_named_bars(spark: SparkSession, root: str, instrument: str, timeframe: str, start: datetime, end: datetime) -> DataFrame:
    """Bars of the same files, each read by the names in its own header, in any order. What is no number is NULL, a missing bid or ask
    is 0, and a row whose time can't be read is in no range."""
    raw = None
    for path in year_files(spark, root, instrument, timeframe, start, end):  # a file a year, each by its own header
        one = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
        absent = [n for n in NAMED if n not in one.columns]
        if absent:
            raise ValueError(f"{path} lacks columns {absent}")
        raw = one.select(*NAMED) if raw is None else raw.unionByName(one.select(*NAMED))
    bid, ask = (F.coalesce(number(F.col(n)), F.lit(0.0)) for n in ("BidVolume", "AskVolume"))
    bars = raw.select(F.lit(instrument).alias("instrument"), F.lit(timeframe).alias("timeframe"), moment(F.col("DateTime")).alias("time"), *(number(F.col(n)).alias(n.lower()) for n in ("Open", "High", "Low", "Close")), (bid + ask).alias("volume"), (ask - bid).alias("delta"))
    return bars.where(F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def at_timeframe(source: "BarsSource", dataset: dict, timeframe: str | None = None) -> DataFrame:
    """The dataset's bars (instrument, timeframe, start, end), or those of another timeframe in the same range."""
    frame = timeframe or dataset["timeframe"]
    timeframe_text(frame)
    return source.fetch(dataset["instrument"], frame, dataset["start"], dataset["end"])


class CentralBars:
    """A BarsSource over a pipeline that is given as a function of its configuration; the configuration must be whole."""

    KEYS = ("instrument", "timeframe", "start", "end")

    def __init__(self, fetch: Callable[[dict], DataFrame], config: dict):
        absent = [k for k in ("source", "version") if not config.get(k)]
        if absent:
            raise ValueError(f"the configuration lacks {absent}")
        self.make, self.config = fetch, config

    def fetch(self, instrument: str, timeframe: str, start: datetime, end: datetime) -> DataFrame:
        return self.make({**self.config, **dict(zip(self.KEYS, (instrument, timeframe, start, end), strict=True))})


class TextBars:
    """A BarsSource over a folder of bar files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def fetch(self, instrument: str, timeframe: str, start: datetime, end: datetime) -> DataFrame:
        return read_bars(self.spark, self.root, instrument, timeframe, start, end)


def faults(bars: DataFrame) -> DataFrame:
    """One row: how many bars miss a value, break high >= open, close >= low, or repeat a time of their series."""
    missing = [known(F.col(c).cast("double")).isNull() for c in REQUIRED]
    bad = missing[0]
    for m in missing[1:]:
        bad = bad | m
    insane = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    per_time = bars.groupBy("instrument", "timeframe", "time").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("missing"), F.count_if(insane).alias("insane"))
    return per_time.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bars"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.coalesce(F.sum("insane"), F.lit(0)).alias("insane"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def validated(bars: DataFrame) -> DataFrame:
    """The bars, if they have all columns and no faults."""
    absent = [c for c in ("time", *REQUIRED) if c not in bars.columns]
    if absent:
        raise ValueError(f"columns are absent: {absent}")
    found = faults(bars).first().asDict()
    wrong = {k: v for k, v in found.items() if v and k != "bars"}
    if wrong:
        raise ValueError(f"bars are not valid: {wrong}")
    return bars

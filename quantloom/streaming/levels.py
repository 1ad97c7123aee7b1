"""Session levels kept up to date: only the dates that changed bars affect are computed and written again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.levels import session_levels
from ..sources.exports import write_levels

DAY = dt.timedelta(days=1)


def _around(days: Iterable[dt.date]) -> set[dt.date]:
    """All days of the ISO weeks and the months of these."""
    out: set[dt.date] = set()
    for d in set(days):
        monday, first = d - DAY * d.weekday(), d.replace(day=1)
        out |= {monday + DAY * k for k in range(7)}
        last = (first + DAY * 31).replace(day=1) - DAY
        out |= {first + DAY * k for k in range(last.day)}
    return out


def affected(changed: Iterable[dt.date]) -> set[dt.date]:
    """The days whose levels follow from bars of the changed ones: these, the days after them, and their weeks and months."""
    changed = set(changed)
    return _around(changed) | {d + DAY for d in changed}


def _within(day: Column, days: set[dt.date]) -> Column:
    """Whether a date is one of these, by ranges of days in a row."""
    starts = sorted(d for d in days if d - DAY not in days)
    ends = sorted(d for d in days if d + DAY not in days)
    return reduce(lambda a, b: a | b, (day.between(F.lit(a), F.lit(z)) for a, z in zip(starts, ends, strict=True)), F.lit(False))


def refreshed(bars: DataFrame, changed: Iterable[dt.date], bin_size: float = 1.0) -> DataFrame:
    """The rows of `session_levels` of all bars whose date is affected. Bars of other weeks and months are not read, but for the
    days before."""
    days = affected(changed)
    needed = _around(days) | {d - DAY for d in days}
    return session_levels(bars.where(_within(F.to_date("time"), needed)), bin_size=bin_size).where(_within(F.col("date"), days))


def refresh(bars: DataFrame, changed: Iterable[dt.date], path: str, bin_size: float = 1.0) -> None:
    """Write the affected dates again; folders of all other dates stay as they are. Bars are added, never taken away."""
    write_levels(refreshed(bars, changed, bin_size), path, dates_only=True)


def levels_of_stream(bars: DataFrame, store: str, path: str, bin_size: float = 1.0) -> DataStreamWriter:
    """A writer that adds a stream's closed bars to `store` and keeps the levels of all dates in `path`; the caller sets checkpoint and
    trigger and starts it. A batch that runs again after a failure replaces its own bars, so none is counted twice. The list of a
    batch's dates goes to the driver: a calendar bounds it."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        spark = batch.sparkSession
        new = spark.read.parquet(f"{store}/batch={number}").select(F.to_date("time").alias("date")).distinct()
        changed = [r["date"] for r in new.collect()]
        if changed:
            refresh(spark.read.schema(batch.schema).option("basePath", store).parquet(store).drop("batch"), changed, path, bin_size)

    return bars.writeStream.foreachBatch(take).outputMode("append")

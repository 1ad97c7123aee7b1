"""Rotations and clusters of a stream of bars, a series' state at a time.

Bars must come as `closed_bars` gives them: each once, and none after a batch that held a later one of its series. Bars of one batch
are put in order. State is a row a series, and for clusters the rotations of the one that is open; it lives in the state store, so a
restart from the checkpoint goes on where it was. Call `with_state_store` on the session first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, NamedTuple, get_type_hints

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..sources.tables import SERIES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that keyed state with timers needs."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Bar(NamedTuple):
    index: int
    time: int
    close: float
    volume: float
    delta: float
    high: float
    low: float


class Run(NamedTuple):
    """A rotation so far, or a whole one; times are microseconds."""

    rotation_index: int
    direction: str
    start_index: int
    end_index: int
    start_time: int
    end_time: int
    start_price: float
    end_price: float
    volume: float
    delta: float

    @property
    def bars(self) -> int:
        return self.end_index - self.start_index + 1


def _schema(kind: type, prefix: str = "") -> list[StructField]:
    types = {int: LongType(), float: DoubleType(), str: StringType()}
    return [StructField(prefix + n, types[t]) for n, t in get_type_hints(kind).items()]


def following(last: Bar | None, run: Run | None, time: int, row: Any) -> tuple[Bar, Run | None, Run | None]:
    """One bar on: the bar with its place, the open rotation, and the one that this bar has ended."""
    bar = Bar(0 if last is None else last.index + 1, time, row.close, row.volume, row.delta, row.high, row.low)
    if last is None:
        return bar, None, None
    direction = "up" if bar.high > last.high else "down" if bar.low < last.low else run.direction if run else None
    if direction is None:
        return bar, None, None
    if run and run.direction == direction:
        return bar, run._replace(end_index=bar.index, end_time=time, end_price=bar.close, volume=run.volume + bar.volume, delta=run.delta + bar.delta), None
    begun = Run(run.rotation_index + 1 if run else 0, direction, last.index, bar.index, last.time, time, last.close, bar.close, last.volume + bar.volume, last.delta + bar.delta)
    return bar, begun, run


class Rotations(StatefulProcessor):
    """Whole rotations. One whose validity depends on the next waits for that one's end."""

    def __init__(self, min_amplitude: float, min_bars: int, whipsaw_bars: int, silence_ms: int | None):
        self.min_amplitude, self.min_bars, self.whipsaw_bars, self.silence_ms = min_amplitude, min_bars, whipsaw_bars, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        flags = [StructField("open", BooleanType()), StructField("waits", BooleanType()), StructField("short_before", BooleanType())]
        self.series = handle.getValueState("series", StructType([*_schema(Bar), *flags, *_schema(Run, "open_"), *_schema(Run, "last_")]))

    def _load(self) -> None:
        self.bar = self.run = self.waiting = None
        self.short_before = False
        if self.series.exists():
            v = tuple(self.series.get())
            b, r = len(Bar._fields), len(Run._fields)
            self.bar, self.short_before = Bar(*v[:b]), v[b + 2]
            self.run = Run(*v[b + 3 : b + 3 + r]) if v[b] else None
            self.waiting = Run(*v[b + 3 + r :]) if v[b + 1] else None

    def _save(self) -> None:
        none = (None,) * len(Run._fields)
        self.series.update((*self.bar, self.run is not None, self.waiting is not None, self.short_before, *(self.run or none), *(self.waiting or none)))

    def _ended(self, run: Run | None) -> Iterator[tuple]:
        """The rotations that are known whole now that `run` has ended; None: the series is over."""
        if self.whipsaw_bars < 2:
            if run:
                yield self._row(run, False)
            return
        short = bool(run) and run.bars <= self.whipsaw_bars
        if self.waiting:
            own = self.waiting.bars <= self.whipsaw_bars
            yield self._row(self.waiting, own and (self.short_before or short))
            self.short_before = own
        self.waiting = run

    def _row(self, run: Run, whipsaw: bool) -> tuple:
        n, amplitude = run.bars, abs(run.end_price - run.start_price)
        kind = "structural" if n >= 5 else "standard" if n >= 3 else "micro"
        return (*run, n, amplitude, kind, amplitude >= self.min_amplitude and n >= self.min_bars and not whipsaw)

    COLUMNS = [*Run._fields, "bar_count", "amplitude", "rotation_type", "valid"]

    def _table(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.COLUMNS)
        for n in ("start_time", "end_time"):
            out[n] = pd.to_datetime(out[n], unit="us")
        for k, n in enumerate(SERIES):
            out.insert(k, n, key[k])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values("time").itertuples(index=False):
            self.bar, self.run, whole = following(self.bar, self.run, row.time.value // 1000, row)
            if whole:
                out += self.told(self._ended(whole))
        self._save()
        if self.silence_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.bar.time // 1000 + self.silence_ms)
        if out:
            yield self._table(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """A series that has been silent for so long is over: what is open ends with its last bar."""
        self._load()
        last = [*self._ended(self.run), *self._ended(None)] if self.run else list(self._ended(None))
        out = self.told(iter(last), over=True)
        self.series.clear()
        if out:
            yield self._table(key, out)

    def told(self, rotations: Iterator[tuple], over: bool = False) -> list[tuple]:
        return list(rotations)

    def close(self) -> None:
        pass


class Clusters(Rotations):
    """Valid rotations with their cluster, once it has ended."""

    def __init__(self, max_gap_bars: float, max_width: float | None, min_rotations: int, bar_seconds: float, *rotations: Any):
        super().__init__(*rotations)
        self.most_gap = max_gap_bars * bar_seconds * 1e6
        self.width = math.inf if max_width is None else max_width
        self.min_rotations = min_rotations

    COLUMNS = [*Rotations.COLUMNS, "cluster"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        more = [StructField("bar_count", LongType()), StructField("amplitude", DoubleType()), StructField("rotation_type", StringType()), StructField("valid", BooleanType())]
        self.cluster = handle.getValueState("cluster", StructType([StructField("cluster", IntegerType()), StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("end_time", LongType())]))
        self.members = handle.getListState("members", StructType([*_schema(Run), *more]))

    def _close(self, cluster: int, new: list[tuple]) -> list[tuple]:
        members = [*(tuple(m) for m in self.members.get()), *new] if self.members.exists() else new
        return [(*m, cluster) for m in members] if len(members) >= self.min_rotations else []

    def told(self, rotations: Iterator[tuple], over: bool = False) -> list[tuple]:
        open_, out, new = tuple(self.cluster.get()) if self.cluster.exists() else None, [], []
        for row in rotations:
            run = Run(*row[: len(Run._fields)])
            if not row[-1]:
                continue
            low, high = min(run.start_price, run.end_price), max(run.start_price, run.end_price)
            if open_ and run.start_time - open_[3] <= self.most_gap and max(high, open_[2]) - min(low, open_[1]) <= self.width:
                open_ = (open_[0], min(low, open_[1]), max(high, open_[2]), run.end_time)
            else:
                if open_:
                    out += self._close(open_[0], new)
                    self.members.clear()
                open_, new = (open_[0] + 1 if open_ else 0, low, high, run.end_time), []
            new.append(row)
        if over:
            out += self._close(open_[0], new) if open_ else []
            self.members.clear()
            self.cluster.clear()
        elif open_:
            self.cluster.update(open_)
            if new:
                self.members.appendList(new)
        return out


def _output(bars: DataFrame, cluster: bool) -> StructType:
    kind = bars.schema["time"].dataType
    fields = [StructField(n, StringType()) for n in SERIES]
    fields += [StructField(f.name, kind if f.name.endswith("_time") else f.dataType) for f in _schema(Run)]
    fields += [StructField("bar_count", LongType()), StructField("amplitude", DoubleType()), StructField("rotation_type", StringType()), StructField("valid", BooleanType())]
    return StructType(fields + [StructField("cluster", IntegerType())] * cluster)


def _stateful(bars: DataFrame, processor: StatefulProcessor, silence: float | None, cluster: bool) -> DataFrame:
    return bars.groupBy(*SERIES).transformWithStateInPandas(statefulProcessor=processor, outputStructType=_output(bars, cluster), outputMode="Append", timeMode="None" if silence is None else "EventTime")


def online_rotations(bars: DataFrame, min_amplitude: float = 0.0, min_bars: int = 0, whipsaw_bars: int = 0, silence: float | None = None) -> DataFrame:
    """The rotations of a stream of closed bars, each once it has ended: those that `rotations` finds in the same bars.

    With `silence` (seconds) a series ends when the watermark is so far beyond its last bar: its last rotation is told and its
    state goes; without, the last one stays open. Bars then need a column with the watermark, as `closed_bars` has.
    """
    return _stateful(bars, Rotations(min_amplitude, min_bars, whipsaw_bars, None if silence is None else int(silence * 1000)), silence, False)


def online_clusters(
    bars: DataFrame,
    max_gap_bars: float = 3,
    max_width: float | None = None,
    min_rotations: int = 2,
    bar_seconds: float = 60,
    min_amplitude: float = 0.0,
    min_bars: int = 0,
    whipsaw_bars: int = 0,
    silence: float | None = None,
) -> DataFrame:
    """The members of the clusters of a stream of closed bars, once no later rotation can join: those of `clustered`.

    State is what `online_rotations` holds and the members of the one open cluster of each series; `silence` as there.
    """
    processor = Clusters(max_gap_bars, max_width, min_rotations, bar_seconds, min_amplitude, min_bars, whipsaw_bars, None if silence is None else int(silence * 1000))
    return _stateful(bars, processor, silence, True)

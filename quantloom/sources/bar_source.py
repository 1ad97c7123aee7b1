"""Bar files as a Spark data source: `spark.dataSource.register(BarFiles)`, then `spark.read.format("bar_files")`.

Options: root, instrument, timeframe, and `split`, the bytes of a partition. Files are root/instrument/timeframe/data_<year>.txt in
any file system that pyarrow knows by its address; each is read by its own header. Filters on `time` choose the years' files where
`spark.sql.python.filterPushdown.enabled` is set; Spark applies them to the rows as well.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .bar_files import NAMED, timeframe_text

SCHEMA = "instrument string, timeframe string, time timestamp_ntz, open double, high double, low double, close double, volume double, delta double"
NUMBERS = ("Open", "High", "Low", "Close", "BidVolume", "AskVolume")
SPLIT = 64 << 20
YEAR_FILE = re.compile(r"data_(\d{4})\.txt")


class Part(NamedTuple):
    path: str
    begin: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class BarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> BarReader:
        return BarReader(self.options)


class BarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.instrument, self.timeframe = (options[k] for k in ("root", "instrument", "timeframe"))
        timeframe_text(self.timeframe)
        self.split = int(options.get("split", SPLIT))
        self.first, self.last = dt.MINYEAR, dt.MAXYEAR

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the years; every filter is left to Spark too, for years are whole files."""
        for f in filters:
            year = getattr(getattr(f, "value", None), "year", None)
            if getattr(f, "attribute", None) == ("time",) and year is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, year)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, year)
            yield f

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the years' files; a range reads the lines that begin in it."""
        system, folder = opened(f"{self.root}/{self.instrument}/{self.timeframe}")
        out = []
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            m = YEAR_FILE.fullmatch(info.base_name)
            if m and self.first <= int(m[1]) <= self.last:
                out += [Part(info.path, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
        return [InputPartition(p) for p in sorted(out)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        part: Part = partition.value
        system, _ = opened(self.root)
        with system.open_input_file(part.path) as file:
            header = self._line(file, 0)
            names = [n.strip() for n in header.decode("utf-8-sig").strip().split(";")]
            absent = [n for n in NAMED if n not in names]
            if absent:
                raise ValueError(f"{part.path} lacks columns {absent}")
            begin = len(header) if part.begin == 0 else part.begin - 1 + len(self._line(file, part.begin - 1))
            end = part.end - 1 + len(self._line(file, part.end - 1)) if part.end > begin else begin
            if end <= begin:
                return
            file.seek(begin)
            text = file.read(end - begin)
        yield from self._bars(text, names)

    @staticmethod
    def _line(file: pa.NativeFile, at: int) -> bytes:
        """What is left of the line that holds this byte, its end included."""
        file.seek(at)
        out = b""
        while b"\n" not in out and (more := file.read(1 << 12)):
            out += more
        return out[: out.index(b"\n") + 1] if b"\n" in out else out

    def _bars(self, text: bytes, names: list[str]) -> Iterator[pa.RecordBatch]:
        skip = lambda row: "skip"  # noqa: E731  (rows of another width are no bars)
        table = pacsv.read_csv(
            pa.BufferReader(text),
            read_options=pacsv.ReadOptions(column_names=names),
            parse_options=pacsv.ParseOptions(delimiter=";", quote_char=False, invalid_row_handler=skip),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=list(NAMED), strings_can_be_null=False),
        )
        plain = {n: pc.utf8_trim_whitespace(table[n]) for n in NAMED}
        stamp = plain["DateTime"]
        real = pc.match_substring_regex(stamp, r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$")
        time = pc.strptime(pc.if_else(real, stamp, None), format="%d/%m/%Y %H:%M:%S", unit="us", error_is_null=True)
        value = {}
        for n in NUMBERS:
            dotted = pc.replace_substring(plain[n], ",", ".")
            value[n] = pc.if_else(pc.match_substring_regex(dotted, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), dotted, None).cast(pa.float64())
        bid, ask = (pc.fill_null(value[n], 0.0) for n in ("BidVolume", "AskVolume"))
        columns = [pa.array([x] * table.num_rows, pa.string()) for x in (self.instrument, self.timeframe)]
        columns += [time, *(value[n] for n in NUMBERS[:4]), pc.add(bid, ask), pc.subtract(ask, bid)]
        made = pa.table(dict(zip(("instrument", "timeframe", "time", "open", "high", "low", "close", "volume", "delta"), columns, strict=True)))
        yield from made.filter(pc.is_valid(made["time"])).to_batches()

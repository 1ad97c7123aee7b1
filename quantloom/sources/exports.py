"""Exports of results: event and level files with manifests, pattern runs, reports. Data is written by Spark; the driver writes only
small texts, through the file system of the path."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import canonical_json
from .event_files import SCHEMA_VERSION, in_order
from .sinks import flat

BARS = ("timestamp", "open", "high", "low", "close", "volume", "delta")


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Write a small text and return its SHA-256."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    raw = text.encode()
    out.write(raw)
    out.close()
    return hashlib.sha256(raw).hexdigest()


def digest(df: DataFrame) -> dict[str, object]:
    """Rows, columns and an order-free digest of the rows: what a manifest says of a table that has any number of files."""
    row = F.sha2(F.to_json(F.struct("*")), 256)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return {"rows": got["n"], "columns": df.columns, "digest": hashlib.sha256(f"{got['n']}:{got['sum']}".encode()).hexdigest()}


def _csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_events(events: DataFrame, path: str, manifest: bool = True) -> None:
    """Events in the order of time and id as CSV, nested columns as JSON, each row with the schema version; and a manifest."""
    versioned = in_order(events.withColumn("schema_version", F.lit(SCHEMA_VERSION)))
    _csv(versioned, f"{path}/events")
    if manifest:
        write_text(events.sparkSession, f"{path}/manifest.json", canonical_json({"schema_version": SCHEMA_VERSION, **digest(flat(versioned))}))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as CSV by time, the time as `timestamp`."""
    _csv(bars.withColumnRenamed("time", "timestamp").orderBy("timestamp"), path)


def write_levels(levels: DataFrame, path: str, dates_only: bool = False) -> None:
    """Levels as CSV, one folder a date; with `dates_only` folders of dates that the levels don't have stay as they are."""
    mode = "dynamic" if dates_only else "static"
    flat(levels).repartition("date").write.mode("overwrite").options(header=True, escape='"', partitionOverwriteMode=mode).partitionBy("date").csv(path)


def write_master(df: DataFrame, path: str, by: str = "session_name") -> None:
    """The joined table as Parquet, and a text with its rows in all and by session."""
    df.write.mode("overwrite").parquet(f"{path}/df_master")
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).collect()
    write_text(df.sparkSession, f"{path}/summary.txt", "\n".join([f"rows: {sum(r['n'] for r in counts)}", *(f"{r[by]}: {r['n']}" for r in counts)]) + "\n")


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A small report as JSON with sorted keys, compact, NaN as null."""
    write_text(spark, path, canonical_json(report))


def check_findings(report: dict) -> None:
    """A report of findings has meta and summary objects and a list of findings with their fields."""
    absent = {"meta", "summary", "insights"} - set(report)
    if absent:
        raise ValueError(f"keys are absent: {sorted(absent)}")
    if not isinstance(report["meta"], dict) or not isinstance(report["summary"], dict) or not isinstance(report["insights"], list):
        raise ValueError("meta and summary are objects, insights is a list")
    for k, item in enumerate(report["insights"]):
        missing = {"type", "metric_value", "rows_valid", "class", "severity"} - set(item)
        if missing:
            raise ValueError(f"finding {k} lacks {sorted(missing)}")


def write_pattern_run(matches: DataFrame, stats: DataFrame, bars: DataFrame, config: dict, path: str, manual: bool = False, parquet: bool = False) -> None:
    """A pattern run: its matches, stats and bars as CSV (and Parquet), the configuration, column schemas and a manifest.

    All rows are of one instrument and timeframe. No match is an error, unless the template was drawn by hand.
    """
    series = [tuple(r) for r in matches.select("instrument", "timeframe").distinct().limit(2).collect()]
    if len(series) > 1:
        raise ValueError(f"more than one instrument or timeframe: {series}")
    if not series and not manual:
        raise ValueError("no matches")
    dated = bars.withColumnRenamed("time", "timestamp")
    tables = {"matches": in_order(matches, "start_time", ()), "stats": stats, "ohlc": dated.select(*(n for n in BARS if n in dated.columns)).orderBy("timestamp")}
    manifest: dict[str, object] = {}
    for name, df in tables.items():
        _csv(df, f"{path}/{name}/csv")
        if parquet:
            df.write.mode("overwrite").parquet(f"{path}/{name}/parquet")
        manifest[name] = digest(flat(df))
        schema = {"title": name, "type": "object", "properties": {f.name: {"type": f.dataType.simpleString()} for f in df.schema}, "required": df.columns}
        manifest[f"schema/{name}.json"] = write_text(matches.sparkSession, f"{path}/schema/{name}.json", canonical_json(schema))
    manifest["config.json"] = write_text(matches.sparkSession, f"{path}/config.json", canonical_json(config))
    write_text(matches.sparkSession, f"{path}/manifest.json", canonical_json(manifest))


def pattern_stats(matches: DataFrame, pattern_id: str, length_bars: int) -> DataFrame:
    """One row: how often the pattern was found and how well at best (0 if never)."""
    return matches.agg(F.lit(pattern_id).alias("pattern_id"), F.lit(length_bars).alias("length_bars"), F.count(F.lit(1)).alias("n_occurrences"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_similarity_score"))


def as_json_rows(df: DataFrame) -> DataFrame:
    """CSV text as typed JSON, a row each: empty is null, true and false are truth values, whole numbers are numbers; other
    numbers stay text, so that no digit is lost."""
    whole = r"^[+-]?[0-9]{1,18}$"

    def typed(name: str):
        v, quoted = F.trim(F.col(name)), F.to_json(F.struct(F.col(name).alias("v")))
        inner = F.regexp_extract(quoted, r'(?s)^\{"v":(.*)\}$', 1)
        value = F.when(v.isNull() | (v == ""), "null").when(F.lower(v).isin("true", "false"), F.lower(v)).when(v.rlike(whole), v.cast("long").cast("string")).otherwise(inner)
        return F.concat(F.lit(json.dumps(name) + ":"), value)

    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *(typed(n) for n in df.columns)), F.lit("}")).alias("value"))

"""Queries of scans, sinks, checks and parsers: what they write goes to the shared folder and is read back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import moment, number, without_nan
from ..operators import dashboards as dash, levels
from ..sources import bar_files, event_files as ev, exports, sinks
from ..sources.stash import shared_folder, stash
from ..sources.tables import bars, facts, table
from . import spec
from .catalog import BARS, CLOSE_ONLY, FACTS, FOUND as MATCHES, _found, c, events, register
from .detection import CHAIN, ROUNDED, SESSION_LEVELS, series, whole_chain

YEARS = dt.datetime(1900, 1, 1), dt.datetime(2200, 12, 31)


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/quantloom-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# --- bar files: one of each instrument and year --------------------------------------------------------------------------


def _bar_text(s: SparkSession, d: str, named: bool) -> DataFrame:
    """All bars as text by instrument and year, with decimal commas, and read again. Instruments and years are a short list."""
    given, root = stash(bars(s, d).withColumn("year", F.year("time"))), folder(s)
    comma = lambda x: F.regexp_replace(x.cast("string"), "\\.", ",")
    stamp, bid, ask = F.date_format("time", "dd/MM/yyyy HH:mm:ss"), comma((c("volume") - c("delta")) / 2), comma((c("volume") + c("delta")) / 2)
    prices = [comma(c(n)).alias(n.title()) for n in ("high", "low", "open", "close")]
    fields = [stamp.alias("DateTime"), *prices[::-1], ask.alias("AskVolume"), bid.alias("BidVolume")] if named else [F.lit("X"), F.lit("1"), stamp, *prices, bid, ask]
    out = None
    for instrument, years in given.groupBy("instrument").agg(F.sort_array(F.collect_set("year"))).collect():
        for year in years:
            own, path = given.where((c("instrument") == instrument) & (c("year") == year)), f"{root}/{instrument}/1h/data_{year}.txt"
            if named:
                own.select(fields).write.options(header=True, sep=";").csv(path)
            else:
                own.select(F.concat_ws(";", *fields).alias("value")).write.text(path)
        one = (bar_files.read_named_bars if named else bar_files.read_bars)(s, root, instrument, "1h", *YEARS)
        out = one if out is None else out.unionByName(one)
    return (given.drop("year") if out is None else out).drop("timeframe")


BAR_ROWS = f"WITH {BARS} SELECT instrument, time, open, high, low, close, round(volume, 6) AS volume, round(delta, 6) AS delta FROM bars"
register("scan_bar_text", lambda s, d: _bar_text(s, d, False), BAR_ROWS)
register("scan_bar_named", lambda s, d: _bar_text(s, d, True), BAR_ROWS)


def _bars_csv(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    exports.write_bars(bars(s, d), path)
    back = ev.read_csv(s, path, spans_lines=False)
    return back.select("instrument", c("timestamp").cast("timestamp_ntz").alias("time"), *(c(n).cast("double").alias(n) for n in ("open", "high", "low", "close", "volume", "delta")))


register("export_bars", _bars_csv, BAR_ROWS)

# --- events, levels and tables ---------------------------------------------------------------------------------------------


def _events_csv(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    exports.write_events(stash(whole_chain(s, d)), path)
    return ev.read_csv(s, f"{path}/events", spans_lines=False)


register(
    "export_events",
    lambda s, d: _events_csv(s, d).select("breakout_id", "instrument", "direction", "breakout_type", c("breakout_time").cast("timestamp_ntz").alias("breakout_time"), c("breakout_price").cast("double").alias("breakout_price"), "schema_version"),
    f"WITH RECURSIVE {CHAIN} SELECT 'bo_' || range_id || '_' || bar_index AS breakout_id, instrument, direction, breakout_type, breakout_time, round(p, 6) AS breakout_price, '1.1.0' AS schema_version FROM sc JOIN cl USING (instrument, range_id)",
)
register(
    "events_narrowed",
    lambda s, d: ev.narrowed(_events_csv(s, d)).select("breakout_id", "direction", "breakout_price", "balance_range_size", "initial_delta", "initial_volume", "atr_before", "is_failed", "max_excursion", "retracement_depth", "time_to_retest_boundary"),
    f"WITH RECURSIVE {CHAIN} SELECT 'bo_' || range_id || '_' || bar_index AS breakout_id, direction, round(p, 6) AS breakout_price, round(sc.size, 6) AS balance_range_size, round(idl, 6) AS initial_delta, round(iv, 6) AS initial_volume, round(atr_before, 6) AS atr_before, breakout_type IN ('failed_follow_through', 'false_breakout') AS is_failed, round(mx, 6) AS max_excursion, round(depth, 6) AS retracement_depth, retest::DOUBLE AS time_to_retest_boundary FROM sc JOIN cl USING (instrument, range_id)",
)


def _levels_csv(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    exports.write_levels(levels.session_levels(series(s, d), bin_size=25.0), path)
    return ev.read_levels(s, path).select("instrument", "date", "session_name", *ROUNDED)


register("export_levels", _levels_csv, f"WITH RECURSIVE {SESSION_LEVELS} SELECT upper(instrument) AS instrument, date, session_name, {', '.join(f'round({x}, 6) AS {x}' for x in ROUNDED)} FROM al")


def _parquet(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    sinks.write_parquet(sinks.contract_order(facts(s, d), ["breakout_id", "direction"]), path)
    back = s.read.parquet(path)
    return back.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.avg("initial_volume").alias("mean_volume"), F.lit(", ".join(back.columns[:4])).alias("first_columns"))


register("export_parquet", _parquet, f"WITH {FACTS} SELECT direction, count(*) AS n, round(avg(size * 20), 6) AS mean_volume, 'breakout_id, direction, atr_before, balance_midpoint' AS first_columns FROM f GROUP BY direction")


def _json_rows(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    sinks.write_csv(facts(s, d).select("breakout_id", "direction", "is_failed", c("breakout_price").cast("decimal(18,4)").alias("price")), path)
    return exports.as_json_rows(ev.read_csv(s, path, spans_lines=False))


register("csv_to_json", _json_rows, f"""WITH {FACTS} SELECT '{{"breakout_id":' || breakout_id || ',"direction":' || coalesce('"' || direction || '"', 'null') || ',"is_failed":' || is_failed || ',"price":"' || price::DECIMAL(18,4) || '"}}' AS value FROM f""")


def _master_summary(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    exports.write_master(levels.dated_events(events(s, d)).select("range_id", "session_name"), path)
    return s.read.text(f"{path}/summary.txt").where("value <> ''")


HOURS = "CASE WHEN hour(breakout_time) * 60 + minute(breakout_time) BETWEEN 60 AND 599 THEN 'asia' WHEN hour(breakout_time) * 60 + minute(breakout_time) BETWEEN 540 AND 1049 THEN 'europe' WHEN hour(breakout_time) * 60 + minute(breakout_time) BETWEEN 930 AND 1319 THEN 'usa' ELSE 'off' END"
register("master_summary", _master_summary, f"WITH {CLOSE_ONLY}, e AS (SELECT {HOURS} AS s FROM ev) SELECT 'rows: ' || count(*) AS value FROM e UNION ALL SELECT s || ': ' || count(*) FROM e GROUP BY s")
register("session_not_off", lambda s, d: levels.dated_events(events(s, d)).where("session_name <> 'off'").select("range_id", "date", "session_name"), f"WITH {CLOSE_ONLY}, e AS (SELECT range_id, CAST(breakout_time AS DATE) AS date, {HOURS} AS session_name FROM ev) SELECT * FROM e WHERE session_name <> 'off'")

# --- checks, parsers, orders ---------------------------------------------------------------------------------------------

CHECKED = ("breakout_id", "direction", "breakout_type", "max_excursion")
register("contract_nulls", lambda s, d: ev.nulls(facts(s, d), CHECKED), f"WITH {FACTS}, x AS (SELECT 'direction' AS \"column\", count(*) FILTER (direction IS NULL) AS n FROM f UNION ALL SELECT 'breakout_type', count(*) FILTER (breakout_type IS NULL) FROM f UNION ALL SELECT 'max_excursion', count(*) FILTER (mx IS NULL) FROM f UNION ALL SELECT 'breakout_id', count(*) FILTER (breakout_id IS NULL) FROM f) SELECT * FROM x WHERE n > 0")
register("nan_to_null", lambda s, d: without_nan(table(s, d, "events").select("event_id", F.when(c("event_id") % 3 == 0, float("nan")).otherwise(c("value")).alias("value"))), "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events")


def _parsed(s: SparkSession, d: str) -> DataFrame:
    """Numbers with commas and times as text, some of which are none."""
    odd = c("event_id") % 5 == 0
    text = table(s, d, "events").select("event_id", F.when(odd, "n/a").otherwise(F.concat(F.lit(" "), F.regexp_replace(c("value").cast("string"), "\\.", ","))).alias("v"), F.when(odd, "31/02/2024 10:00:00").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).alias("t"))
    return text.select("event_id", number(c("v")).alias("number"), moment(c("t")).alias("moment"))


register("parse_text", _parsed, "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS number, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS moment FROM events")
register("events_in_order", lambda s, d: ev.in_order(facts(s, d).select("breakout_id", "breakout_time", "direction")).limit(40), f"WITH {FACTS} SELECT breakout_id, t AS breakout_time, direction FROM f ORDER BY t, breakout_id LIMIT 40")


def _report(s: SparkSession, d: str) -> DataFrame:
    return dash.report_rows(spec.run(facts(s, d), {"metric": "mean", "value_field": "initial_volume", "group_by": ["total_score", "direction"]}), ["total_score", "direction"])


MEANS = f"WITH {FACTS}, r AS (SELECT score AS total_score, direction, count(*) AS rows_total, count(size) AS rows_valid, round(avg(size * 20), 6) AS result FROM f GROUP BY ALL)"
BY_TEXT = "ORDER BY 'direction=' || coalesce(direction, 'None') || '|total_score=' || total_score"
register("report_first_rows", lambda s, d: _report(s, d).limit(5), f"{MEANS} SELECT * FROM r {BY_TEXT} LIMIT 5")
register("preview", lambda s, d: dash.preview(_report(s, d), 7, 3), f"{MEANS} SELECT total_score, direction, rows_total FROM r {BY_TEXT} LIMIT 7")
register("pattern_stats", lambda s, d: exports.pattern_stats(_found(s, d), "pat_query", 3), f"WITH {MATCHES} SELECT 'pat_query' AS pattern_id, 3 AS length_bars, count(*) AS n_occurrences, coalesce(max(score), 0.0) AS max_similarity_score FROM m")
register("feature_initial_volume", lambda s, d: facts(s, d).select("breakout_id", c("initial_volume").alias("initial_volume_feature")), f"WITH {FACTS} SELECT breakout_id, size * 20 AS initial_volume_feature FROM f")

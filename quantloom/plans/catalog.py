"""The library's queries by name over the given tables, each with SQL that says the same.

Floating results are rounded to six places on both sides; the SQL is written from the definitions, not from the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import scalars, selection
from ..operators import bars as b, breakouts as bo, dashboards as dash, features as feat, insights, levels, pattern_index, patterns as pat, rotations as rot
from ..operators.predicates import all_of
from ..sources import sinks
from ..sources.bar_files import faults
from ..sources.tables import bars, facts, indexed, table
from . import calendar as cal, spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col

BARS = """bars AS (SELECT event_type AS instrument, '1 hour' AS timeframe, date_trunc('hour', ts) AS time, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, round(sum(value), 6) AS volume, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END), 6) AS delta FROM events GROUP BY ALL),
ib AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time) - 1 AS bar_index, lag(high) OVER s AS ph, lag(low) OVER s AS pl, lag(close) OVER s AS pc FROM bars WINDOW s AS (PARTITION BY instrument ORDER BY time)),
tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tra FROM ib)"""
QUARTERS = BARS.replace("date_trunc('hour', ts)", "time_bucket(INTERVAL 15 MINUTE, ts)")
FACTS = """f AS (SELECT l_orderkey * 10 + l_linenumber AS breakout_id, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN l_returnflag = 'R' THEN 'false_breakout' WHEN l_returnflag = 'A' THEN 'failed_follow_through' WHEN l_linenumber % 2 = 0 THEN 'clean' END AS breakout_type, l_returnflag = 'R' AS is_failed,
  l_quantity AS size, round(l_discount * 30, 2) AS atr, round(l_extendedprice / 100, 4) AS price, round(l_extendedprice / 100 - l_quantity / 2, 4) AS mid, round(l_extendedprice / 50 - 600, 4) AS delta, l_quantity * 20 AS volume,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE round(l_tax * 50 + l_linenumber, 2) END AS mx, round(l_discount * 20 + l_linenumber / 2, 2) AS depth, l_linenumber AS score, l_shipdate AS t FROM lineitem),
g AS (SELECT *, CASE WHEN mx >= atr THEN 1 ELSE 0 END AS success, dayname(t) AS weekday, month(t) AS month, day(t) AS dom, (day(t) - 1) // 7 + 1 AS wom, hour(t) AS hour,
  CASE WHEN hour(t) * 60 + minute(t) BETWEEN 930 AND 1319 THEN 'usa' WHEN hour(t) * 60 + minute(t) BETWEEN 540 AND 1049 THEN 'europe' WHEN hour(t) * 60 + minute(t) BETWEEN 60 AND 599 THEN 'asia' ELSE 'off' END AS session_name FROM f)"""
RANGES = (
    BARS
    + """, ranges AS (SELECT instrument, instrument || '_' || strftime(time, '%Y-%m-%d') AS range_id, max(close) AS range_high, min(close) AS range_low, max(bar_index) AS end_index, min(time) AS start_time FROM
  (SELECT *, row_number() OVER (PARTITION BY instrument, CAST(time AS DATE) ORDER BY time) AS k FROM ib) WHERE k <= 2 GROUP BY instrument, range_id)"""
)


def _break(test_up: str, test_down: str) -> str:
    return (
        RANGES
        + f""", hit AS (SELECT r.*, i.bar_index, i.time AS breakout_time, i.open, i.close AS breakout_price, i.volume AS initial_volume, i.delta AS initial_delta, CASE WHEN {test_up} THEN 'up' WHEN {test_down} THEN 'down' END AS direction
  FROM ranges r JOIN ib i ON i.instrument = r.instrument AND i.bar_index BETWEEN r.end_index + 1 AND r.end_index + 61),
ev AS (SELECT *, CASE direction WHEN 'up' THEN range_high ELSE range_low END AS boundary_price FROM hit WHERE direction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, range_id ORDER BY bar_index) = 1)"""
    )


CLOSE_ONLY = _break("i.close > range_high", "i.close < range_low")
FOLLOW = (
    CLOSE_ONLY
    + """, nx AS (SELECT e.instrument, e.range_id, e.direction, e.boundary_price AS b, e.breakout_price, e.range_high - e.range_low AS size, e.bar_index, i.bar_index - e.bar_index - 1 AS k, i.close, i.volume, i.delta,
  abs(i.close - lag(i.close) OVER (PARTITION BY e.instrument, e.range_id ORDER BY i.bar_index)) AS step FROM ev e LEFT JOIN ib i ON i.instrument = e.instrument AND i.bar_index BETWEEN e.bar_index + 1 AND e.bar_index + 40),
ft AS (SELECT instrument, range_id, any_value(direction) AS direction, any_value(size) AS size, count(close) AS n, CASE WHEN count(close) = 0 THEN 0 WHEN any_value(direction) = 'up' THEN max(close) - any_value(b) ELSE any_value(b) - min(close) END AS max_excursion,
  CASE WHEN count(close) = 0 THEN 0 WHEN any_value(direction) = 'up' THEN first(k ORDER BY close DESC, k) ELSE first(k ORDER BY close, k) END AS max_excursion_bars, coalesce(last(close ORDER BY k), any_value(breakout_price)) AS close_after_n_bars,
  coalesce(max(close) - min(close), 0) AS retracement_depth, CASE WHEN count(close) = 0 THEN 0 WHEN any_value(direction) = 'up' THEN first(k ORDER BY close, k) ELSE first(k ORDER BY close DESC, k) END AS retracement_bars,
  min(CASE WHEN (direction = 'up' AND close <= b) OR (direction = 'down' AND close >= b) THEN k END) AS time_to_retest_boundary,
  min(CASE WHEN (direction = 'up' AND close < b) OR (direction = 'down' AND close > b) THEN k END) AS failure_bars_from_breakout, coalesce(sum(step) / count(close), 0) AS post_breakout_volatility, coalesce(avg(volume), 0) AS post_breakout_volume_mean FROM nx GROUP BY instrument, range_id)"""
)
ROTATIONS = (
    BARS
    + """, d1 AS (SELECT *, lag(time) OVER s AS pt, lag(volume) OVER s AS pv, lag(delta) OVER s AS pd, CASE WHEN high > ph THEN 'up' WHEN low < pl THEN 'down' END AS own FROM ib WINDOW s AS (PARTITION BY instrument ORDER BY time)),
d2 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS direction FROM d1),
d3 AS (SELECT *, CASE WHEN direction IS NOT NULL AND direction IS DISTINCT FROM lag(direction) OVER (PARTITION BY instrument ORDER BY time) THEN 1 ELSE 0 END AS turned FROM d2),
d4 AS (SELECT *, sum(turned) OVER (PARTITION BY instrument ORDER BY time) - 1 AS rotation_index FROM d3 WHERE direction IS NOT NULL),
ro AS (SELECT instrument, rotation_index, any_value(direction) AS direction, min(bar_index) - 1 AS start_index, max(bar_index) AS end_index, first(pt ORDER BY time) AS start_time, max(time) AS end_time, first(pc ORDER BY time) AS start_price,
  last(close ORDER BY time) AS end_price, count(*) + 1 AS bar_count, sum(volume) + first(pv ORDER BY time) AS volume, sum(delta) + first(pd ORDER BY time) AS delta FROM d4 GROUP BY instrument, rotation_index)"""
)
TYPICAL = "(high + low + close) / 3"
SESSIONS = "(VALUES ('asia', 60, 600), ('europe', 540, 1050), ('usa', 930, 1320)) AS s(session_name, a, z)"
BYSESSION = BARS + f", sb AS (SELECT bars.*, CAST(time AS DATE) AS date, session_name FROM bars JOIN {SESSIONS} ON hour(time) * 60 + minute(time) >= a AND hour(time) * 60 + minute(time) < z)"


def six_places(x):
    """Halves away from zero, as in the SQL, without leaving generated code."""
    near = F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6
    return F.when(F.abs(x) < 1e12, near).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    return df.select([six_places(c(f.name).cast("double")).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema])


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


# --- metrics and filters ---------------------------------------------------------------------------------------------


def _metric(name: str, query: dict, sql: str) -> None:
    register(name, lambda s, d: spec.run(facts(s, d), query), f"WITH {FACTS} {sql}")


SUCCESS = {"target_field": "breakout_type", "success_condition": {"operator": "!=", "value": "false_breakout"}}
RATE = "avg(CASE WHEN breakout_type IS NOT NULL THEN CASE WHEN breakout_type <> 'false_breakout' THEN 1.0 ELSE 0.0 END END)"
for key in (None, "direction"):
    end, head, by = ("", "", {}) if key is None else ("_grouped", f"{key}, ", {"group_by": [key]})
    tail = "" if key is None else f" GROUP BY {key}"
    _metric(f"metric_count{end}", {"metric": "count", **by}, f"SELECT {head}count(*) AS rows_total, count(*) AS rows_valid, count(*) AS result FROM f{tail}")
    for metric, made in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop")):
        _metric(f"metric_{metric}{end}", {"metric": metric, "value_field": "max_excursion", **by}, f"SELECT {head}count(*) AS rows_total, count(mx) AS rows_valid, round({made}(mx), 6) AS result FROM f{tail}")
    _metric(f"metric_rate{end}", {"metric": "success_rate", **SUCCESS, **by}, f"SELECT {head}count(*) AS rows_total, count(breakout_type) AS rows_valid, round({RATE}, 6) AS result FROM f{tail}")
    _metric(
        f"metric_probability{end}",
        {"metric": "probability", "event_predicate": {"field": "max_excursion", "operator": ">", "value": 5}, "condition_predicate": {"field": "breakout_type", "operator": "==", "value": "clean"}, **by},
        f"SELECT {head}count(*) AS rows_total, count(breakout_type) AS rows_valid, count(*) FILTER (breakout_type = 'clean' AND mx IS NOT NULL) AS condition_count, count(*) FILTER (breakout_type = 'clean' AND mx > 5) AS event_and_condition_count, round(count(*) FILTER (breakout_type = 'clean' AND mx > 5) / nullif(count(*) FILTER (breakout_type = 'clean' AND mx IS NOT NULL), 0), 6) AS result FROM f{tail}",
    )
_metric("metric_mean_of_boolean", {"metric": "mean", "value_field": "is_failed", "group_by": ["breakout_type"]}, "SELECT breakout_type, count(*) AS rows_total, count(is_failed) AS rows_valid, round(avg(CASE WHEN is_failed THEN 1.0 ELSE 0 END), 6) AS result FROM f GROUP BY ALL")
_metric("metric_distribution", {"metric": "distribution", "value_field": "breakout_type", "group_by": ["direction"]}, "SELECT direction, breakout_type AS value, count(*) AS n FROM f WHERE breakout_type IS NOT NULL GROUP BY ALL")
_metric("metric_distribution_text", {"metric": "distribution", "value_field": "is_failed"}, "SELECT CASE WHEN is_failed THEN 'True' ELSE 'False' END AS value, count(*) AS n FROM f GROUP BY ALL")
_metric("metric_distribution_share", {"metric": "distribution", "value_field": "breakout_type", "group_by": ["direction"], "normalization": "share_of_valid_rows"}, "SELECT direction, breakout_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY direction), 6) AS share FROM f WHERE breakout_type IS NOT NULL GROUP BY direction, breakout_type")
for way in ("asc", "desc"):
    _metric(f"metric_ranking_{way}", {"metric": "ranking", "score_metric": "median", "value_field": "max_excursion", "group_by": ["total_score"], "sort_direction": way}, f"SELECT row_number() OVER (ORDER BY result {way}, 'total_score=' || total_score) AS rank, * FROM (SELECT score AS total_score, count(*) AS rows_total, round(median(mx), 6) AS result FROM f GROUP BY score HAVING median(mx) IS NOT NULL)")
for name, operator, value, sql in (
    ("eq", "==", 5.5, "mx = 5.5"), ("ne", "!=", 5.5, "mx <> 5.5"), ("gt", ">", 5, "mx > 5"), ("ge", ">=", 5, "mx >= 5"), ("lt", "<", 2, "mx < 2"), ("le", "<=", 2, "mx <= 2"),
    ("in", "in", [1.5, None, "x", 3], "mx IN (1.5, 3)"), ("not_in", "notin", [1.5, 3], "mx NOT IN (1.5, 3)"), ("between", "between", (2, 4), "mx BETWEEN 2 AND 4"), ("isnull", "isnull", None, "mx IS NULL"), ("notnull", "notnull", None, "mx IS NOT NULL"),
    ("type_mismatch", "!=", "text", "mx IS NOT NULL"),
):
    _metric(f"filter_{name}", {"metric": "count", "group_by": ["breakout_type"], "filters": [{"field": "max_excursion", "operator": operator, "value": value}, {"field": "direction", "operator": "==", "value": "up"}]}, f"SELECT breakout_type, count(*) AS rows_total, count(*) AS rows_valid, count(*) AS result FROM f WHERE {sql} AND direction = 'up' GROUP BY ALL")

# --- calendar studies ------------------------------------------------------------------------------------------------

NAMES = {"day_of_month": "dom AS day_of_month", "week_of_month": "wom AS week_of_month"}
for name, (keys, filters, measure, _) in cal.STUDIES.items():
    made = "round(avg(atr), 6) AS avg_atr_before_pts" if measure == "atr" else "round(avg(success), 6) AS p_success_1atr"
    where = " WHERE weekday = 'Monday' AND dom <= 7" if filters else ""
    register(name, lambda s, d, name=name: cal.calendar(cal.enriched(facts(s, d)), name), f"WITH {FACTS} SELECT {', '.join(NAMES.get(k, k) for k in keys)}, count(*) AS n, {made} FROM g{where} GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}")
register("calendar_best_worst", lambda s, d: cal.best_and_worst(cal.enriched(facts(s, d)), "month", "atr"), f"WITH {FACTS}, m AS (SELECT month, avg(atr) AS v FROM g GROUP BY month) SELECT first(month ORDER BY v DESC, month) AS best, round(max(v), 6) AS best_value, first(month ORDER BY v, month) AS worst, round(min(v), 6) AS worst_value FROM m")
register("calendar_compare", lambda s, d: cal.compare(cal.enriched(facts(s, d)), "weekday", "Monday", "Friday", "success"), f"WITH {FACTS}, m AS (SELECT weekday, avg(success) AS v FROM g GROUP BY weekday), w AS (SELECT max(v) FILTER (weekday = 'Monday') AS a, max(v) FILTER (weekday = 'Friday') AS b FROM m) SELECT round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS difference FROM w")
register("calendar_quantile", lambda s, d: spec.study(cal.enriched(facts(s, d)), ["month"], "quantile", "max_excursion", "q90", quantile=0.9), f"WITH {FACTS} SELECT month, count(*) AS n, round(quantile_cont(mx, 0.9), 6) AS q90 FROM g GROUP BY month")
register("volume_quartiles", lambda s, d: facts(s, d).withColumn("q", F.ntile(4).over(W.partitionBy(F.month("breakout_time")).orderBy("initial_volume", "breakout_id"))).groupBy(F.month("breakout_time").alias("month"), "q").agg(F.count(F.lit(1)).alias("n"), F.min("initial_volume").alias("least"), F.max("initial_volume").alias("most")), f"WITH {FACTS}, q AS (SELECT month(t) AS month, volume, ntile(4) OVER (PARTITION BY month(t) ORDER BY volume, breakout_id) AS q FROM f) SELECT month, q, count(*) AS n, min(volume) AS least, max(volume) AS most FROM q GROUP BY ALL")

# --- features, buckets, targets --------------------------------------------------------------------------------------


def _ratio(a: str, b_: str) -> str:
    return f"round(CASE WHEN {b_} > 0 THEN {a} / {b_} END, 6)"


register(
    "feature_ratios",
    lambda s, d: feat.ratios(facts(s, d)).select("breakout_id", "side", "range_atr_ratio", "balance_pressure", "breakout_location_ratio", "abs_initial_delta", "volume_atr_ratio", "volume_range_ratio", "breakout_efficiency"),
    f"WITH {FACTS} SELECT breakout_id, CASE direction WHEN 'up' THEN 'long' WHEN 'down' THEN 'short' END AS side, {_ratio('size', 'atr')} AS range_atr_ratio, {_ratio('atr', 'size')} AS balance_pressure, {_ratio('(price - mid)', 'size')} AS breakout_location_ratio, round(abs(delta), 6) AS abs_initial_delta, {_ratio('volume', 'atr')} AS volume_atr_ratio, {_ratio('volume', 'size')} AS volume_range_ratio, {_ratio('mx', 'atr')} AS breakout_efficiency FROM f",
)
register(
    "feature_calendar",
    lambda s, d: feat.calendar_columns(table(s, d, "events"), "ts").select("event_id", "hour", "session_calc", "weekday", "day_of_month", "week_of_month", "year"),
    "WITH e AS (SELECT *, hour(ts) + minute(ts) / 60 + floor(second(ts)) / 3600 AS h FROM events) SELECT event_id, round(h, 6) AS hour, CASE WHEN h < 8 THEN 'asia' WHEN h < 13 THEN 'europe' WHEN h < 21 THEN 'ny' ELSE 'off' END AS session_calc, lower(dayname(ts)) AS weekday, day(ts) AS day_of_month, (day(ts) - 1) // 7 + 1 AS week_of_month, year(ts) AS year FROM e",
)
SOURCE = {"compression_bucket": "CASE WHEN atr > 0 THEN size / atr END", "delta_bucket": "abs(delta)", "volume_bucket": "volume", "atr_bucket": "atr", "pre_bo_bucket": "score", "time_bucket": "h"}
for name, (_, bounds, labels) in feat.BUCKETS.items():
    ends = [*bounds[1:], None]
    tests = " ".join(f"WHEN {'TRUE' if low == float('-inf') else f'x > {low}' if name == 'atr_bucket' and k == 0 else f'x >= {low}'} AND {'x IS NOT NULL' if end is None else f'x < {end}'} THEN '{label}'" for k, (low, end, label) in enumerate(zip(bounds, ends, labels, strict=True)))
    rows = f"f AS (SELECT event_id AS breakout_id, hour(ts) + minute(ts) / 60 + floor(second(ts)) / 3600 AS h FROM events)" if name == "time_bucket" else FACTS
    make = (lambda s, d: feat.bucketed(feat.calendar_columns(table(s, d, "events").withColumnRenamed("event_id", "breakout_id"), "ts"), "time_bucket").select("breakout_id", "time_bucket")) if name == "time_bucket" else (lambda s, d, name=name: feat.bucketed(feat.ratios(facts(s, d)), name).select("breakout_id", name))
    register("bucket_" + name.replace("pre_bo", "pre").removesuffix("_bucket"), make, f"WITH {rows}, x AS (SELECT breakout_id, {SOURCE[name]} AS x FROM f) SELECT breakout_id, CASE {tests} END AS {name} FROM x")
register("outcome_label", lambda s, d: feat.outcome(facts(s, d)).groupBy("breakout_type", "breakout_outcome").agg(F.count(F.lit(1)).alias("n")), f"WITH {FACTS} SELECT breakout_type, CASE WHEN breakout_type IN ('false_breakout', 'failed_follow_through') THEN breakout_type ELSE 'true_breakout' END AS breakout_outcome, count(*) AS n FROM f GROUP BY ALL")
register("target_primary", lambda s, d: feat.primary_target(facts(s, d), 1.0).select("breakout_id", "target_primary"), f"WITH {FACTS} SELECT breakout_id, CASE WHEN atr > 0 THEN coalesce(mx >= atr, FALSE) END AS target_primary FROM f")
register("target_secondary", lambda s, d: feat.tick_target(facts(s, d), 12, 0.25).select("breakout_id", "target_secondary"), f"WITH {FACTS} SELECT breakout_id, coalesce(mx >= 3.0, FALSE) AS target_secondary FROM f")
register("target_atr_scan", lambda s, d: feat.atr_scan(facts(s, d), 0.5, 1.5, 0.5).select("breakout_id", "t1_0_5ATR", "t1_1_0ATR", "t1_1_5ATR"), f"WITH {FACTS} SELECT breakout_id, coalesce(mx >= 0.5 * atr, FALSE) AS t1_0_5ATR, coalesce(mx >= atr, FALSE) AS t1_1_0ATR, coalesce(mx >= 1.5 * atr, FALSE) AS t1_1_5ATR FROM f")
register("target_tick_scan", lambda s, d: feat.tick_scan(facts(s, d), [4, 16], 0.25).select("breakout_id", "t2_4ticks", "t2_16ticks"), f"WITH {FACTS} SELECT breakout_id, coalesce(mx >= 1, FALSE) AS t2_4ticks, coalesce(mx >= 4, FALSE) AS t2_16ticks FROM f")
register("target_clean", lambda s, d: feat.clean_quant(feat.clean_ticks(feat.primary_target(facts(s, d), 1.0), [8], 0.25, 0.5), "target_primary", 0.4).select("breakout_id", "t2_8ticks_clean", "clean_quant", "clean_label"), f"WITH {FACTS}, x AS (SELECT *, CASE WHEN atr > 0 THEN coalesce(mx >= atr, FALSE) END AND coalesce(depth / CASE WHEN mx > 0 THEN mx END <= 0.4, FALSE) AS q FROM f) SELECT breakout_id, coalesce(mx >= 2 AND depth <= 0.5 * atr, FALSE) AS t2_8ticks_clean, q AS clean_quant, CASE WHEN q THEN 'clean' WHEN NOT q THEN 'not_clean' END AS clean_label FROM x")
register("payload_parse", lambda s, d: table(s, d, "events").select("event_id", scalars.payload(F.regexp_replace("props", '"', "'"), "k int")["k"].alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
register("union_sources", lambda s, d: sinks.aligned(facts(s, d).where("direction = 'up'").select("breakout_id", "direction"), [("breakout_id", "long"), ("direction", "string"), ("side", "string")]).unionByName(feat.ratios(facts(s, d)).where("direction = 'down'").select("breakout_id", "side"), allowMissingColumns=True), f"WITH {FACTS} SELECT breakout_id, direction, CAST(NULL AS VARCHAR) AS side FROM f WHERE direction = 'up' UNION ALL SELECT breakout_id, NULL, 'short' FROM f WHERE direction = 'down'")

# --- bars ------------------------------------------------------------------------------------------------------------

register("bars_hourly", lambda s, d: bars(s, d).drop("timeframe"), f"WITH {BARS} SELECT * EXCLUDE (timeframe) FROM bars")
register("bars_quarter_hour", lambda s, d: bars(s, d, "15 minutes").drop("timeframe"), f"WITH {QUARTERS} SELECT * EXCLUDE (timeframe) FROM bars")
register("bars_valid", lambda s, d: faults(bars(s, d)), f"WITH {BARS} SELECT count(*) AS bars, 0 AS missing, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS insane, count(*) - count(DISTINCT (instrument, time)) AS repeated FROM bars")
register("true_range", lambda s, d: b.with_true_range(bars(s, d)).select("instrument", "time", "tr", "tr_after"), f"WITH {BARS} SELECT instrument, time, round(coalesce(tr, high - low), 6) AS tr, round(tra, 6) AS tr_after FROM tr")
register("atr_partial", lambda s, d: b.atr_partial(bars(s, d)).select("instrument", "time", "atr"), f"WITH {BARS} SELECT instrument, time, round(coalesce(avg(tra) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0), 6) AS atr FROM tr")
register("atr_strict", lambda s, d: b.atr_strict(bars(s, d)).select("instrument", "time", "atr"), f"WITH {BARS}, x AS (SELECT instrument, time, coalesce(tr, high - low) AS v FROM tr) SELECT instrument, time, round(CASE WHEN count(v) OVER w = 14 THEN avg(v) OVER w END, 6) AS atr FROM x WINDOW w AS (PARTITION BY instrument ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)")
register("forward_extrema_long", lambda s, d: b.forward_extrema(bars(s, d), 500).select("instrument", "time", "next_high", "next_low", "next_bars"), f"WITH {BARS} SELECT instrument, time, max(high) OVER w AS next_high, min(low) OVER w AS next_low, count(*) OVER w AS next_bars FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 500 FOLLOWING)")
register("lead_atr", lambda s, d: b.lead_atr(bars(s, d)).select("instrument", "time", "atr_after"), f"WITH {BARS}, x AS (SELECT instrument, time, coalesce(avg(tra) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS atr FROM tr) SELECT instrument, time, round(coalesce(lead(atr, 5) OVER (PARTITION BY instrument ORDER BY time), last_value(atr) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS atr_after FROM x")
register("trailing_means", lambda s, d: b.trailing_means(bars(s, d)).select("instrument", "time", "mean_abs_delta", "mean_volume"), f"WITH {BARS} SELECT instrument, time, round(avg(abs(delta)) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS mean_abs_delta, round(avg(volume) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 6) AS mean_volume FROM bars")
register("forward_extrema", lambda s, d: b.forward_extrema(bars(s, d), 12).select("instrument", "time", "next_high", "next_low", "next_bars"), f"WITH {BARS} SELECT instrument, time, max(high) OVER w AS next_high, min(low) OVER w AS next_low, count(*) OVER w AS next_bars FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)")

register(
    "quantiles_selected",
    lambda s, d: selection.grouped(facts(s, d), ["direction"], c("breakout_price"), {"q10": 0.1, "median": 0.5, "q99": 0.99}, [F.count("breakout_price").alias("n")], 1000),
    f"WITH {FACTS} SELECT direction, count(price) AS n, round(quantile_cont(price, 0.1), 6) AS q10, round(median(price), 6) AS median, round(quantile_cont(price, 0.99), 6) AS q99 FROM f GROUP BY direction",
)

# --- rotations, balances ---------------------------------------------------------------------------------------------

KIND = "CASE WHEN bar_count >= 5 THEN 'structural' WHEN bar_count >= 3 THEN 'standard' ELSE 'micro' END"
register("rotations", lambda s, d: rot.rotations(bars(s, d)).drop("timeframe", "valid"), f"WITH {ROTATIONS} SELECT instrument, rotation_index, direction, start_index, end_index, start_time, end_time, round(start_price, 6) AS start_price, round(end_price, 6) AS end_price, bar_count, round(volume, 6) AS volume, round(delta, 6) AS delta, round(abs(end_price - start_price), 6) AS amplitude, {KIND} AS rotation_type FROM ro")
register("rotation_whipsaw", lambda s, d: rot.rotations(bars(s, d), 5.0, 2, 2).select("instrument", "rotation_index", "valid"), f"WITH {ROTATIONS} SELECT instrument, rotation_index, abs(end_price - start_price) >= 5 AND NOT (bar_count <= 2 AND (coalesce(lag(bar_count) OVER w, 99) <= 2 OR coalesce(lead(bar_count) OVER w, 99) <= 2)) AS valid FROM ro WINDOW w AS (PARTITION BY instrument ORDER BY rotation_index)")


# --- breakouts -------------------------------------------------------------------------------------------------------


def ranges(s: SparkSession, d: str) -> DataFrame:
    """A range for each instrument and day, the closes of its first two bars: what the breakout queries start from."""
    w = W.partitionBy("instrument", "timeframe", F.to_date("time")).orderBy("time")
    first = indexed(bars(s, d)).withColumn("k", F.row_number().over(w)).where("k <= 2")
    return first.groupBy("instrument", "timeframe", F.concat_ws("_", "instrument", F.date_format("time", "yyyy-MM-dd")).alias("range_id")).agg(F.max("close").alias("high"), F.min("close").alias("low"), F.max("bar_index").alias("end_index"), F.min("time").alias("start_time"))


def events(s: SparkSession, d: str, mode: str = "close_only") -> DataFrame:
    return bo.breakouts(bars(s, d), ranges(s, d), mode)


EVENT = "instrument, range_id, bar_index, breakout_time, round(breakout_price, 6) AS breakout_price, direction, round(boundary_price, 6) AS boundary_price"
BODY = "greatest(i.open, i.close)", "least(i.open, i.close)"
for mode, up, down in (
    ("strict", "i.low > range_high", "i.high < range_low"),
    ("close_only", "i.close > range_high", "i.close < range_low"),
    ("body_50", f"{BODY[0]} > {BODY[1]} AND greatest({BODY[0]} - range_high, range_low - {BODY[1]}, 0) >= 0.5 * ({BODY[0]} - {BODY[1]}) AND greatest({BODY[0]} - range_high, 0) > greatest(range_low - {BODY[1]}, 0)", f"{BODY[0]} > {BODY[1]} AND greatest({BODY[0]} - range_high, range_low - {BODY[1]}, 0) >= 0.5 * ({BODY[0]} - {BODY[1]})"),
):
    register(f"breakout_{mode}", lambda s, d, mode=mode: events(s, d, mode).select("instrument", "range_id", "bar_index", "breakout_time", "breakout_price", "direction", "boundary_price"), f"WITH {_break(up, down)} SELECT {EVENT} FROM ev")
FT = ["max_excursion", "max_excursion_bars", "close_after_n_bars", "retracement_depth", "retracement_bars", "time_to_retest_boundary", "failure_bars_from_breakout", "post_breakout_volatility", "post_breakout_volume_mean"]
register("follow_through", lambda s, d: bo.follow_through(events(s, d), bars(s, d)).select("instrument", "range_id", *FT), f"WITH {FOLLOW} SELECT instrument, range_id, {', '.join(f'round({x}, 6) AS {x}' if x in (FT[0], FT[2], FT[3], FT[7], FT[8]) else x for x in FT)} FROM ft")
CLASS = "CASE WHEN max_excursion <= 0 OR coalesce(CASE WHEN size > 0 THEN max_excursion / size END, 0) < 0.3 THEN 'failed_follow_through' WHEN failure_bars_from_breakout IS NOT NULL OR retracement_depth / max_excursion >= 0.8 THEN 'false_breakout' WHEN time_to_retest_boundary <= 20 THEN 'with_retest' WHEN max_excursion_bars >= 15 THEN 'accumulation' ELSE 'clean' END"
register("classification", lambda s, d: bo.classified(bo.follow_through(events(s, d), bars(s, d), 6)).select("instrument", "range_id", "breakout_type", "is_failed", "is_retest_occurred"), f"WITH {FOLLOW.replace('e.bar_index + 40', 'e.bar_index + 6')}, k AS (SELECT *, {CLASS} AS breakout_type FROM ft) SELECT instrument, range_id, breakout_type, breakout_type IN ('failed_follow_through', 'false_breakout') AS is_failed, breakout_type = 'with_retest' AS is_retest_occurred FROM k")
register(
    "confirmation_run",
    lambda s, d: bo.confirmed(events(s, d), bars(s, d)).select("instrument", "range_id", "confirmation_bar_index", "confirmation_price"),
    f"WITH {FOLLOW}, q AS (SELECT *, CASE WHEN (direction = 'up' AND close > b) OR (direction = 'down' AND close < b) THEN 1 ELSE 0 END AS o FROM nx WHERE k < 10), w AS (SELECT *, o = 1 AND lag(o) OVER (PARTITION BY instrument, range_id ORDER BY k) = 1 AS two FROM q), m AS (SELECT instrument, range_id, min(bar_index + 1 + k) AS i, first(close ORDER BY k) AS p FROM w WHERE two GROUP BY ALL) SELECT ev.instrument, ev.range_id, m.i AS confirmation_bar_index, round(m.p, 6) AS confirmation_price FROM ev LEFT JOIN m USING (instrument, range_id)",
)
SCORES = ["momentum_score", "delta_imbalance_score", "volume_spike_score", "volatility_score", "distance_from_vpoc_score", "hvn_lvn_break_score"]
STRENGTH = (
    f"{CLOSE_ONLY}, x AS (SELECT instrument, bar_index, pc, open, coalesce(avg(tra) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS atr, avg(abs(delta)) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS md, avg(volume) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS mv FROM tr), "
    "y AS (SELECT ev.instrument, range_id, direction, greatest(range_high - range_low, 1e-6) AS z, breakout_price AS p, (range_high + range_low) / 2 AS mid, initial_delta AS dl, initial_volume AS v, atr, md, mv, coalesce(pc, x.open) AS before FROM ev JOIN x USING (instrument, bar_index)), "
    "k AS (SELECT instrument, range_id, least(abs(p - before) / z, 1) AS momentum_score, least(CASE WHEN md > 0 THEN abs(dl) / md ELSE 0 END, 3) / 3 AS delta_imbalance_score, least(CASE WHEN mv > 0 THEN v / mv ELSE 0 END, 3) / 3 AS volume_spike_score, least(atr / z, 1) AS volatility_score, least(abs(p - mid) / (0.5 * z), 1) AS distance_from_vpoc_score, 0.0 AS hvn_lvn_break_score FROM y), "
    f"t AS (SELECT *, {' + '.join(SCORES[:4])} + 0.7 * distance_from_vpoc_score AS w, 2 * momentum_score + delta_imbalance_score + volume_spike_score + 0.7 * distance_from_vpoc_score AS u FROM k)"
)
register("strength", lambda s, d: bo.strength(events(s, d), bars(s, d)).select("instrument", "range_id", *SCORES, "overall_strength_score", "overall_strength_normalized"), f"WITH {STRENGTH} SELECT instrument, range_id, {', '.join(f'round({x}, 6) AS {x}' for x in SCORES)}, round(w, 6) AS overall_strength_score, round(greatest(least(w / 5, 1), 0), 6) AS overall_strength_normalized FROM t")
for method, made in (("sigmoid", "1 / (1 + exp(-u))"), ("tanh", "(tanh(u) + 1) / 2")):
    register(f"strength_{method}", lambda s, d, method=method: bo.strength(events(s, d), bars(s, d), method=method, use_atr=False).select("instrument", "range_id", "volatility_score", "overall_strength_normalized"), f"WITH {STRENGTH} SELECT instrument, range_id, round(momentum_score, 6) AS volatility_score, round({made}, 6) AS overall_strength_normalized FROM t")
register("session_rank", lambda s, d: bo.ranked(bo.strength(events(s, d), bars(s, d)).withColumn("overall_strength_score", F.round("momentum_score", 3))).select("instrument", "range_id", "global_rank", "session_rank"), f"WITH {CLOSE_ONLY}, y AS (SELECT ev.instrument, range_id, breakout_time, round(least(abs(breakout_price - coalesce(pc, ib.open)) / greatest(range_high - range_low, 1e-6), 1), 3) AS w FROM ev JOIN ib USING (instrument, bar_index)) SELECT instrument, range_id, rank() OVER (PARTITION BY instrument ORDER BY w DESC) AS global_rank, rank() OVER (PARTITION BY instrument, CAST(breakout_time AS DATE) ORDER BY w DESC) AS session_rank FROM y")


def _early(s: SparkSession, d: str) -> DataFrame:
    found = events(s, d).join(ranges(s, d).select("range_id", "start_time"), "range_id")
    return bo.early_signs(found, bars(s, d, "15 minutes"), "start_time", 2, max_lead_minutes=180).select("instrument", "range_id", "early_time", "early_price", "lead_minutes")


LOWER = "lb AS (SELECT event_type AS instrument, time_bucket(INTERVAL 15 MINUTE, ts) AS lt, last(value ORDER BY ts, event_id) AS lc FROM events GROUP BY ALL)"
register("early_detection", _early, f"WITH {CLOSE_ONLY}, {LOWER}, q AS (SELECT ev.instrument, range_id, breakout_time, lt, lc, CASE WHEN (direction = 'up' AND lc > boundary_price) OR (direction = 'down' AND lc < boundary_price) THEN 1 ELSE 0 END AS o FROM ev JOIN lb ON lb.instrument = ev.instrument AND lt >= ev.start_time AND lt < breakout_time), w AS (SELECT *, o = 1 AND lag(o) OVER p = 1 AS two, lag(lt) OVER p AS t0, lag(lc) OVER p AS c0 FROM q WINDOW p AS (PARTITION BY instrument, range_id ORDER BY lt)), m AS (SELECT instrument, range_id, any_value(breakout_time) AS bt, first(t0 ORDER BY lt) AS t0, first(c0 ORDER BY lt) AS c0 FROM w WHERE two GROUP BY instrument, range_id) SELECT instrument, range_id, t0 AS early_time, round(c0, 6) AS early_price, round(date_diff('second', t0, bt) / 60, 6) AS lead_minutes FROM m WHERE date_diff('second', t0, bt) / 60 <= 180")


def _rotation_context(s: SparkSession, d: str) -> DataFrame:
    r = rot.rotations(bars(s, d)).withColumn("range_id", F.concat_ws("_", "instrument", F.date_format("start_time", "yyyy-MM-dd")))
    return bo.rotation_context(events(s, d), r).drop("total_delta", "total_volume", "last_rotation_direction", "last_rotation_type", "last_rotation_delta", "last_rotation_volume", "last_rotation_valid")


register(
    "rotation_context",
    _rotation_context,
    f"WITH {CLOSE_ONLY}, {ROTATIONS.removeprefix(BARS + ', ')}, r AS (SELECT *, instrument || '_' || strftime(start_time, '%Y-%m-%d') AS range_id, {KIND} AS kind FROM ro), j AS (SELECT 'bo_' || ev.range_id || '_' || ev.bar_index AS breakout_id, ev.direction AS way, r.* FROM ev LEFT JOIN r ON r.range_id = ev.range_id WHERE r.end_time IS NULL OR r.end_time <= ev.breakout_time), "
    "k AS (SELECT *, abs(delta) * CASE kind WHEN 'micro' THEN 0.5 WHEN 'structural' THEN 1.5 ELSE 1 END AS w FROM j) SELECT breakout_id, count(rotation_index) AS total_rotations, count(rotation_index) AS valid_rotations, count(*) FILTER (kind = 'micro' AND rotation_index IS NOT NULL) AS micro_count, count(*) FILTER (kind = 'standard' AND rotation_index IS NOT NULL) AS standard_count, count(*) FILTER (kind = 'structural' AND rotation_index IS NOT NULL) AS structural_count, count(*) FILTER (direction = 'up') AS up_count, count(*) FILTER (direction = 'down') AS down_count, round(coalesce(sum(CASE WHEN direction = way THEN w ELSE 0 END) / nullif(sum(w), 0), 0), 6) AS rotation_alignment_score, round((count(*) FILTER (direction = 'up') - count(*) FILTER (direction = 'down')) / greatest(count(rotation_index), 1), 6) AS directional_bias, round(count(rotation_index) / greatest(count(rotation_index), 1), 6) AS validity_ratio, round(count(*) FILTER (kind = 'structural' AND rotation_index IS NOT NULL) / greatest(count(rotation_index), 1), 6) AS structural_ratio FROM k GROUP BY breakout_id",
)

# --- levels ----------------------------------------------------------------------------------------------------------

DAYS = ["instrument", "date"]


def dated(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d).withColumn("date", F.to_date("time"))


VP = f"vp AS (SELECT instrument, CAST(time AS DATE) AS date, round_even({TYPICAL} / 25, 0) * 25 AS price, sum(volume) AS volume FROM bars GROUP BY ALL)"
register("volume_profile", lambda s, d: levels.volume_profile(dated(s, d), DAYS, 25.0), f"WITH {BARS}, {VP} SELECT instrument, date, price, round(volume, 6) AS volume FROM vp")
register("poc", lambda s, d: levels.value_area(levels.volume_profile(dated(s, d), DAYS, 25.0), DAYS).select(*DAYS, "poc"), f"WITH {BARS}, {VP} SELECT instrument, date, first(price ORDER BY volume DESC, price) AS poc FROM vp GROUP BY instrument, date")
register(
    "value_area",
    lambda s, d: levels.value_area(levels.volume_profile(dated(s, d), DAYS, 25.0), DAYS),
    f"WITH RECURSIVE {BARS}, {VP}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY price) AS k, sum(volume) OVER (PARTITION BY instrument, date) AS t, count(*) OVER (PARTITION BY instrument, date) AS m FROM vp), p AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY instrument, date ORDER BY volume DESC, price) = 1), "
    "w AS (SELECT instrument, date, price AS poc, k AS l, k AS r, volume AS v, t, m FROM p UNION ALL SELECT w.instrument, w.date, poc, CASE WHEN coalesce(b.volume, -1) >= coalesce(a.volume, -1) THEN l ELSE l - 1 END, CASE WHEN coalesce(b.volume, -1) >= coalesce(a.volume, -1) THEN r + 1 ELSE r END, v + CASE WHEN coalesce(b.volume, -1) >= coalesce(a.volume, -1) THEN b.volume ELSE a.volume END, w.t, w.m FROM w LEFT JOIN n a ON a.instrument = w.instrument AND a.date = w.date AND a.k = l - 1 LEFT JOIN n b ON b.instrument = w.instrument AND b.date = w.date AND b.k = r + 1 WHERE v / w.t < 0.7 AND (a.k IS NOT NULL OR b.k IS NOT NULL)), "
    "z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY instrument, date ORDER BY r - l DESC) = 1) SELECT z.instrument, z.date, poc, h.price AS vah, g.price AS val FROM z JOIN n h ON h.instrument = z.instrument AND h.date = z.date AND h.k = r JOIN n g ON g.instrument = z.instrument AND g.date = z.date AND g.k = l",
)
register("vwap_both", lambda s, d: dated(s, d).groupBy(*DAYS).agg(levels.vwap(levels.typical()).alias("vwap"), levels.vwap(c("close")).alias("vwap_close")), f"WITH {BARS} SELECT instrument, CAST(time AS DATE) AS date, round(sum({TYPICAL} * volume) / sum(volume), 6) AS vwap, round(sum(close * volume) / sum(volume), 6) AS vwap_close FROM bars GROUP BY ALL")
register("session_ohlc", lambda s, d: levels.ohlc(levels.by_session(bars(s, d)), [*DAYS, "session_name"]), f"WITH {BYSESSION} SELECT instrument, date, session_name, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close, round(sum(volume), 6) AS volume, round(sum({TYPICAL} * volume) / sum(volume), 6) AS vwap, round(sum(close * volume) / sum(volume), 6) AS vwap_close FROM sb GROUP BY ALL")
register("prev_day_join", lambda s, d: dated(s, d).select(*DAYS).distinct().join(levels.previous_day(bars(s, d), 25.0), DAYS, "left").select(*DAYS, "prev_day_high", "prev_day_low", "prev_day_poc", "prev_day_vwap"), f"WITH {BARS}, {VP}, d AS (SELECT instrument, CAST(time AS DATE) AS date, max(high) AS h, min(low) AS l, sum(close * volume) / sum(volume) AS w FROM bars GROUP BY ALL), p AS (SELECT instrument, date, first(price ORDER BY volume DESC, price) AS poc FROM vp GROUP BY ALL) SELECT d.instrument, d.date, e.h AS prev_day_high, e.l AS prev_day_low, p.poc AS prev_day_poc, round(e.w, 6) AS prev_day_vwap FROM d LEFT JOIN d e ON e.instrument = d.instrument AND e.date = d.date - 1 LEFT JOIN p ON p.instrument = e.instrument AND p.date = e.date")
for name, make, period in (("week_context", levels.weekly, "yearweek(CAST(time AS DATE))"), ("month_context", levels.monthly, "date_trunc('month', time)")):
    register(name, lambda s, d, make=make: make(bars(s, d)), f"WITH {BARS}, m AS (SELECT instrument, {period} AS p, max(high) AS h, min(low) AS l, sum(close * volume) / sum(volume) AS w FROM bars GROUP BY ALL), d AS (SELECT DISTINCT instrument, CAST(time AS DATE) AS date, {period} AS p FROM bars) SELECT instrument, date, h AS {name[: name.index('_')]}ly_high, l AS {name[: name.index('_')]}ly_low, round(w, 6) AS {name[: name.index('_')]}ly_vwap FROM d JOIN m USING (instrument, p)")
register("week_context_causal", lambda s, d: levels.weekly(bars(s, d), True), f"WITH {BARS}, m AS (SELECT instrument, CAST(time AS DATE) AS date, max(high) AS h, min(low) AS l, sum(close * volume) AS pv, sum(volume) AS v FROM bars GROUP BY ALL) SELECT instrument, date, max(h) OVER w AS weekly_high, min(l) OVER w AS weekly_low, round(sum(pv) OVER w / sum(v) OVER w, 6) AS weekly_vwap FROM m WINDOW w AS (PARTITION BY instrument, yearweek(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _events_with_levels(s: SparkSession, d: str) -> DataFrame:
    placed = levels.dated_events(events(s, d))
    narrow = levels.ohlc(levels.by_session(bars(s, d)), [*DAYS, "session_name"]).select(*DAYS, F.upper("session_name").alias("session_name"), c("low").alias("session_low"), c("high").alias("session_high"), c("close").alias("session_close"))
    day = levels.ohlc(dated(s, d), DAYS).select(*DAYS, c("low").alias("day_low"), c("high").alias("day_high"))
    return levels.enriched(placed.select("range_id", "instrument", "date", "session_name", "breakout_price", "direction"), narrow.join(day, DAYS))


register("level_features", lambda s, d: _events_with_levels(s, d).select("range_id", "session_name", "ml_nearest_support", "ml_nearest_resistance", "ml_distance_to_level", "ml_cluster_strength", "ml_density", "ml_alignment_score"), None)
LEVELS = f"{CLOSE_ONLY}, sb AS (SELECT bars.*, CAST(time AS DATE) AS date, session_name, a FROM bars JOIN {SESSIONS} ON hour(time) * 60 >= a AND hour(time) * 60 < z), so AS (SELECT instrument, date, session_name, min(low) AS sl, max(high) AS sh FROM sb GROUP BY ALL), dy AS (SELECT instrument, CAST(time AS DATE) AS date, min(low) AS dl, max(high) AS dh FROM bars GROUP BY ALL)"
ORACLES["level_features"] = (
    f"WITH {LEVELS}, e AS (SELECT ev.*, CAST(breakout_time AS DATE) AS date, CASE WHEN hour(breakout_time) * 60 >= 60 AND hour(breakout_time) * 60 < 600 THEN 'asia' WHEN hour(breakout_time) * 60 >= 540 AND hour(breakout_time) * 60 < 1050 THEN 'europe' WHEN hour(breakout_time) * 60 >= 930 AND hour(breakout_time) * 60 < 1320 THEN 'usa' ELSE 'off' END AS session_name FROM ev), "
    "j AS (SELECT e.range_id, e.session_name, e.direction, breakout_price AS p, sl, sh, CASE WHEN sl IS NOT NULL THEN dl END AS dl, CASE WHEN sl IS NOT NULL THEN dh END AS dh FROM e LEFT JOIN so ON so.instrument = e.instrument AND so.date = e.date AND so.session_name = e.session_name LEFT JOIN dy ON dy.instrument = e.instrument AND dy.date = e.date), "
    "k AS (SELECT *, list_max(list_filter([sl, dl], lambda x: x <= p)) AS s, list_min(list_filter([sh, dh], lambda x: x >= p)) AS r, len(list_filter([sl, dl, sh, dh], lambda x: abs(x - p) <= 50)) AS n FROM j) "
    "SELECT range_id, session_name, s AS ml_nearest_support, r AS ml_nearest_resistance, round(least(p - s, r - p), 6) AS ml_distance_to_level, CAST(n AS DOUBLE) AS ml_cluster_strength, round(n / 50, 6) AS ml_density, round(CASE WHEN r - s = 0 THEN 0.5 WHEN direction = 'up' THEN (r - p) / (r - s) ELSE (p - s) / (r - s) END, 6) AS ml_alignment_score FROM k"
)
register("df_master_join", lambda s, d: _events_with_levels(s, d).groupBy("session_name").agg(F.count(F.lit(1)).alias("n"), F.count("session_low").alias("matched"), F.avg("session_high").alias("mean_high")), f"WITH {LEVELS}, e AS (SELECT ev.*, CAST(breakout_time AS DATE) AS date, CASE WHEN hour(breakout_time) BETWEEN 1 AND 9 THEN 'asia' WHEN hour(breakout_time) BETWEEN 10 AND 17 THEN 'europe' WHEN hour(breakout_time) BETWEEN 18 AND 21 THEN 'usa' ELSE 'off' END AS session_name FROM ev) SELECT e.session_name, count(*) AS n, count(sl) AS matched, round(avg(sh), 6) AS mean_high FROM e LEFT JOIN so ON so.instrument = e.instrument AND so.date = e.date AND so.session_name = e.session_name GROUP BY e.session_name")

# --- patterns --------------------------------------------------------------------------------------------------------

REF = [0.5, 0.2, 0.2, 0.1, 1.0, 0.6, 0.3, 0.1, 1.5, 0.9, 0.4, 0.2]
WANTED = {"price": REF, "volume": [0.8, 1.0, 1.2]}
WINDOWS = (
    BARS
    + """, w AS (SELECT instrument, time AS start_time, bar_index AS start_index, list({'o': open, 'h': high, 'l': low, 'c': close, 'v': volume}) OVER x AS w, last_value(time) OVER x AS end_time FROM ib WINDOW x AS (PARTITION BY instrument ORDER BY time ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
v AS (SELECT *, greatest(list_avg(list_transform(w, lambda b: b.h - b.l)), 1e-12) AS s, list_avg(list_transform(w, lambda b: b.v)) AS mv FROM w WHERE len(w) = 3),
u AS (SELECT *, flatten(list_transform(w, lambda b: [(b.h - b.l) / s, abs(b.c - b.o) / s, (b.h - greatest(b.o, b.c)) / s, (least(b.o, b.c) - b.l) / s])) AS p, list_transform(w, lambda b: b.v / mv) AS q FROM v)"""
)
E_SCORE = f"greatest(least(1 - (0.7 * least(list_distance(p, {[float(x) for x in REF]}::DOUBLE[]) / sqrt(12), 1) + 0.3 * least(list_distance(q, [0.8, 1.0, 1.2]::DOUBLE[]) / sqrt(3), 1)), 1), 0)"
C_SCORE = f"greatest(least(1 - (0.7 * least(list_cosine_distance(p, {[float(x) for x in REF]}::DOUBLE[]), 1) + 0.3 * least(list_cosine_distance(q, [0.8, 1.0, 1.2]::DOUBLE[]), 1)), 1), 0)"


def _similar(s: SparkSession, d: str, method: str) -> DataFrame:
    return pat.similarity(pat.windows(bars(s, d), 3), WANTED, {"price": 0.7, "volume": 0.3}, {"price": 1.0, "volume": 1.0}, method)


for method, score in (("euclidean", E_SCORE), ("cosine", C_SCORE)):
    register(f"similarity_{method}", lambda s, d, method=method: _similar(s, d, method).select("instrument", "start_time", "score"), f"WITH {WINDOWS} SELECT instrument, start_time, round({score}, 6) AS score FROM u")
FOUND = f"{WINDOWS}, m AS (SELECT instrument, start_time, end_time, start_index, start_index + 2 AS end_index, round({E_SCORE}, 6) AS score FROM u WHERE {E_SCORE} >= 0.7)"


def _found(s: SparkSession, d: str) -> DataFrame:
    return pat.matches(_similar(s, d, "euclidean"), 0.7).withColumn("score", F.round("score", 6))


register("topk_matches", lambda s, d: pat.top(_found(s, d)).select("instrument", "start_time", "end_time", "score"), f"WITH {FOUND} SELECT instrument, start_time, end_time, score FROM m ORDER BY score DESC, start_time, instrument LIMIT 10")


def _indexed_matches(s: SparkSession, d: str) -> DataFrame:
    index = pattern_index.build(pat.windows(bars(s, d), 3), 3, 3, 64)
    found, _ = pattern_index.search(index, WANTED, {"price": 0.7, "volume": 0.3}, {"price": 1.0, "volume": 1.0}, 10, 0.7)
    return found.select("instrument", "start_time", "end_time", "score")


def _refined_share(s: SparkSession, d: str) -> DataFrame:
    """How much of all windows the search looks at, for a window of the table itself."""
    windows = pat.windows(bars(s, d), 12)
    index = pattern_index.build(windows, 12, 3, 64)
    first = index.windows.orderBy("instrument", "start_index").select("price", "volume").first()
    wanted = {n: list(first[n]) for n in ("price", "volume")} if first else WANTED
    return pattern_index.search(index, wanted, {"price": 0.7, "volume": 0.3}, {"price": 1.0, "volume": 1.0})[1]


register("indexed_matches", _indexed_matches, f"WITH {WINDOWS} SELECT instrument, start_time, end_time, round({E_SCORE}, 6) AS score FROM u WHERE {E_SCORE} >= 0.7 ORDER BY {E_SCORE} DESC, start_time, instrument LIMIT 10")
register("index_refined_share", _refined_share, None)
register("match_context", lambda s, d: pat.context(_found(s, d), bars(s, d), 2, 3).groupBy("instrument", "start_index").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")), f"WITH {FOUND} SELECT m.instrument, m.start_index, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM m JOIN ib ON ib.instrument = m.instrument AND ib.bar_index BETWEEN m.start_index - 2 AND m.end_index + 3 GROUP BY ALL")
OUT = f"{FOUND}, fw AS (SELECT instrument, bar_index AS end_index, close, max(high) OVER z AS nh, min(low) OVER z AS nl, count(*) OVER z AS n FROM ib WINDOW z AS (PARTITION BY instrument ORDER BY time ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)), o AS (SELECT nh - close AS long_mfe, close - nl AS long_mae, close - nl AS short_mfe, nh - close AS short_mae FROM m JOIN fw USING (instrument, end_index) WHERE n = 5)"
STATS = "count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.9), 6) AS q90"
register("outcome_stats", lambda s, d: pat.outcome_stats(pat.outcomes(_found(s, d), bars(s, d), 5), ["long_mfe", "long_mae", "short_mfe", "short_mae"]), f"WITH {OUT} SELECT name, {STATS} FROM (UNPIVOT o ON long_mfe, long_mae, short_mfe, short_mae INTO NAME name VALUE value) GROUP BY name")
register("hit_rates", lambda s, d: pat.hit_rates(pat.outcomes(_found(s, d), bars(s, d), 5), [10, 50, 100]), f"WITH {OUT} SELECT CAST(level AS DOUBLE) AS level, round(avg(CASE WHEN long_mfe >= level THEN 1.0 ELSE 0 END), 6) AS reached, round(avg(CASE WHEN long_mae <= level THEN 1.0 ELSE 0 END), 6) AS within FROM o, (VALUES (10), (50), (100)) AS l(level) GROUP BY level")
TEMPLATE = [{"direction": "bullish", "body_ticks": 60, "upper_wick_ticks": 30, "volume": 1500}, {"direction": "any", "body_ticks": 80, "close_position": "low"}]
CANDLE = "abs(close - open) / 2 AS body, (high - greatest(open, close)) / 2 AS up, (least(open, close) - low) / 2 AS dn, CASE WHEN close > open THEN 'bullish' WHEN close < open THEN 'bearish' ELSE 'neutral' END AS way, CASE WHEN high <= low THEN 'middle' WHEN (close - low) / (high - low) >= 0.75 THEN 'high' WHEN (close - low) / (high - low) <= 0.25 THEN 'low' ELSE 'middle' END AS pos"
NEAR = lambda x, t, p: f"greatest(least(1 - abs({x} - {t}) / ({t} * {p}), 1), 0)"
register(
    "template_match",
    lambda s, d: pat.candle_scores(bars(s, d), TEMPLATE, 2.0, {"body": 50, "wick": 50, "volume": 50, "delta": 50}).select("instrument", "start_time", "end_time", "score"),
    f"WITH {BARS}, k AS (SELECT *, {CANDLE} FROM ib), n AS (SELECT instrument, time, (CASE WHEN way = 'bullish' THEN 1 ELSE 0 END + {NEAR('body', 60, 0.5)} + {NEAR('up', 30, 0.5)} + 1 + 0.5 * {NEAR('volume', 1500, 0.5)} + 0.5 + 0.75) / 5.75 AS s1, (1 + {NEAR('body', 80, 0.5)} + 1 + 1 + 0.5 + 0.5 + CASE WHEN pos = 'low' THEN 0.75 ELSE 0 END) / 5.75 AS s2 FROM k), z AS (SELECT instrument, time AS start_time, lead(time) OVER w AS end_time, (s1 + lead(s2) OVER w) / 2 AS score FROM n WINDOW w AS (PARTITION BY instrument ORDER BY time)) SELECT instrument, start_time, end_time, round(score, 6) AS score FROM z WHERE score IS NOT NULL",
)
register("asof_snap", lambda s, d: pat.snapped(bars(s, d), bars(s, d, "15 minutes").select("instrument", (c("time") + F.expr("INTERVAL 7 MINUTES")).alias("at"))), f"WITH {BARS}, {LOWER}, a AS (SELECT instrument, lt + INTERVAL 7 MINUTE AS at FROM lb) SELECT a.instrument, a.at, min(time) AS snapped FROM a LEFT JOIN bars ON bars.instrument = a.instrument AND time >= a.at GROUP BY ALL")
register("vector_distances", lambda s, d: (lambda e, q: e.select("vec_id", scalars.rms_distance(e["embedding"].cast("array<double>"), F.array(*(F.lit(x) for x in q))).alias("rms"), scalars.cosine_distance(e["embedding"].cast("array<double>"), F.array(*(F.lit(x) for x in q))).alias("cosine")))(table(s, d, "embeddings"), [((i * 7) % 11 - 5) / 10 for i in range(64)]), "SELECT vec_id, round(list_distance(embedding::DOUBLE[], q) / sqrt(64), 6) AS rms, round(list_cosine_distance(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, (SELECT list_transform(range(64), lambda i: ((i * 7) % 11 - 5) / 10) AS q)")

# --- dashboards and insights -----------------------------------------------------------------------------------------

register("dash_distribution", lambda s, d: dash.shares(facts(s, d), "breakout_type"), f"WITH {FACTS} SELECT coalesce(breakout_type, 'unknown') AS key, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM f GROUP BY 1")
register("dash_two_keys", lambda s, d: dash.shares_within(facts(s, d), "direction", "breakout_type"), f"WITH {FACTS} SELECT coalesce(direction, 'unknown') AS parent, coalesce(breakout_type, 'unknown') AS child, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY coalesce(direction, 'unknown')), 6) AS pct FROM f GROUP BY 1, 2")
register("dash_surface", lambda s, d: dash.surface(feat.bucketed(feat.bucketed(feat.ratios(facts(s, d)), "volume_bucket"), "delta_bucket"), "volume_bucket", "delta_bucket", "is_failed", "max_excursion"), f"WITH {FACTS} SELECT CASE WHEN volume < 50 THEN 'very_low' WHEN volume < 150 THEN 'low' WHEN volume < 400 THEN 'medium' WHEN volume < 800 THEN 'high' ELSE 'extreme' END AS volume_bucket, CASE WHEN abs(delta) < 100 THEN 'delta_0_100' WHEN abs(delta) < 300 THEN 'delta_100_300' WHEN abs(delta) < 600 THEN 'delta_300_600' WHEN abs(delta) < 1000 THEN 'delta_600_1000' ELSE 'delta_1000_plus' END AS delta_bucket, count(*) AS n, round(avg(CASE WHEN is_failed THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(mx), 6) AS mean_value FROM f GROUP BY 1, 2")
register("dash_outcome_pivot", lambda s, d: dash.outcome_stack(feat.outcome(facts(s, d)), "direction", "breakout_outcome", ["true_breakout", "false_breakout", "failed_follow_through"]), f"WITH {FACTS} SELECT direction, count(*) FILTER (breakout_type IS NULL OR breakout_type = 'clean') AS true_breakout, count(*) FILTER (breakout_type = 'false_breakout') AS false_breakout, count(*) FILTER (breakout_type = 'failed_follow_through') AS failed_follow_through FROM f GROUP BY direction")
register("dash_summary", lambda s, d: dash.summary(facts(s, d), "max_excursion"), f"WITH {FACTS} SELECT count(*) AS n, round(avg(mx), 6) AS mean, min(mx) AS least, max(mx) AS most FROM f")
register("dash_count_distinct", lambda s, d: dash.counts(facts(s, d), ["direction", "breakout_type", "total_score"]), f"WITH {FACTS} SELECT count(DISTINCT direction) AS direction, count(DISTINCT breakout_type) AS breakout_type, count(DISTINCT score) AS total_score FROM f")
register("dash_mode", lambda s, d: dash.mode(facts(s, d), "total_score", "breakout_id"), f"WITH {FACTS}, m AS (SELECT score, count(*) AS n, min(breakout_id) AS b FROM f GROUP BY score) SELECT first(score ORDER BY n DESC, b) AS mode, max(n) AS n FROM m")
register("dash_delta_sign", lambda s, d: dash.delta_sign(bars(s, d), "delta").groupBy("instrument", "delta_sign").agg(F.count(F.lit(1)).alias("n")), f"WITH {BARS} SELECT instrument, CASE WHEN delta > 0 THEN 'positive' WHEN delta < 0 THEN 'negative' ELSE 'neutral' END AS delta_sign, count(*) AS n FROM bars GROUP BY ALL")
register("dash_highlights", lambda s, d: dash.highlights(spec.run(facts(s, d), {"metric": "count", "group_by": ["total_score"]}), "result").select("total_score", "result", "is_top", "is_bottom"), f"WITH {FACTS}, m AS (SELECT score AS total_score, count(*) AS result FROM f GROUP BY score) SELECT *, result = max(result) OVER () AS is_top, result = min(result) OVER () AS is_bottom FROM m")
register("dash_fields", lambda s, d: dash.fields(facts(s, d), ["direction", "breakout_type"]), f"WITH {FACTS}, u AS (SELECT 'direction' AS field, direction AS value FROM f UNION ALL SELECT 'breakout_type', breakout_type FROM f) SELECT field, value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY field), 6) AS pct FROM u WHERE value IS NOT NULL GROUP BY field, value")
register("dash_page", lambda s, d: dash.page(facts(s, d).select("breakout_id", "max_excursion"), [F.desc_nulls_last("max_excursion"), "breakout_id"], 2), f"WITH {FACTS} SELECT breakout_id, mx AS max_excursion FROM f ORDER BY mx DESC NULLS LAST, breakout_id LIMIT 50 OFFSET 50")


def _rates(s: SparkSession, d: str) -> DataFrame:
    return spec.run(facts(s, d), {"metric": "success_rate", **SUCCESS, "group_by": ["total_score"]}).select(F.concat(F.lit("total_score="), c("total_score")).alias("value"), F.round("result", 6).alias("result"), "rows_valid")


GAPS = f"{FACTS}, m AS (SELECT 'total_score=' || score AS value, round({RATE}, 6) AS result, count(breakout_type) AS n FROM f GROUP BY score), k AS (SELECT *, row_number() OVER (ORDER BY result DESC, value) AS a, lead(result) OVER (ORDER BY result DESC, value) AS r2, lead(n) OVER (ORDER BY result DESC, value) AS n2 FROM m)"
register("insight_gaps", lambda s, d: insights.extracted(_rates(s, d), "success_rate").where(c("type").isin("range_gap", "top_gap")), f"WITH {GAPS} SELECT 'range_gap' AS type, CAST(NULL AS VARCHAR) AS value, round(max(result) - min(result), 6) AS metric_value, sum(n)::BIGINT AS rows_valid FROM m UNION ALL SELECT 'top_gap', NULL, round(result - r2, 6), least(n, n2) FROM k WHERE a = 1")


def _shares(s: SparkSession, d: str) -> DataFrame:
    found = spec.run(all_of(facts(s, d), [{"field": "direction", "operator": "notnull"}]), {"metric": "distribution", "value_field": "direction"})
    return found.select(F.concat(F.lit("direction="), c("value")).alias("value"), c("n").alias("result"), c("n").alias("rows_valid"))


register("insight_dominance", lambda s, d: insights.extracted(_shares(s, d), "distribution").where(c("type").isin("dominant_segment", "imbalanced_distribution")), f"WITH {FACTS}, m AS (SELECT 'direction=' || direction AS value, count(*) AS n FROM f WHERE direction IS NOT NULL GROUP BY 1), k AS (SELECT *, n / sum(n) OVER () AS s, row_number() OVER (ORDER BY n DESC, value) AS a FROM m) SELECT CASE WHEN s >= 0.6 THEN 'dominant_segment' ELSE 'imbalanced_distribution' END AS type, value, round(s, 6) AS metric_value, n AS rows_valid FROM k WHERE a = 1 AND s >= 0.45")

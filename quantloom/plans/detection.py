"""Queries of the whole chain, bars to rotations to balances to breakout events, and of whole session levels, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars
from ..operators import balances, breakouts as bo, dashboards as dash, features as feat, insights, levels, rotations as rot
from ..sources.stash import stash
from ..sources.tables import bars, facts, indexed, table
from . import spec
from .catalog import BARS, BYSESSION, FACTS, GAPS, ROTATIONS, TYPICAL, _rates, c, register

GAP_BARS, WIDTH, BIN = 240, 300.0, 20.0

# --- balances --------------------------------------------------------------------------------------------------------


def series(s: SparkSession, d: str) -> DataFrame:
    """The bars with their places, written once: all steps of the chain read them."""
    return stash(indexed(bars(s, d)))


def members(b: DataFrame) -> DataFrame:
    return balances.clustered(rot.rotations(b), max_gap_bars=GAP_BARS, max_width=WIDTH)


def found(b: DataFrame) -> DataFrame:
    """Balances with profile, volatility and equilibrium score."""
    return balances.equilibrium(balances.detected(b, members(b), BIN, around=20.0))


def of_series(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: make(series(s, d))


WALK = f"""{ROTATIONS}, lh AS (SELECT *, least(start_price, end_price) AS lo, greatest(start_price, end_price) AS hi FROM ro),
walk AS (SELECT instrument, rotation_index, 0 AS cluster, lo, hi, end_time FROM lh WHERE rotation_index = 0
  UNION ALL SELECT n.instrument, n.rotation_index, CASE WHEN f THEN w.cluster ELSE w.cluster + 1 END, CASE WHEN f THEN least(w.lo, n.lo) ELSE n.lo END, CASE WHEN f THEN greatest(w.hi, n.hi) ELSE n.hi END, n.end_time
  FROM walk w JOIN lh n ON n.instrument = w.instrument AND n.rotation_index = w.rotation_index + 1, LATERAL (SELECT epoch(n.start_time - w.end_time) <= {GAP_BARS * 60} AND greatest(w.hi, n.hi) - least(w.lo, n.lo) <= {WIDTH} AS f)),
sp AS (SELECT ro.instrument, cluster, min(start_index) AS start_index, max(ro.end_index) AS end_index, count(*) AS rotation_count FROM walk JOIN ro USING (instrument, rotation_index) GROUP BY ALL HAVING count(*) >= 2),
inb AS (SELECT sp.cluster, ib.* FROM sp JOIN ib ON ib.instrument = sp.instrument AND bar_index BETWEEN start_index AND end_index),
bal AS (SELECT instrument, cluster, any_value(start_index) AS start_index, any_value(end_index) AS end_index, min(time) AS start_time, max(time) AS end_time, max(high) AS high, min(low) AS low, count(*) AS bar_count, sum(volume) AS volume, sum(delta) AS delta, any_value(rotation_count) AS rotation_count FROM inb JOIN sp USING (instrument, cluster) GROUP BY instrument, cluster)"""


def _profile(keys: str, source: str, size: float, around: float) -> str:
    """CTEs pt and ps: the volume histogram of the closes of each group of `source`, and what follows from it."""
    return f"""pn AS (SELECT {keys}, mn, top, greatest(ceil((top - mn + {size}) / {size}) - 1, 1)::INT AS bins FROM (SELECT {keys}, min(close) AS mn, CASE WHEN max(close) = min(close) THEN min(close) + {size} ELSE max(close) END AS top FROM {source} GROUP BY {keys})),
ce AS (SELECT *, mn + (k + 0.5) * {size} AS p FROM (SELECT *, unnest(range(bins)) AS k FROM pn)),
bv AS (SELECT {keys}, least(floor((close - mn) / {size}), bins - 1)::INT AS k, sum(volume) AS v FROM {source} JOIN pn USING ({keys}) GROUP BY ALL),
cv AS (SELECT ce.*, coalesce(v, 0) AS v FROM ce LEFT JOIN bv USING ({keys}, k)),
pt AS (SELECT {keys}, any_value(bins) AS n_levels, any_value(mn) AS mn, any_value(top) AS top, sum(v) AS total, avg(v) AS mean, first(p ORDER BY v DESC, k) AS poc, max(v) AS pocv, first(v ORDER BY k) AS vl, last(v ORDER BY k) AS vu, sum(p * v) / sum(v) AS mp FROM cv GROUP BY {keys}),
ps AS (SELECT {keys}, any_value(n_levels) AS n_levels, any_value(pt.top - pt.mn) AS profile_width, any_value(total) AS total, any_value(mean) AS mean, any_value(poc) AS poc, any_value(pocv) AS pocv, any_value(vl) AS vl, any_value(vu) AS vu, greatest(sum((p - mp) ** 2 * v / total), 1e-9) AS m2, sum((p - mp) ** 3 * v / total) AS m3, sum((p - mp) ** 4 * v / total) AS m4,
  coalesce(list(p ORDER BY k) FILTER (v > 1.5 * mean), []) AS hvn, coalesce(list(p ORDER BY k) FILTER (v < 0.5 * mean), []) AS lvn, sum(CASE WHEN abs(p - poc) <= {around} THEN v ELSE 0 END) / any_value(total) AS concentration,
  sum(CASE WHEN p > (pt.mn + pt.top) / 2 THEN v ELSE 0 END) AS above, sum(CASE WHEN p <= (pt.mn + pt.top) / 2 THEN v ELSE 0 END) AS below, sum(CASE WHEN abs(p - (pt.mn + pt.top) / 2) <= {around} THEN v ELSE 0 END) / any_value(total) AS density FROM cv JOIN pt USING ({keys}) GROUP BY {keys})"""


#: fo: a row a balance with all that is measured of it.
FOUND = f"""{WALK}, {_profile("instrument, cluster", "inb", BIN, 20.0)},
vt AS (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS t, row_number() OVER (PARTITION BY instrument, cluster ORDER BY time DESC) AS back FROM inb WINDOW w AS (PARTITION BY instrument, cluster ORDER BY time)),
vo AS (SELECT instrument, cluster, coalesce(avg(t) FILTER (back <= 14), 0) AS atr, stddev_pop(close) AS sd, stddev_pop(close) FILTER (back <= 14) AS rsd, count(*) AS n, max(high) - min(low) AS span FROM vt GROUP BY ALL),
fo AS (SELECT bal.*, high - low AS size, (high + low) / 2 AS mid, ps.* EXCLUDE (instrument, cluster), (above - below) / total AS asymmetry, CASE WHEN below > 0 THEN above / below WHEN above > 0 THEN 'inf'::DOUBLE ELSE 1 END AS upper, (vl + vu) / greatest(total, 1e-9) AS edge, sd, rsd, atr,
  CASE WHEN n > 1 AND span > 0 THEN atr / span ELSE 0 END AS comp, CASE WHEN n > 1 THEN 1 / (1 + CASE WHEN span > 0 THEN atr / span ELSE 0 END) ELSE 0 END AS stab FROM bal JOIN ps USING (instrument, cluster) JOIN vo USING (instrument, cluster)),
eq AS (SELECT *, greatest(least(0.2 * greatest(1 - abs(size / greatest(profile_width, 1e-9) - 1), 0) + 0.2 * greatest(1 - abs(asymmetry) / 0.5, 0) + 0.25 * least(density / 0.4, 1) + 0.15 * greatest(1 - abs(len(hvn) / n_levels - 0.25) / 0.25, 0)
  + 0.1 * greatest(1 - abs(len(lvn) / n_levels - 0.15) / 0.15, 0) + 0.1 * CASE WHEN edge <= 0.1 THEN 1 ELSE greatest(1 - (edge - 0.1) / 0.1, 0) END, 1), 0) AS equilibrium_score FROM fo)"""

register("balances", of_series(lambda b: balances.balances(b, members(b)).drop("rotations", "timeframe", "valid_rotations", "avg_candle_range")), f"WITH RECURSIVE {WALK} SELECT instrument, cluster, start_index, end_index, start_time, end_time, high, low, bar_count, round(volume, 6) AS volume, round(delta, 6) AS delta, rotation_count, round(high - low, 6) AS range_size, round((high + low) / 2, 6) AS midpoint, 'bal_' || instrument || '_' || cluster AS balance_id FROM bal")
register(
    "cluster_filters",
    of_series(lambda b: balances.filtered(members(b), 3, 120, 50.0, 280.0).select("instrument", "rotation_index", "cluster")),
    f"WITH RECURSIVE {WALK}, m AS (SELECT instrument, cluster FROM walk JOIN lh USING (instrument, rotation_index) GROUP BY ALL HAVING count(*) >= 3 AND epoch(max(lh.end_time) - min(start_time)) / 60 >= 120 AND max(lh.hi) - min(lh.lo) BETWEEN 50 AND 280) SELECT instrument, rotation_index, cluster FROM walk JOIN m USING (instrument, cluster)",
)
MOMENTS = "round(m3 / sqrt(m2) ** 3, 6) AS skewness, round(m4 / sqrt(m2) ** 4, 6) AS kurtosis, round(concentration, 6) AS concentration, round((above - below) / total, 6) AS asymmetry, round(density, 6) AS density_around_mid"
register(
    "balance_profile",
    of_series(lambda b: balances.profile(balances.inside(b, members(b)), balances.KEYS, BIN, around=20.0).select("instrument", "cluster", "total_volume", "poc_price", "poc_volume", F.size("hvn").alias("hvn"), F.size("lvn").alias("lvn"), "skewness", "kurtosis", "concentration", "asymmetry", "density_around_mid", "volume_lower_boundary", "volume_upper_boundary", "profile_width")),
    f"WITH RECURSIVE {FOUND} SELECT instrument, cluster, round(total, 6) AS total_volume, round(poc, 6) AS poc_price, round(pocv, 6) AS poc_volume, len(hvn) AS hvn, len(lvn) AS lvn, {MOMENTS}, round(vl, 6) AS volume_lower_boundary, round(vu, 6) AS volume_upper_boundary, round(profile_width, 6) AS profile_width FROM ps",
)
register(
    "balance_volatility",
    of_series(lambda b: balances.volatility(balances.inside(b, members(b)), balances.KEYS).drop("timeframe")),
    f"WITH RECURSIVE {FOUND} SELECT instrument, cluster, round(atr, 6) AS internal_atr, round(sd, 6) AS internal_volatility, round(rsd, 6) AS recent_volatility, round(comp, 6) AS compression_ratio, round(stab, 6) AS stability_score FROM fo",
)
register(
    "balance_kinds",
    of_series(lambda b: balances.kinds(found(b), wide=1.2).select("instrument", "cluster", "is_compressed", "is_wide", "is_standard", "is_asymmetric", "is_center_heavy", "is_edge_heavy")),
    f"WITH RECURSIVE {FOUND}, k AS (SELECT *, size / greatest(profile_width, 1e-9) AS r FROM fo) SELECT instrument, cluster, r <= 0.25 AS is_compressed, r > 0.25 AND r >= 1.2 AS is_wide, r > 0.25 AND r < 1.2 AS is_standard, abs(asymmetry) >= 0.25 AS is_asymmetric, density >= 0.35 AS is_center_heavy, edge >= 0.2 AS is_edge_heavy FROM k",
)
register("balance_equilibrium", of_series(lambda b: found(b).select("instrument", "cluster", "equilibrium_score")), f"WITH RECURSIVE {FOUND} SELECT instrument, cluster, round(equilibrium_score, 6) AS equilibrium_score FROM eq")
register(
    "pre_breakout_signals",
    of_series(lambda b: balances.before_breakout(found(b), pickup=1.05).select("instrument", "cluster", "volatility_pickup", "boundary_volume_drop", "lvn_near_boundaries", "directional_bias", "is_pre_breakout")),
    f"WITH RECURSIVE {FOUND}, k AS (SELECT *, sd > 0 AND rsd > 1.05 * sd AS a, total / n_levels > 0 AND vl + vu < 0.5 * total / n_levels AS b, len(list_filter(lvn, lambda p: abs(p - low) <= 0.1 * size OR abs(p - high) <= 0.1 * size)) > 0 AS l, CASE WHEN upper > 1.2 THEN 'up' WHEN upper < 1 / 1.2 THEN 'down' ELSE 'neutral' END AS w FROM fo) "
    "SELECT instrument, cluster, a AS volatility_pickup, b AS boundary_volume_drop, l AS lvn_near_boundaries, w AS directional_bias, a::INT + b::INT + l::INT + (w <> 'neutral')::INT >= 2 AS is_pre_breakout FROM k",
)
PRE = {"compression": 0.3, "lvn_proximity": 0.2, "volatility": 0.3, "delta_bias": 0.2}
PRE_SCORED = "pr AS (SELECT *, least(comp, 1) AS compression_score, CASE WHEN len(lvn) = 0 OR size = 0 THEN 0 ELSE 1 - least(list_min(list_transform(lvn, lambda p: abs(mid - p))) / size / 0.5, 1) END AS lvn_proximity_score, CASE WHEN size = 0 THEN 0 ELSE least(sd / (size / bar_count) / 1.0, 1) END AS volatility_increase_score, CASE WHEN total = 0 THEN 0 ELSE least(abs(delta) / total / 0.2, 1) END AS delta_bias_score FROM eq)"
register(
    "pre_breakout_score",
    of_series(lambda b: balances.pre_breakout_score(found(b), PRE).select("instrument", "cluster", "compression_score", "lvn_proximity_score", "volatility_score", "delta_bias_score", "pre_total_score", "is_candidate")),
    f"WITH RECURSIVE {FOUND}, {PRE_SCORED}, t AS (SELECT *, 0.3 * compression_score + 0.2 * lvn_proximity_score + 0.3 * volatility_increase_score + 0.2 * delta_bias_score AS s FROM pr) SELECT instrument, cluster, round(compression_score, 6) AS compression_score, round(lvn_proximity_score, 6) AS lvn_proximity_score, round(volatility_increase_score, 6) AS volatility_score, round(delta_bias_score, 6) AS delta_bias_score, round(s, 6) AS pre_total_score, s >= 0.5 AS is_candidate FROM t",
)

# --- whole events ----------------------------------------------------------------------------------------------------

#: A filter that some balances pass, some at its border, and some don't.
SOFT = {"min_compression": 0.1, "max_compression": 1.0, "min_stability": 0.6, "soft_penalty": 0.3}


EARLY = {"min_run": 1, "max_lead_minutes": 600.0, "timeframe": "15 minutes"}


def chain(s: SparkSession, d: str) -> DataFrame:
    """Events: the first break of each balance with its strength, follow-through, class and confirmation."""
    b = series(s, d)
    return bo.assembled(b, balances.pre_breakout_score(found(b), PRE), volatility_filter=SOFT)


def whole_chain(s: SparkSession, d: str) -> DataFrame:
    """Whole events by the contract: the same, with rotations, early signs, ranks and levels."""
    b = series(s, d)
    m = stash(members(b))
    made = stash(balances.pre_breakout_score(balances.equilibrium(balances.detected(b, m, BIN, around=20.0)), PRE))
    events = bo.assembled(b, made, volatility_filter=SOFT)
    return bo.whole(events, made, m, indexed(bars(s, d, EARLY["timeframe"])), levels.session_levels(b, bin_size=25.0), config={"mode": "close_only"}, early=EARLY)


CHAIN = f"""{FOUND}, {PRE_SCORED},
hit AS (SELECT pr.*, 'bal_' || pr.instrument || '_' || cluster AS range_id, i.bar_index, i.time AS breakout_time, i.open AS o, i.close AS p, i.volume AS iv, i.delta AS idl, i.pc, CASE WHEN i.close > pr.high THEN 'up' WHEN i.close < pr.low THEN 'down' END AS direction FROM pr JOIN ib i ON i.instrument = pr.instrument AND i.bar_index BETWEEN pr.end_index + 1 AND pr.end_index + 61),
ev AS (SELECT *, CASE direction WHEN 'up' THEN high ELSE low END AS b FROM hit WHERE direction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, range_id ORDER BY bar_index) = 1),
x AS (SELECT instrument, bar_index, coalesce(avg(tra) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS a, avg(abs(delta)) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS md, avg(volume) OVER (PARTITION BY instrument ORDER BY time ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS mv FROM tr),
xa AS (SELECT *, coalesce(lead(a, 5) OVER (PARTITION BY instrument ORDER BY bar_index), last_value(a) OVER (PARTITION BY instrument ORDER BY bar_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS aa FROM x),
sc AS (SELECT ev.*, a AS atr_before, aa AS atr_after, comp >= 0.1 AND comp <= 1 AND stab >= 0.6 AS passes, least(abs(p - coalesce(pc, o)) / size, 1) AS momentum_score, least(CASE WHEN md > 0 THEN abs(idl) / md ELSE 0 END, 3) / 3 AS delta_imbalance_score, least(CASE WHEN mv > 0 THEN iv / mv ELSE 0 END, 3) / 3 AS volume_spike_score,
  least(a / size, 1) * CASE WHEN comp >= 0.1 AND comp <= 1 AND stab >= 0.6 AND (comp < 0.11 OR stab < 0.66) THEN 0.7 ELSE 1 END AS volatility_score, least(abs(p - poc) / (0.5 * size), 1) AS distance_from_vpoc_score,
  CASE WHEN len(list_filter(lvn, lambda l: CASE direction WHEN 'up' THEN l >= mid ELSE l <= mid END AND abs(p - l) <= 0.1 * size)) > 0 THEN 1.0 ELSE 0.0 END AS hvn_lvn_break_score FROM ev JOIN xa USING (instrument, bar_index)),
nx AS (SELECT sc.instrument, range_id, direction, b, p, size, sc.bar_index, i.bar_index - sc.bar_index - 1 AS k, i.close, i.volume FROM sc LEFT JOIN ib i ON i.instrument = sc.instrument AND i.bar_index BETWEEN sc.bar_index + 1 AND sc.bar_index + 40),
ft AS (SELECT instrument, range_id, any_value(size) AS size, CASE WHEN count(close) = 0 THEN 0 WHEN any_value(direction) = 'up' THEN max(close) - any_value(b) ELSE any_value(b) - min(close) END AS mx, CASE WHEN count(close) = 0 THEN 0 WHEN any_value(direction) = 'up' THEN first(k ORDER BY close DESC, k) ELSE first(k ORDER BY close, k) END AS mxb, coalesce(max(close) - min(close), 0) AS depth,
  min(CASE WHEN (direction = 'up' AND close <= b) OR (direction = 'down' AND close >= b) THEN k END) AS retest, min(CASE WHEN (direction = 'up' AND close < b) OR (direction = 'down' AND close > b) THEN k END) AS fails FROM nx GROUP BY instrument, range_id),
cl AS (SELECT *, CASE WHEN mx <= 0 OR coalesce(mx / nullif(size, 0), 0) < 0.3 THEN 'failed_follow_through' WHEN fails IS NOT NULL OR depth / mx >= 0.8 THEN 'false_breakout' WHEN retest <= 20 THEN 'with_retest' WHEN mxb >= 15 THEN 'accumulation' ELSE 'clean' END AS breakout_type FROM ft),
co AS (SELECT instrument, range_id, min(bar_index + 1 + k) AS cb, first(close ORDER BY k) AS price FROM (SELECT *, o = 1 AND lag(o) OVER (PARTITION BY instrument, range_id ORDER BY k) = 1 AS two FROM (SELECT *, CASE WHEN (direction = 'up' AND close > b) OR (direction = 'down' AND close < b) THEN 1 ELSE 0 END AS o FROM nx WHERE k < 10)) WHERE two GROUP BY ALL)"""
SIX = [f"{n}_score" for n in bo.WEIGHTS]
RAW = " + ".join(f"{w} * {n}_score" for n, w in bo.WEIGHTS.items())
register(
    "chain_events",
    lambda s, d: chain(s, d).select(
        "breakout_id", "parent_balance_id", "instrument", "breakout_time", "breakout_bar_index", "direction", "breakout_type", "confirmation_status", "confirmation_bar_index", "breakout_price", "confirmation_price", "boundary_price", "balance_high", "balance_low", "balance_midpoint", "balance_range_size", "balance_vpoc",
        F.size("balance_hvn").alias("n_hvn"), F.size("balance_lvn").alias("n_lvn"), "balance_equilibrium_score", "initial_volume", "initial_delta", "atr_before", "atr_after", "is_failed", "is_retest_occurred", c("pre_breakout_signal.pre_total_score").alias("pre_total_score"), c("follow_through.max_excursion").alias("max_excursion"), c("follow_through.retracement_depth").alias("retracement_depth"), F.concat_ws(" ", "tags").alias("tags"),
    ),
    f"WITH RECURSIVE {CHAIN} SELECT 'bo_' || range_id || '_' || bar_index AS breakout_id, range_id AS parent_balance_id, instrument, breakout_time, bar_index AS breakout_bar_index, direction, breakout_type, CASE WHEN cb IS NULL THEN 'pending' ELSE 'confirmed' END AS confirmation_status, cb AS confirmation_bar_index, round(p, 6) AS breakout_price, round(price, 6) AS confirmation_price, round(b, 6) AS boundary_price, high AS balance_high, low AS balance_low, round(mid, 6) AS balance_midpoint, round(sc.size, 6) AS balance_range_size, round(poc, 6) AS balance_vpoc, "
    "len(hvn) AS n_hvn, len(lvn) AS n_lvn, round(equilibrium_score, 6) AS balance_equilibrium_score, round(iv, 6) AS initial_volume, round(idl, 6) AS initial_delta, round(atr_before, 6) AS atr_before, round(atr_after, 6) AS atr_after, breakout_type IN ('failed_follow_through', 'false_breakout') AS is_failed, breakout_type = 'with_retest' AS is_retest_occurred, round(0.3 * compression_score + 0.2 * lvn_proximity_score + 0.3 * volatility_increase_score + 0.2 * delta_bias_score, 6) AS pre_total_score, round(mx, 6) AS max_excursion, round(depth, 6) AS retracement_depth, "
    "'structural ' || CASE WHEN passes THEN 'volatility_confirmed' ELSE 'volatility_rejected' END || CASE WHEN cb IS NULL THEN '' ELSE ' confirmed' END AS tags FROM sc JOIN cl USING (instrument, range_id) LEFT JOIN co USING (instrument, range_id)",
)
register("chain_strength", lambda s, d: chain(s, d).select("breakout_id", "strength_components.*"), f"WITH RECURSIVE {CHAIN}, t AS (SELECT *, {RAW} AS raw FROM sc) SELECT 'bo_' || range_id || '_' || bar_index AS breakout_id, {', '.join(f'round({x}, 6) AS {x}' for x in SIX)}, round(raw, 6) AS overall_strength_score, round(greatest(least(raw / 5, 1), 0), 6) AS overall_strength_normalized, passes AS volatility_filter_pass FROM t")

LOWER = "lb AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY lt) - 1 AS k FROM (SELECT event_type AS instrument, time_bucket(INTERVAL 15 MINUTE, ts) AS lt, last(value ORDER BY ts, event_id) AS lc FROM events GROUP BY ALL))"
register(
    "whole_events",
    lambda s, d: whole_chain(s, d).select(
        "breakout_id", "session_id", "version", "schema_version", "bars_observed", "early_time", "early_price", "early_bar_index", "early_timeframe", "minutes_of_anticipation", "global_rank", "session_rank", c("rotation_context.total_rotations").alias("total_rotations"), c("rotation_context.up_count").alias("up_count"), c("rotation_context.last_rotation_direction").alias("last_rotation_direction"), F.size("tags").alias("n_tags"),
    ),
    f"WITH RECURSIVE {CHAIN}, {LOWER}, er AS (SELECT range_id, min(lt) AS early_time, arg_min(lc, lt) AS early_price, arg_min(k, lt) AS k, (epoch(any_value(breakout_time)) - epoch(min(lt))) / 60 AS lead FROM sc JOIN ib s ON s.instrument = sc.instrument AND s.bar_index = sc.start_index JOIN lb ON lb.instrument = sc.instrument AND lt >= s.time AND lt < breakout_time AND ((sc.direction = 'up' AND lc > b) OR (sc.direction = 'down' AND lc < b)) GROUP BY ALL HAVING lead <= 600), "
    f"rc AS (SELECT instrument, cluster, count(*) AS n, count(*) FILTER (direction = 'up') AS u, arg_max(direction, rotation_index) AS way FROM walk JOIN ro USING (instrument, rotation_index) GROUP BY ALL), w AS (SELECT *, {RAW} AS raw FROM sc) "
    "SELECT 'bo_' || range_id || '_' || bar_index AS breakout_id, 'unknown' AS session_id, '0.2.0' AS version, '1.1.0' AS schema_version, 0 AS bars_observed, early_time, round(early_price, 6) AS early_price, k AS early_bar_index, CASE WHEN early_time IS NOT NULL THEN '15 minutes' END AS early_timeframe, round(lead, 6) AS minutes_of_anticipation, "
    "rank() OVER (PARTITION BY instrument ORDER BY raw DESC) AS global_rank, rank() OVER (PARTITION BY instrument, CAST(breakout_time AS DATE) ORDER BY raw DESC) AS session_rank, n AS total_rotations, u AS up_count, way AS last_rotation_direction, 3 + (cb IS NOT NULL)::INT + 2 * (early_time IS NOT NULL)::INT AS n_tags FROM w LEFT JOIN co USING (instrument, range_id) LEFT JOIN er USING (range_id) JOIN rc USING (instrument, cluster)",
)

# --- session levels --------------------------------------------------------------------------------------------------


def _area(name: str, keys: str, source: str) -> str:
    """CTE <name>: poc, vah and val of each group of `source`, by the walk from the fullest bin."""
    on = lambda x: " AND ".join(f"{x}.{k} = {name}w.{k}" for k in keys.split(", "))
    return f"""{name}v AS (SELECT {keys}, round_even({TYPICAL} / 25, 0) * 25 AS price, sum(volume) AS volume FROM {source} GROUP BY ALL),
{name}n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY price) AS k, sum(volume) OVER (PARTITION BY {keys}) AS t FROM {name}v),
{name}p AS (SELECT * FROM {name}n QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY volume DESC, price) = 1),
{name}w AS (SELECT {keys}, price AS poc, k AS l, k AS r, volume AS v, t FROM {name}p UNION ALL SELECT {", ".join(f"{name}w.{k}" for k in keys.split(", "))}, poc, CASE WHEN coalesce(b.volume, -1) >= coalesce(a.volume, -1) THEN l ELSE l - 1 END, CASE WHEN coalesce(b.volume, -1) >= coalesce(a.volume, -1) THEN r + 1 ELSE r END,
  v + CASE WHEN coalesce(b.volume, -1) >= coalesce(a.volume, -1) THEN b.volume ELSE a.volume END, {name}w.t FROM {name}w LEFT JOIN {name}n a ON {on("a")} AND a.k = l - 1 LEFT JOIN {name}n b ON {on("b")} AND b.k = r + 1 WHERE v / {name}w.t < 0.7 AND (a.k IS NOT NULL OR b.k IS NOT NULL)),
{name}z AS (SELECT * FROM {name}w QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY r - l DESC) = 1),
{name} AS (SELECT z.* EXCLUDE (l, r, v, t), h.price AS vah, g.price AS val FROM {name}z z JOIN {name}n h ON {on("h").replace(f"{name}w.", "z.")} AND h.k = r JOIN {name}n g ON {on("g").replace(f"{name}w.", "z.")} AND g.k = l)"""


FIGURES = f"first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close, sum(volume) AS volume, sum({TYPICAL} * volume) / sum(volume) AS vwap, sum(close * volume) / sum(volume) AS vwap_close"
LEVEL = "open high low close volume vwap vwap_close poc vah val".split()
PREVIOUS = ("high", "low", "poc", "vah", "val", "vwap")
SESSION_LEVELS = f"""{BYSESSION}, db AS (SELECT *, CAST(time AS DATE) AS date FROM bars), {_area("sa", "instrument, date, session_name", "sb")}, {_area("da", "instrument, date", "db")},
so AS (SELECT instrument, date, session_name, {FIGURES} FROM sb GROUP BY ALL), dy AS (SELECT * FROM (SELECT instrument, date, {FIGURES}, sum(close * volume) AS pv FROM db GROUP BY ALL) JOIN da USING (instrument, date)),
wk AS (SELECT instrument, yearweek(date) AS p, max(high) AS h, min(low) AS l, sum(pv) / sum(volume) AS w FROM dy GROUP BY ALL), mo AS (SELECT instrument, date_trunc('month', date) AS p, max(high) AS h, min(low) AS l, sum(pv) / sum(volume) AS w FROM dy GROUP BY ALL),
al AS (SELECT so.instrument, so.date, so.session_name, {", ".join(f"so.{x} AS session_{x}" for x in LEVEL[:7])}, {", ".join(f"sa.{x} AS session_{x}" for x in LEVEL[7:])}, {", ".join(f"dy.{x} AS day_{x}" for x in LEVEL)}, {", ".join(f"pd.{'vwap_close' if x == 'vwap' else x} AS prev_day_{x}" for x in PREVIOUS)},
  wk.h AS weekly_high, wk.l AS weekly_low, wk.w AS weekly_vwap, mo.h AS monthly_high, mo.l AS monthly_low, mo.w AS monthly_vwap, (so.high + so.low) / 2 AS session_mid, so.high - so.low AS session_range
  FROM so JOIN sa USING (instrument, date, session_name) JOIN dy ON dy.instrument = so.instrument AND dy.date = so.date LEFT JOIN dy pd ON pd.instrument = so.instrument AND pd.date = so.date - 1 JOIN wk ON wk.instrument = so.instrument AND wk.p = yearweek(so.date) JOIN mo ON mo.instrument = so.instrument AND mo.p = date_trunc('month', so.date))"""
TOUCHED = [f"session_low <= {x} AND session_high >= {x} AS touched_{x}" for x in ("prev_day_poc", "prev_day_vah", "prev_day_val", "prev_day_vwap", "weekly_high", "weekly_low")]
BROKE = [f"(session_open > {x} AND session_low <= {x}) OR (session_open < {x} AND session_high >= {x}) AS broke_{x}" for x in ("prev_day_poc", "prev_day_vah", "prev_day_val", "prev_day_vwap")]
ROUNDED = [*(f"{a}_{x}" for a in ("session", "day") for x in LEVEL), *(f"prev_day_{x}" for x in PREVIOUS), *(f"{a}_{x}" for a in ("weekly", "monthly") for x in ("high", "low", "vwap")), "session_mid", "session_range"]
register("session_levels", lambda s, d: levels.session_levels(bars(s, d), bin_size=25.0), f"WITH RECURSIVE {SESSION_LEVELS} SELECT instrument, date, session_name, {', '.join(f'round({x}, 6) AS {x}' for x in ROUNDED)}, {', '.join(TOUCHED + BROKE)} FROM al")
register("previous_week", lambda s, d: levels.previous_period(bars(s, d), "week"), f"WITH {BARS}, d AS (SELECT instrument, CAST(time AS DATE) AS date, max(high) AS h, min(low) AS l, sum(close * volume) AS pv, sum(volume) AS v FROM bars GROUP BY ALL), m AS (SELECT instrument, CAST(date_trunc('week', date) AS DATE) AS p, max(h) AS h, min(l) AS l, sum(pv) / sum(v) AS w FROM d GROUP BY ALL) SELECT d.instrument, d.date, m.h AS prev_week_high, m.l AS prev_week_low, round(m.w, 6) AS prev_week_vwap FROM d JOIN m ON m.instrument = d.instrument AND m.p + 7 = CAST(date_trunc('week', d.date) AS DATE)")

# --- the report of findings ------------------------------------------------------------------------------------------

COUNTED = f"{GAPS}, n AS (SELECT count(*) AS c, max(result) AS hi, min(result) AS lo, sum(result) AS t, sum(n) AS v FROM m WHERE result IS NOT NULL), kk AS (SELECT *, row_number() OVER (ORDER BY result, value) AS z FROM k WHERE result IS NOT NULL)"
register(
    "insight_report",
    lambda s, d: insights.scored(insights.refined(insights.judged(insights.extracted(_rates(s, d), "success_rate")))),
    f"""WITH {COUNTED}, e AS (SELECT 'scalar' AS type, value, result AS metric_value, n AS rows_valid FROM kk UNION ALL SELECT 'top_performer', value, result, kk.n FROM kk, n WHERE a = 1 AND c >= 2 UNION ALL SELECT 'bottom_performer', value, result, kk.n FROM kk, n WHERE z = 1 AND c >= 2
  UNION ALL SELECT 'range_gap', NULL, hi - lo, v::BIGINT FROM n WHERE c >= 2 UNION ALL SELECT 'top_gap', NULL, result - r2, least(kk.n, n2) FROM kk, n WHERE a = 1 AND c >= 2 UNION ALL SELECT CASE WHEN hi / t >= 0.6 THEN 'dominant_segment' ELSE 'imbalanced_distribution' END, value, hi / t, kk.n FROM kk, n WHERE a = 1 AND c >= 2 AND t > 0 AND hi / t >= 0.45),
j AS (SELECT *, abs(metric_value) AS s, CASE WHEN coalesce(rows_valid, 0) <= 0 OR metric_value IS NULL THEN 'D' WHEN rows_valid < 5 OR CASE WHEN type IN ('top_gap', 'range_gap') THEN abs(metric_value) <= 1e-9 WHEN type IN ('dominant_segment', 'imbalanced_distribution') THEN abs(metric_value) < 0.15 ELSE abs(metric_value) <= 0 END THEN 'C'
  WHEN rows_valid >= 8 AND abs(metric_value) >= CASE type WHEN 'dominant_segment' THEN 0.6 WHEN 'imbalanced_distribution' THEN 0.45 ELSE 1e-300 END THEN 'A' ELSE 'B' END AS class FROM e),
r AS (SELECT * FROM j WHERE class <> 'D' AND NOT (type IN ('top_gap', 'range_gap') AND metric_value <= 0) AND NOT (type = 'scalar' AND value IN (SELECT value FROM j WHERE type IN ('top_performer', 'bottom_performer'))) AND NOT (type = 'top_performer' AND value IN (SELECT value FROM j WHERE type = 'dominant_segment')) AND NOT (type = 'bottom_performer' AND value IN (SELECT value FROM j WHERE type = 'imbalanced_distribution'))),
q AS (SELECT *, CASE WHEN type IN ('dominant_segment', 'imbalanced_distribution') THEN least(s, 1) ELSE s / (1 + s) END * rows_valid / (rows_valid + 10) * CASE class WHEN 'A' THEN 1 WHEN 'B' THEN 0.85 ELSE 0.7 END * f AS severity FROM r JOIN (VALUES ('dominant_segment', 1.0, 100), ('imbalanced_distribution', 0.88, 90), ('top_performer', 0.82, 80), ('bottom_performer', 0.82, 70), ('top_gap', 0.95, 60), ('range_gap', 0.9, 50), ('scalar', 0.72, 20)) AS w(type, f, o) USING (type)),
u AS (SELECT *, count(*) OVER () AS many, max(severity) OVER () AS best FROM q WHERE severity > 0)
SELECT type, value, round(metric_value, 6) AS metric_value, rows_valid, class, round(severity, 6) AS severity FROM u WHERE many <= 7 OR severity >= 0.35 * best ORDER BY severity DESC, o DESC, s DESC, type, value LIMIT 7""",
)

# --- further dashboards and reports ----------------------------------------------------------------------------------


def _labelled(s: SparkSession, d: str) -> DataFrame:
    made = feat.ratios(facts(s, d))
    return made.select((c("max_excursion") >= c("atr_before")).cast("string").alias("t1"), (c("max_excursion") > 5).cast("int").alias("is_clean_quant"))


register("dash_target_rates", lambda s, d: dash.rates(_labelled(s, d), ["t1", "is_clean_quant"]), f"WITH {FACTS}, x AS (SELECT mx >= atr AS a, mx > 5 AS b FROM f) SELECT 't1' AS target, count(*) FILTER (a) AS successes, count(a) AS labelled, round(100 * count(*) FILTER (a) / count(*), 6) AS rate_of_all, round(100 * count(*) FILTER (a) / count(a), 6) AS rate_of_labelled FROM x UNION ALL SELECT 'is_clean_quant', count(*) FILTER (b), count(b), round(100 * count(*) FILTER (b) / count(*), 6), round(100 * count(*) FILTER (b) / count(b), 6) FROM x")
register("dash_event_counts", lambda s, d: dash.event_counts(facts(s, d)), f"WITH {FACTS} SELECT count(*) AS total, count(*) FILTER (is_failed) AS failed, count(*) FILTER (NOT coalesce(is_failed, FALSE)) AS successful, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down FROM f")
register("dash_time_range", lambda s, d: dash.time_range(facts(s, d), "breakout_time"), f"WITH {FACTS} SELECT min(t) AS first, max(t) AS last FROM f")
SCORED = f"{FACTS}, m AS (SELECT instrument, event_id, ts, value / (1 + value) AS score FROM (SELECT event_type AS instrument, event_id, ts, value FROM events))"


def _scored(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(c("event_type").alias("instrument"), "event_id", c("ts").alias("start_time"), (c("value") / (1 + c("value"))).alias("score"))


register("dash_similarity", lambda s, d: dash.similarity_stats(_scored(s, d)), f"WITH {SCORED} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most FROM m")
register("match_filters", lambda s, d: dash.match_filters(_scored(s, d), "2024-01-05", "2024-01-20", "08:30", "17:15", 0.97), f"WITH {SCORED} SELECT instrument, event_id, ts AS start_time, round(score, 6) AS score FROM m WHERE ts >= '2024-01-05' AND ts <= '2024-01-20 23:59:59' AND strftime(ts, '%H:%M') BETWEEN '08:30' AND '17:15' AND score >= 0.97")
register("row_ids", lambda s, d: _scored(s, d).select("event_id", scalars.row_id("pat_", "instrument", "event_id").alias("pattern_id")), "SELECT event_id, 'pat_' || substr(sha256(event_type || '|' || event_id), 1, 16) AS pattern_id FROM events")
register("overlay", lambda s, d: bars(s, d).withColumns({"_a": F.min("low").over(W.partitionBy("instrument", F.to_date("time"))), "_b": F.max("high").over(W.partitionBy("instrument", F.to_date("time")))}).select("instrument", "time", scalars.overlaid(c("close"), c("_a"), c("_b"), F.lit(0.0), F.lit(100.0), 0.28).alias("drawn")), f"WITH {BARS} SELECT instrument, time, round((close - min(low) OVER w) * 100 * 0.28 / greatest(max(high) OVER w - min(low) OVER w, 1), 6) AS drawn FROM bars WINDOW w AS (PARTITION BY instrument, CAST(time AS DATE))")
register("report_summary", lambda s, d: dash.report_summary(spec.run(facts(s, d), {"metric": "mean", "value_field": "max_excursion", "group_by": ["total_score"]}), "mean"), f"WITH {FACTS} SELECT count(*) AS rows_total, count(mx) AS rows_valid FROM f")
register("distance_atr", lambda s, d: levels.level_features(facts(s, d).withColumns({"day_low": c("breakout_price") - c("retracement_depth"), "day_high": c("breakout_price") + c("max_excursion")})).select("breakout_id", "ml_distance_to_level", "ml_distance_atr"), f"WITH {FACTS}, x AS (SELECT breakout_id, atr, least(price - (price - depth), (price + mx) - price) AS near, price - (price - depth) AS below FROM f) SELECT breakout_id, round(near, 6) AS ml_distance_to_level, round(CASE WHEN atr > 0 THEN near / atr END, 6) AS ml_distance_atr FROM x")

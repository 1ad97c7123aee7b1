"""Breakouts of ranges: the first bar that leaves a range, what follows it, its class, strength and early signs.

A range has an instrument, timeframe, range_id, high, low and the index of its last bar (end_index).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import canonical_json, squashed, true_range
from ..sources.event_files import EVENT_COLUMNS, SCHEMA_VERSION
from ..sources.tables import SERIES, placed
from .balances import BLOCK, within
from .levels import dated_events, enriched

LEVELS = ("ml_nearest_support", "ml_nearest_resistance", "ml_distance_to_level", "ml_cluster_strength", "ml_density", "ml_alignment_score")

c = F.col


def leaves(mode: str, high: Column, low: Column) -> Column:
    """'up' or 'down' where a bar breaks out of [low, high], else NULL.

    strict: the whole bar is outside; close_only: its close is; body_50: half of its body at least is, a tie goes down.
    """
    if mode == "strict":
        return F.when(c("low") > high, "up").when(c("high") < low, "down")
    if mode == "close_only":
        return F.when(c("close") > high, "up").when(c("close") < low, "down")
    if mode == "body_50":
        top, bottom = F.greatest("open", "close"), F.least("open", "close")
        above, below = F.greatest(top - high, F.lit(0.0)), F.greatest(low - bottom, F.lit(0.0))
        outside = (top > bottom) & (F.greatest(above, below) / F.when(top > bottom, top - bottom) >= 0.5)
        return F.when(outside & (above > below), "up").when(outside, "down")
    return F.lit(None).cast("string")


def breakouts(bars: DataFrame, ranges: DataFrame, mode: str = "strict", post_bars: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each range the first bar that leaves it among the post_bars + 1 after its end; ranges without one give no row. The
    range's columns in `keep` come along."""
    spans = ranges.select(*SERIES, "range_id", c("high").alias("range_high"), c("low").alias("range_low"), F.struct(F.lit(1).alias("_"), *keep).alias("_kept"), (c("end_index") + 1).alias("_first"), (c("end_index") + 1 + post_bars).alias("_last"))
    narrow = placed(bars).select(*SERIES, "bar_index", "time", "open", "high", "low", "close", "volume", "delta")
    after = within(narrow, spans, "_first", "_last").withColumn("direction", leaves(mode, c("range_high"), c("range_low"))).where("direction is not null")
    bar = F.struct("bar_index", "time", "open", "high", "low", "close", "volume", "delta", "direction")
    first = after.groupBy(*SERIES, "range_id", "range_high", "range_low").agg(F.min_by(bar, "bar_index").alias("b"), F.first("_kept").alias("_kept"))
    up = c("b.direction") == "up"
    return first.select(
        *SERIES,
        "range_id",
        "range_high",
        "range_low",
        c("b.bar_index").alias("bar_index"),
        c("b.time").alias("breakout_time"),
        c("b.close").alias("breakout_price"),
        c("b.volume").alias("initial_volume"),
        c("b.delta").alias("initial_delta"),
        c("b.direction").alias("direction"),
        F.when(up, "upper").otherwise("lower").alias("boundary_type"),
        F.when(up, c("range_high")).otherwise(c("range_low")).alias("boundary_price"),
        F.concat_ws("_", F.lit("bo"), "range_id", c("b.bar_index")).alias("breakout_id"),
        *(c(f"_kept.{n}").alias(n) for n in keep),
    )


def near_bars(events: DataFrame, bars: DataFrame, first: int, last: int, name: str, *columns: str) -> DataFrame:
    """Events with the bars from `first` to `last` places after theirs, in order, as an array. Only these bars are joined, by
    blocks of indexes; no other bar carries a frame."""
    e, b = "event.bar_index", placed(bars).select(*(c(k).alias(f"_{k}") for k in SERIES), F.struct("bar_index", *columns).alias("bar"), F.floor(c("bar_index") / BLOCK).alias("_block"))
    blocks = F.explode(F.sequence(F.floor((c(e) + first) / BLOCK), F.floor((c(e) + last) / BLOCK)))
    cut = events.select(*SERIES, "range_id", F.struct(*events.columns).alias("event")).withColumn("block", blocks)
    meets = [c(k) == c(f"_{k}") for k in SERIES] + [c("block") == c("_block"), c("bar.bar_index").between(c(e) + first, c(e) + last)]
    got = cut.join(b, meets, "left").groupBy(*SERIES, "range_id").agg(F.first("event").alias("event"), F.sort_array(F.collect_list("bar")).alias(name))
    return got.select("event.*", name)


AROUND = ("time", "open", "high", "low", "close", "volume", "delta")


def _near(events: DataFrame, bars: DataFrame, first: int, last: int, name: str, *columns: str) -> DataFrame:
    """The same from the bars around an event that it holds already, if it does."""
    if "around" not in events.columns:
        return near_bars(events, bars, first, last, name, *columns)
    return events.withColumn(name, F.filter("around", lambda x: x["bar_index"].between(c("bar_index") + first, c("bar_index") + last)))


def mean_range(of: Column, period: int) -> Column:
    """Mean true range of the last `period` bars of an array, each after the bar before it; 0 for one bar."""
    n, at = F.size(of), lambda k: F.element_at(of, k.cast("int"))
    ranges = F.transform(F.sequence(F.greatest(n - period + 1, F.lit(2)), n), lambda k: true_range(at(k)["high"], at(k)["low"], at(k - 1)["close"]))
    return F.when(n > 1, F.try_divide(F.aggregate(ranges, F.lit(0.0), lambda s, x: s + x), F.size(ranges))).otherwise(0.0)


def follow_through(events: DataFrame, bars: DataFrame, observation_bars: int = 40) -> DataFrame:
    """How far, how long and how steadily closes went on after a breakout; places count from 0 at the next bar."""
    out = _near(events, bars, 1, observation_bars, "ahead", "close", "volume")
    p = F.transform("ahead", lambda x: x["close"])
    up, boundary = c("direction") == "up", c("boundary_price")
    out = out.withColumn("_p", p).withColumns({"_top": F.array_max("_p"), "_bottom": F.array_min("_p")})
    far, near = F.when(up, c("_top")).otherwise(c("_bottom")), F.when(up, c("_bottom")).otherwise(c("_top"))
    none = F.size("ahead") == 0
    place = lambda v: F.array_position("_p", v).cast("long") - 1
    back = lambda strict: F.array_position(F.transform("_p", lambda x: F.when(up, x < boundary if strict else x <= boundary).otherwise(x > boundary if strict else x >= boundary)), F.lit(True)).cast("long")
    steps = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda k: F.abs(F.element_at("_p", (k + 1).cast("int")) - F.element_at("_p", k.cast("int"))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumns({"_retest": back(False), "_fail": back(True)})
    return out.withColumns(
        {
            "max_excursion": F.when(none, 0.0).otherwise(F.abs(far - boundary) * F.when(F.when(up, far >= boundary).otherwise(far <= boundary), 1.0).otherwise(-1.0)),
            "max_excursion_bars": F.when(none, F.lit(0)).otherwise(place(far)),
            "close_after_n_bars": F.when(none, c("breakout_price")).otherwise(F.element_at("_p", -1)),
            "retracement_depth": F.when(none, 0.0).otherwise(c("_top") - c("_bottom")),
            "retracement_bars": F.when(none, F.lit(0)).otherwise(place(near)),
            "time_to_retest_boundary": F.when(c("_retest") > 0, c("_retest") - 1),
            "failure_bars_from_breakout": F.when(c("_fail") > 0, c("_fail") - 1),
            "failure_price": F.when(c("_fail") > 0, F.try_element_at("_p", c("_fail").cast("int"))),
            "post_breakout_volatility": F.when(F.size("_p") > 1, total(steps) / F.size("_p")).otherwise(0.0),
            "post_breakout_volume_mean": F.when(none, 0.0).otherwise(total(F.transform("ahead", lambda x: x["volume"])) / F.size("ahead")),
        }
    ).drop("ahead", "_p", "_top", "_bottom", "_retest", "_fail")


def classified(events: DataFrame, failure_retrace: float = 0.8, retest_window: int = 20, accumulation_bars: int = 15, min_progress: float = 0.3) -> DataFrame:
    """The class of a breakout from its follow-through; the first rule that holds decides."""
    size = c("range_high") - c("range_low")
    progress = F.coalesce(F.when(size > 0, c("max_excursion") / F.when(size > 0, size)), F.lit(0.0))
    retraced = F.coalesce(F.when(c("max_excursion") > 0, c("retracement_depth") / F.when(c("max_excursion") > 0, c("max_excursion"))), F.lit(0.0))
    kind = (
        F.when((c("max_excursion") <= 0) | (progress < min_progress), "failed_follow_through")
        .when(c("failure_bars_from_breakout").isNotNull() | (retraced >= failure_retrace), "false_breakout")
        .when(c("time_to_retest_boundary") <= retest_window, "with_retest")
        .when(c("max_excursion_bars") >= accumulation_bars, "accumulation")
        .otherwise("clean")
    )
    return events.withColumn("breakout_type", kind).withColumns({"is_failed": c("breakout_type").isin("failed_follow_through", "false_breakout"), "is_retest_occurred": c("breakout_type") == "with_retest"})


def confirmed(events: DataFrame, bars: DataFrame, closes: int = 2, max_bars: int = 10, delta_min: float | None = None) -> DataFrame:
    """Events with the bar at which so many closes in a row lay beyond the boundary, and with delta_min their deltas' sum too;
    confirmation_bar_index is NULL for those never confirmed. The fold over the next bars keeps run length and sum."""
    out = _near(events, bars, 1, max_bars, "ahead", "close", "delta")
    up = c("direction") == "up"
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("d"), F.lit(0).alias("k"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        beyond = F.when(up, x["close"] > c("boundary_price")).otherwise(x["close"] < c("boundary_price"))
        n, d, k = F.when(beyond, s["n"] + 1).otherwise(0), F.when(beyond, s["d"] + x["delta"]).otherwise(0.0), s["k"] + 1
        enough = n >= closes
        if delta_min is not None:
            enough = enough & F.when(up, d >= delta_min).otherwise(d <= -delta_min)
        return F.struct(n.alias("n"), d.alias("d"), k.alias("k"), F.when(s["at"] > 0, s["at"]).when(enough, k).otherwise(0).alias("at"))

    at = F.aggregate("ahead", zero, step)["at"]
    out = out.withColumn("_at", at)
    return out.withColumns({"confirmation_bar_index": F.when(c("_at") > 0, c("bar_index") + c("_at")), "confirmation_price": F.when(c("_at") > 0, F.try_element_at("ahead", c("_at"))["close"])}).drop("ahead", "_at")


#: The six scores' weights.
WEIGHTS = {"momentum": 1.0, "delta_imbalance": 1.0, "volume_spike": 1.0, "volatility": 1.0, "distance_from_vpoc": 0.7, "hvn_lvn_break": 0.7}
#: Between which compression ratios and from which stability a range passes, and what a borderline one loses.
FILTER = {"min_compression": 0.5, "max_compression": 1.0, "min_stability": 0.4, "soft_penalty": 0.3}


def strength(
    events: DataFrame,
    bars: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    method: str = "minmax",
    use_atr: bool = True,
    volatility_filter: dict[str, float] | None = FILTER,
    delta_bars: int = 20,
    volume_bars: int = 30,
    atr_period: int = 14,
    cap: float = 3.0,
    volume_cap: float | None = None,
    vpoc_reference: float = 0.5,
    level_tolerance: float = 0.1,
    atr_factor: float = 1.0,
) -> DataFrame:
    """Momentum, delta, volume, volatility, distance and low-volume-level scores, each at most 1, their weighted sum (raw) and its
    normalised form, and whether the range passes the volatility filter.

    Delta is capped at `cap` times its mean and volume at `volume_cap` times (None: the same); a distance of `vpoc_reference` ranges
    counts whole, a level within `level_tolerance` ranges of the price is broken, and an ATR of `atr_factor` ranges counts whole.

    Of the range, events may have vpoc, lvn (levels), midpoint, compression_ratio and stability_score. Without vpoc or midpoint
    the range's middle counts; without lvn the sixth score is 0; without the last two every range passes. Without ATR, momentum
    stands for volatility.
    """
    has = lambda name, other: c(name) if name in events.columns else other
    w, reach = {**WEIGHTS, **weights}, max(delta_bars, volume_bars, atr_period)
    out = _near(events, bars, -reach, 0, "behind", "open", "high", "low", "close", "volume", "delta")
    n = F.size("behind")
    at = lambda k: F.element_at("behind", k)
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    last = lambda name, k: F.transform(F.slice("behind", F.greatest(n - k, F.lit(1)), F.lit(k + 1)), lambda x: x[name])
    size = F.greatest(c("range_high") - c("range_low"), F.lit(1e-6))
    middle = has("midpoint", (c("range_high") + c("range_low")) / 2)
    capped = lambda x, m, most: F.least(F.when(m > 0, F.try_divide(x, m)).otherwise(0.0), F.lit(most)) / max(most, 1e-6)
    out = out.withColumn("atr_before", mean_range(c("behind"), atr_period))
    escape = F.abs(c("breakout_price") - has("vpoc", middle)) / (vpoc_reference * size) if vpoc_reference > 0 else F.lit(0.0)
    out = out.withColumns(
        {
            "momentum_score": F.least(F.abs(c("breakout_price") - F.when(n > 1, F.try_element_at("behind", F.lit(-2))["close"]).otherwise(at(-1)["open"])) / size, F.lit(1.0)),
            "delta_imbalance_score": capped(F.abs("initial_delta"), mean(F.transform(last("delta", delta_bars), F.abs)), cap),
            "volume_spike_score": capped(c("initial_volume"), mean(last("volume", volume_bars)), cap if volume_cap is None else volume_cap),
            "distance_from_vpoc_score": F.least(escape, F.lit(1.0)),
        }
    )
    if "lvn" in events.columns:
        ahead = F.filter("lvn", lambda p: F.when(c("direction") == "up", p >= middle).otherwise(p <= middle))
        out = out.withColumn("hvn_lvn_break_score", F.coalesce(F.exists(ahead, lambda p: F.abs(c("breakout_price") - p) <= level_tolerance * size), F.lit(False)).cast("double"))
    else:
        out = out.withColumn("hvn_lvn_break_score", F.lit(0.0))
    moved = F.least(c("atr_before") / size / max(atr_factor, 1e-6), F.lit(1.0)) if use_atr else c("momentum_score")
    if volatility_filter and {"compression_ratio", "stability_score"} <= set(events.columns):
        f, ratio, stable = volatility_filter, c("compression_ratio"), c("stability_score")
        passes = (ratio >= f["min_compression"]) & (ratio <= f["max_compression"]) & (stable >= f["min_stability"])
        border = passes & ((ratio < f["min_compression"] * 1.1) | (stable < f["min_stability"] * 1.1))
        moved = moved * F.when(border, 1 - f["soft_penalty"]).otherwise(1.0)
    else:
        passes = F.lit(True)
    out = out.withColumns({"volatility_score": moved, "volatility_filter_pass": passes})
    raw = sum((c(f"{name}_score") * weight for name, weight in w.items()), F.lit(0.0))
    return out.withColumn("overall_strength_score", raw).withColumn("overall_strength_normalized", squashed(c("overall_strength_score"), method)).drop("behind")


#: The columns of an event in their order.
EVENT = (
    "breakout_id", "parent_balance_id", "instrument", "timeframe", "breakout_time", "breakout_bar_index", "direction", "breakout_type", "confirmation_status", "confirmation_bar_index", "breakout_price", "confirmation_price",
    "boundary_price", "boundary_type", "balance_high", "balance_low", "balance_midpoint", "balance_range_size", "balance_vpoc", "balance_hvn", "balance_lvn", "balance_equilibrium_score", "initial_volume", "initial_delta",
    "atr_before", "atr_after", "strength_components", "follow_through", "bar_count_initial_move", "is_failed", "is_retest_occurred", "pre_breakout_signal", "tags",
)
FOLLOWED = ("max_excursion", "max_excursion_bars", "close_after_n_bars", "retracement_depth", "retracement_bars", "time_to_retest_boundary", "failure_bars_from_breakout", "failure_price", "post_breakout_volatility", "post_breakout_volume_mean")


#: Bars after a breakout at which its second ATR is taken.
AFTER = 5


def assembled(bars: DataFrame, found: DataFrame, mode: str = "close_only", post_bars: int = 60, observation_bars: int = 40, closes: int = 2, confirm_bars: int = 10, **strong: object) -> DataFrame:
    """From balances (balances.detected, with equilibrium and pre_breakout_score) to whole events: the first breakout of each, its
    strength, follow-through, class and confirmation, with what is told of the balance, as nested columns in the contract's order."""
    signal = F.struct("compression_score", "lvn_proximity_score", c("volatility_score").alias("volatility_increase_score"), "delta_bias_score", "pre_total_score", "is_candidate")
    ranges = found.withColumns({"range_id": c("balance_id"), "vpoc": c("poc_price"), "balance_range_size": c("range_size"), "pre_breakout_signal": signal})
    broken = breakouts(bars, ranges, mode, post_bars, ("vpoc", "hvn", "lvn", "midpoint", "balance_range_size", "compression_ratio", "stability_score", "equilibrium_score", "pre_breakout_signal"))
    period = int(strong.get("atr_period", 14))
    reach = max(int(strong.get("delta_bars", 20)), int(strong.get("volume_bars", 30)), period)
    broken = near_bars(broken, bars, -reach, max(observation_bars, AFTER, confirm_bars), "around", *AROUND)
    out = confirmed(classified(follow_through(strength(broken, bars, **strong), bars, observation_bars)), bars, closes, confirm_bars)
    out = out.withColumn("atr_after", mean_range(F.filter("around", lambda x: x["bar_index"] <= c("bar_index") + AFTER), period))
    scores = [f"{n}_score" for n in WEIGHTS]
    tags = F.filter(F.array(F.lit("structural"), F.when(c("volatility_filter_pass"), "volatility_confirmed").otherwise("volatility_rejected"), F.when(c("confirmation_bar_index").isNotNull(), "confirmed")), lambda x: x.isNotNull())
    renamed = {"range_id": "parent_balance_id", "bar_index": "breakout_bar_index", "range_high": "balance_high", "range_low": "balance_low", "midpoint": "balance_midpoint", "vpoc": "balance_vpoc", "hvn": "balance_hvn", "lvn": "balance_lvn", "equilibrium_score": "balance_equilibrium_score"}
    out = out.withColumns(
        {
            "strength_components": F.struct(*scores, "overall_strength_score", "overall_strength_normalized", "volatility_filter_pass"),
            "follow_through": F.struct(*FOLLOWED),
            "confirmation_status": F.when(c("confirmation_bar_index").isNotNull(), "confirmed").otherwise("pending"),
            "bar_count_initial_move": F.lit(1),
            "tags": tags,
        }
    ).withColumnsRenamed(renamed)
    return out.select(*EVENT)


def early_signs(events: DataFrame, lower: DataFrame, since: str, min_run: int = 1, penetration: float = 0.0, max_lead_minutes: float = 600) -> DataFrame:
    """The first run of min_run closes beyond the boundary on a lower timeframe, from `since` to the breakout; only the first run
    counts, and only within the lead. The two series meet on instrument and date. Where the lower bars have their places, the
    first one's comes along as early_bar_index."""
    dates = F.explode(F.sequence(F.to_date(since), F.to_date("breakout_time"))).alias("_date")
    spans = events.select("instrument", "range_id", "direction", "boundary_price", "breakout_time", c(since).alias("_since"), dates)
    place = [c("bar_index").alias("low_index")] if "bar_index" in lower.columns else []
    ticks = lower.select("instrument", c("time").alias("low_time"), c("close").alias("low_close"), F.to_date("time").alias("_date"), *place)
    near = ticks.join(spans, ["instrument", "_date"]).where((c("low_time") >= c("_since")) & (c("low_time") < c("breakout_time")))
    beyond = F.when(c("direction") == "up", c("low_close") > c("boundary_price") + penetration).otherwise(c("low_close") < c("boundary_price") - penetration)
    w = W.partitionBy("instrument", "range_id").orderBy("low_time")
    runs = near.withColumn("_in", beyond).withColumn("_run", F.sum(F.when(c("_in"), 0).otherwise(1)).over(w)).where("_in")
    first = runs.groupBy("instrument", "range_id", "_run", "breakout_time").agg(F.count(F.lit(1)).alias("n"), F.min("low_time").alias("early_time"), F.min_by("low_close", "low_time").alias("early_price"), *(F.min("low_index").alias("early_bar_index") for _ in place)).where(c("n") >= min_run)
    one = first.groupBy("instrument", "range_id", "breakout_time").agg(F.min("early_time").alias("early_time"), F.min_by("early_price", "early_time").alias("early_price"), *(F.min("early_bar_index").alias("early_bar_index") for _ in place))
    lead = F.timestamp_diff("SECOND", c("early_time"), c("breakout_time")) / 60
    return one.withColumn("lead_minutes", lead).where(c("lead_minutes") <= max_lead_minutes)


def rotation_context(events: DataFrame, rotations: DataFrame) -> DataFrame:
    """Counts and sums of a range's rotations that ended by the breakout, and how much of their delta went its way.

    `rotations` has the range's id. The weights of the kinds are fixed values."""
    weight = F.when(c("rotation_type") == "micro", 0.5).when(c("rotation_type") == "structural", 1.5).otherwise(1.0) * F.abs("delta")
    r = rotations.select("range_id", "rotation_index", c("direction").alias("way"), "rotation_type", "valid", "end_time", "delta", "volume")
    before = events.select("breakout_id", "range_id", "direction", "breakout_time").join(r, "range_id", "left").where(c("end_time").isNull() | (c("end_time") <= c("breakout_time")))
    n = F.count("rotation_index")
    aligned = (c("way") == c("direction")) & c("valid")
    made = before.groupBy("breakout_id").agg(
        n.alias("total_rotations"),
        F.count_if("valid").alias("valid_rotations"),
        *(F.count_if(c("rotation_type") == k).alias(f"{k}_count") for k in ("micro", "standard", "structural")),
        F.count_if(c("way") == "up").alias("up_count"),
        F.count_if(c("way") == "down").alias("down_count"),
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("total_delta"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"),
        F.max_by("way", "rotation_index").alias("last_rotation_direction"),
        F.max_by("rotation_type", "rotation_index").alias("last_rotation_type"),
        F.coalesce(F.max_by("delta", "rotation_index"), F.lit(0.0)).alias("last_rotation_delta"),
        F.coalesce(F.max_by("volume", "rotation_index"), F.lit(0.0)).alias("last_rotation_volume"),
        F.coalesce(F.max_by("valid", "rotation_index"), F.lit(False)).alias("last_rotation_valid"),
        F.coalesce(F.try_divide(F.sum(F.when(aligned, weight).otherwise(0.0)), F.sum(weight)), F.lit(0.0)).alias("rotation_alignment_score"),
    )
    share = lambda x: x / F.greatest(c("total_rotations"), F.lit(1))
    return made.withColumns({"directional_bias": share(c("up_count") - c("down_count")), "validity_ratio": share(c("valid_rotations")), "structural_ratio": share(c("structural_count"))})


def ranked(events: DataFrame) -> DataFrame:
    """Rank by strength within the instrument, and within its day."""
    by = F.desc("overall_strength_score")
    return events.withColumns({"global_rank": F.rank().over(W.partitionBy("instrument").orderBy(by)), "session_rank": F.rank().over(W.partitionBy("instrument", F.to_date("breakout_time")).orderBy(by))})


#: What an event says where nothing is known, and the version of its producer.
UNKNOWN = {"session_id": "unknown", "version": "0.2.0", "bars_observed": 0}


def whole(
    events: DataFrame,
    found: DataFrame,
    members: DataFrame,
    lower: DataFrame | None = None,
    session_levels: DataFrame | None = None,
    config: dict | None = None,
    computed: dt.datetime | None = None,
    early: dict | None = None,
) -> DataFrame:
    """Events by the whole contract, its columns in its order: `assembled` events with the context of their balance's rotations, early
    signs on a lower timeframe, ranks by strength, and the levels of their session.

    `found` are the balances and `members` the rotations of their clusters; without lower bars or levels the columns are NULL, as
    are those that no step of the chain tells. `early` has min_run, penetration, max_lead_minutes and the lower timeframe's name.
    """
    early = dict(early or {})
    frame = early.pop("timeframe", None)
    out = events.withColumns({"range_id": c("parent_balance_id"), "overall_strength_score": c("strength_components.overall_strength_score")})
    out = ranked(out)
    turns = members.withColumn("range_id", F.concat_ws("_", F.lit("bal"), "instrument", "cluster"))
    told = rotation_context(out, turns)
    out = out.join(told.select("breakout_id", F.struct(*(n for n in told.columns if n != "breakout_id")).alias("rotation_context")), "breakout_id", "left")
    null = lambda kind: F.lit(None).cast(kind)
    if lower is None:
        out = out.withColumns({"early_time": null(events.schema["breakout_time"].dataType), "early_price": null("double"), "early_bar_index": null("long"), "lead_minutes": null("double")})
    else:
        since = found.select(c("balance_id").alias("range_id"), c("start_time").alias("_since"))
        signs = early_signs(out.join(since, "range_id"), placed(lower), "_since", **early)
        out = out.join(signs.select("range_id", "early_time", "early_price", "early_bar_index", "lead_minutes"), "range_id", "left")
    if session_levels is None:
        out = out.withColumns({n: null("double") for n in LEVELS})
    else:
        near = enriched(dated_events(out.select("breakout_id", "instrument", "breakout_time", "breakout_price", "direction")), session_levels)
        out = out.join(near.select("breakout_id", *LEVELS), "breakout_id", "left")
    signed = F.when(c("early_time").isNotNull(), F.array(F.lit("early_detected"), F.format_string("early_%.1fm", c("lead_minutes")))).otherwise(F.array().cast("array<string>"))
    bias = F.coalesce(c("rotation_context.directional_bias"), F.lit(0.0))
    made = {
        "early_timeframe": F.when(c("early_time").isNotNull(), F.lit(frame)),
        "minutes_of_anticipation": c("lead_minutes"),
        "tags": F.concat("tags", signed, F.array(F.format_string("rot_bias=%.2f", bias))),
        "config_snapshot": F.lit(canonical_json(config or {})),
        "computation_timestamp": F.lit(computed).cast("timestamp") if computed else F.current_timestamp(),
        "schema_version": F.lit(SCHEMA_VERSION),
        **{n: F.lit(v) for n, v in UNKNOWN.items()},
    }
    out = out.withColumns(made)
    absent = {"confirmation_time": events.schema["breakout_time"].dataType, "symbol": "string", "notes": "string", "post_breakout_volume_profile": "string"}
    return out.select(*(c(n) if n in out.columns else null(absent.get(n, "double")).alias(n) for n in EVENT_COLUMNS))

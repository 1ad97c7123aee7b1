"""Feature, bucket, outcome and target columns of breakout events: row-local projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ratio, true_or_false

c = F.col

#: Lower bounds and labels of the buckets.
BUCKETS = {
    "compression_bucket": ("range_atr_ratio", (0, 0.5, 1, 1.5, 2.5), ("ultra_compressed", "compressed", "balanced", "expanded", "ultra_expanded")),
    "delta_bucket": ("abs_initial_delta", (0, 100, 300, 600, 1000), ("delta_0_100", "delta_100_300", "delta_300_600", "delta_600_1000", "delta_1000_plus")),
    "volume_bucket": ("initial_volume", (float("-inf"), 50, 150, 400, 800), ("very_low", "low", "medium", "high", "extreme")),
    "atr_bucket": ("atr_before", (0, 0.5, 1, 1.5, 2.5), ("atr_0_0_5", "atr_0_5_1_0", "atr_1_0_1_5", "atr_1_5_2_5", "atr_2_5_plus")),
    "pre_bo_bucket": ("total_score", (float("-inf"), 0, 2, 4, 6), ("pre_neg", "pre_0_2", "pre_2_4", "pre_4_6", "pre_6_plus")),
    "time_bucket": ("hour", (0, 4, 8, 12, 16, 20), ("tb_00_04", "tb_04_08", "tb_08_12", "tb_12_16", "tb_16_20", "tb_20_24")),
}


def ratios(df: DataFrame) -> DataFrame:
    """Side and the guarded ratios of an event's sizes."""
    return df.withColumns(
        {
            "side": F.when(c("direction") == "up", "long").when(c("direction") == "down", "short"),
            "range_atr_ratio": ratio(c("balance_range_size"), c("atr_before")),
            "balance_pressure": ratio(c("atr_before"), c("balance_range_size")),
            "breakout_location_ratio": ratio(c("breakout_price") - c("balance_midpoint"), c("balance_range_size")),
            "abs_initial_delta": F.abs("initial_delta"),
            "volume_atr_ratio": ratio(c("initial_volume"), c("atr_before")),
            "volume_range_ratio": ratio(c("initial_volume"), c("balance_range_size")),
            "breakout_efficiency": ratio(c("max_excursion"), c("atr_before")),
        }
    )


def decimal_hour(t: Column) -> Column:
    return F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600


def calendar_columns(df: DataFrame, time: str = "breakout_time") -> DataFrame:
    """Decimal hour, its session, lower-case weekday, day, week (of seven days from the first) and year."""
    t = c(time)
    h = decimal_hour(t)
    session = F.when(h < 8, "asia").when(h < 13, "europe").when(h < 21, "ny").when(h < 24, "off")
    return df.withColumns({"hour": h, "session_calc": session, "weekday": F.lower(F.date_format(t, "EEEE")), "day_of_month": F.dayofmonth(t), "week_of_month": (F.floor((F.dayofmonth(t) - 1) / 7) + 1).cast("int"), "year": F.year(t)})


def bucket(value: Column, bounds: tuple, labels: tuple, above_first: bool = False) -> Column:
    """The label of the last bound that the value reaches; with above_first the first bound itself is outside.

    Rules count in their order and the last that holds wins, also where bounds don't rise.
    """
    out = None
    ends = [*bounds[1:], float("inf")]
    for k in reversed(range(len(labels))):
        low = value > bounds[k] if above_first and k == 0 else value >= bounds[k]
        inside = (low if bounds[k] != float("-inf") else value.isNotNull()) & (value < ends[k] if ends[k] != float("inf") else F.lit(True))
        out = F.when(inside, labels[k]) if out is None else out.when(inside, labels[k])
    return out


def bucketed(df: DataFrame, name: str, bounds: tuple | None = None) -> DataFrame:
    source, own, labels = BUCKETS[name]
    return df.withColumn(name, bucket(c(source), bounds or own, labels, name == "atr_bucket"))


def outcome(df: DataFrame) -> DataFrame:
    """false_breakout and failed_follow_through keep their name; everything else, NULL too, is a true breakout."""
    kept = c("breakout_type").isin("false_breakout", "failed_follow_through")
    return df.withColumn("breakout_outcome", F.when(kept, c("breakout_type")).otherwise("true_breakout"))


def primary_target(df: DataFrame, k: float, name: str = "target_primary") -> DataFrame:
    """Whether the excursion reached k ranges; NULL without a positive range, false without an excursion."""
    return df.withColumn(name, F.when(c("atr_before") > 0, true_or_false(c("max_excursion") >= k * c("atr_before"))))


def tick_target(df: DataFrame, ticks: float, tick_size: float, name: str = "target_secondary") -> DataFrame:
    return df.withColumn(name, true_or_false(c("max_excursion") >= ticks * tick_size))


def atr_scan(df: DataFrame, start: float, end: float, step: float, base: str = "t1", rounded: bool = False) -> DataFrame:
    """A target for each multiple; their names carry the sum as it drifts, unless rounded."""
    made, x = {}, start
    while x <= end + 1e-9:
        shown = round(x, 10) if rounded else x
        made[f"{base}_{str(shown).replace('.', '_')}ATR"] = true_or_false(c("max_excursion") >= x * c("atr_before"))
        x += step
    return df.withColumns(made)


def tick_scan(df: DataFrame, levels: list[int], tick_size: float) -> DataFrame:
    return df.withColumns({f"t2_{n}ticks": true_or_false(c("max_excursion") >= n * tick_size) for n in levels})


def clean_ticks(df: DataFrame, levels: list[int], tick_size: float, threshold: float, multiplier: float = 1.0) -> DataFrame:
    """The tick targets whose retracement also stays within threshold ranges."""
    calm = true_or_false(c("retracement_depth") <= threshold * multiplier * c("atr_before"))
    return df.withColumns({f"t2_{n}ticks_clean": true_or_false(c("max_excursion") >= n * tick_size) & calm for n in levels})


def clean_quant(df: DataFrame, base: str, threshold: float) -> DataFrame:
    """Base target and retracement within threshold of the excursion, as a boolean and a label; NULL where the base is."""
    share = F.when(c("max_excursion") > 0, c("retracement_depth") / c("max_excursion"))
    both = c(base) & true_or_false(share <= threshold)
    return df.withColumns({"clean_quant": both, "clean_label": F.when(both, "clean").when(~both, "not_clean")})

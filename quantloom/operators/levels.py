"""Price levels by day and session: OHLC, value area, volume-weighted prices, and the contexts of day, week and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import half_even_bin, ratio

#: Session name, opening and closing minute of the day; a session may pass midnight.
SESSIONS = (("asia", 60, 600), ("europe", 540, 1050), ("usa", 930, 1320))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def in_session(minute: Column, opens: int, closes: int) -> Column:
    return (minute >= opens) & (minute < closes) if opens < closes else (minute >= opens) | (minute < closes)


def by_session(bars: DataFrame, sessions: tuple = SESSIONS) -> DataFrame:
    """Each bar once for every session it lies in, with its date."""
    minute = F.hour("time") * 60 + F.minute("time")
    names = F.filter(F.array(*(F.when(in_session(minute, a, b), n) for n, a, b in sessions)), lambda x: x.isNotNull())
    return bars.withColumn("date", F.to_date("time")).withColumn("session_name", F.explode(names))


def vwap(price: Column) -> Column:
    """Volume-weighted mean of a price, NULL without volume."""
    return F.when(F.sum("volume") > 0, F.sum(price * F.col("volume")) / F.sum("volume"))


def ohlc(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("volume").alias("volume"),
        vwap(typical()).alias("vwap"),
        vwap(F.col("close")).alias("vwap_close"),
    )


def volume_profile(bars: DataFrame, keys: list[str], bin_size: float = 1.0) -> DataFrame:
    """Volume by bin of the typical price; halves go to the even bin."""
    return bars.groupBy(*keys, half_even_bin(typical(), bin_size).alias("price")).agg(F.sum("volume").alias("volume"))


def value_area(profile: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """poc, vah and val: from the bin of most volume (the lowest of ties) towards the larger neighbour, right on ties, until the
    share is covered; without volume all three are the lowest bin."""
    bins = profile.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("price", "volume"))).alias("b"), F.sum("volume").alias("t"))
    return _walked(bins, share).select(*keys, "poc", "vah", "val")


def _walked(bins: DataFrame, share: float) -> DataFrame:
    """The walk is a fold over the sorted bins `b` of one group with volume `t`, in the JVM."""
    volumes = F.transform("b", lambda x: x["volume"])
    at = F.array_position(volumes, F.array_max(volumes)).cast("int") - 1
    start = F.struct(F.col("_poc").alias("l"), F.col("_poc").alias("r"), F.col("b")[F.col("_poc")]["volume"].alias("v"))

    def step(s: Column, _: Column) -> Column:
        left = F.when(s["l"] > 0, F.col("b")[F.greatest(s["l"] - 1, F.lit(0))]["volume"]).otherwise(-1.0)
        right = F.when(s["r"] < F.size("b") - 1, F.col("b")[F.least(s["r"] + 1, F.size("b") - 1)]["volume"]).otherwise(-1.0)
        done = (s["v"] / F.col("t") >= share) | ((left < 0) & (right < 0))
        go_right = right >= left
        return F.struct(
            F.when(done | go_right, s["l"]).otherwise(s["l"] - 1).alias("l"),
            F.when(done | ~go_right, s["r"]).otherwise(s["r"] + 1).alias("r"),
            F.when(done, s["v"]).when(go_right, s["v"] + right).otherwise(s["v"] + left).alias("v"),
        )

    walked = bins.withColumn("_poc", at).withColumn("_w", F.when(F.col("t") > 0, F.aggregate("b", start, step)))
    lowest, there = F.col("b")[0]["price"], F.col("t") > 0
    price = lambda k: F.when(there, F.col("b")[k]["price"]).otherwise(lowest)
    return walked.withColumns({"poc": price(F.col("_poc")), "vah": price(F.col("_w.r")), "val": price(F.col("_w.l"))}).drop("b", "t", "_poc", "_w")


def summed(bars: DataFrame, keys: list[str], bin_size: float = 1.0, share: float = 0.7) -> DataFrame:
    """OHLC, volume, both volume-weighted prices and the value area of each group, from one pass over its bars: they are summed
    by price bin first, and the bins give both the profile and the group's own figures."""
    first, last = F.min(F.struct("time", "open")).alias("_first"), F.max(F.struct("time", "close")).alias("_last")
    bins = bars.groupBy(*keys, half_even_bin(typical(), bin_size).alias("price")).agg(
        first, last, F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.sum(typical() * F.col("volume")).alias("_tv"), F.sum(F.col("close") * F.col("volume")).alias("pv")
    )
    whole = bins.groupBy(*keys).agg(
        F.min("_first")["open"].alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max("_last")["close"].alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("_tv").alias("_tv"),
        F.sum("pv").alias("pv"),
        F.sum("volume").alias("t"),
        F.sort_array(F.collect_list(F.struct("price", "volume"))).alias("b"),
    )
    weighted = lambda x: F.when(F.col("volume") > 0, F.try_divide(x, F.col("volume")))
    return _walked(whole, share).withColumns({"vwap": weighted(F.col("_tv")), "vwap_close": weighted(F.col("pv"))}).drop("_tv")


def _context(bars: DataFrame, name: str, keys: list[Column], causal: bool) -> DataFrame:
    """High, low and closing VWAP of each date's whole period, or with causal up to the date."""
    days = bars.withColumn("date", F.to_date("time")).groupBy("instrument", "date").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.sum(F.col("close") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
    w = W.partitionBy("instrument", *keys)
    w = w.orderBy("date").rowsBetween(W.unboundedPreceding, 0) if causal else w
    return days.select("instrument", "date", F.max("h").over(w).alias(f"{name}_high"), F.min("l").over(w).alias(f"{name}_low"), F.when(F.sum("v").over(w) > 0, F.sum("pv").over(w) / F.sum("v").over(w)).alias(f"{name}_vwap"))


def weekly(bars: DataFrame, causal: bool = False) -> DataFrame:
    """Weeks are ISO weeks of ISO years."""
    return _context(bars, "weekly", [F.extract(F.lit("YEAROFWEEK"), "date"), F.weekofyear("date")], causal)


def monthly(bars: DataFrame, causal: bool = False) -> DataFrame:
    return _context(bars, "monthly", [F.year("date"), F.month("date")], causal)


def previous_day(bars: DataFrame, bin_size: float = 1.0) -> DataFrame:
    """The levels of exactly the calendar day before, for each date that has one."""
    days = bars.withColumn("date", F.to_date("time"))
    found = summed(days, ["instrument", "date"], bin_size)
    return found.select("instrument", F.date_add("date", 1).alias("date"), *(F.col(s).alias(f"prev_day_{d}") for d, s in OF_DAY_BEFORE.items()))


OF_DAY_BEFORE = {"high": "high", "low": "low", "poc": "poc", "vah": "vah", "val": "val", "vwap": "vwap_close"}


def _spans(days: DataFrame, causal: bool) -> DataFrame:
    """The day table with the contexts that come of it alone: the calendar day before, the ISO week and the month."""
    row = W.partitionBy("instrument").orderBy("date")
    yesterday = F.lag("date").over(row) == F.date_add("date", -1)
    out = days.withColumns({f"prev_day_{d}": F.when(yesterday, F.lag(s).over(row)) for d, s in OF_DAY_BEFORE.items()})
    for name, keys in (("weekly", [F.extract(F.lit("YEAROFWEEK"), "date"), F.weekofyear("date")]), ("monthly", [F.year("date"), F.month("date")])):
        w = W.partitionBy("instrument", *keys)
        w = w.orderBy("date").rowsBetween(W.unboundedPreceding, 0) if causal else w
        out = out.withColumns({f"{name}_high": F.max("high").over(w), f"{name}_low": F.min("low").over(w), f"{name}_vwap": F.when(F.sum("volume").over(w) > 0, F.try_divide(F.sum("pv").over(w), F.sum("volume").over(w)))})
    return out.drop("pv")


def session_levels(bars: DataFrame, sessions: tuple = SESSIONS, bin_size: float = 1.0, causal: bool = False) -> DataFrame:
    """A row for each instrument, date and session with bars: its levels, its day's, and those of the day before, week and month.

    Bars are read for the sessions and for the days; all longer contexts come of the day table. A level of the day before is
    touched where it lies in the session's range, and broken where the session opens on one side and reaches it.
    """
    own, day = ["instrument", "date", "session_name"], ["instrument", "date"]
    named = lambda df, prefix, keys: df.select(*keys, *(F.col(x).alias(f"{prefix}_{x}" if x in LEVELS else x) for x in df.columns if x not in keys))
    parts = named(summed(by_session(bars, sessions), own, bin_size).drop("pv"), "session", own)
    days = named(_spans(summed(bars.withColumn("date", F.to_date("time")), day, bin_size), causal), "day", day)
    out = parts.join(days, day)
    opens, high, low = F.col("session_open"), F.col("session_high"), F.col("session_low")
    flags = {f"touched_{x}": (low <= F.col(x)) & (high >= F.col(x)) for x in ("prev_day_poc", "prev_day_vah", "prev_day_val", "prev_day_vwap", "weekly_high", "weekly_low")}
    flags |= {f"broke_{x}": ((opens > F.col(x)) & (low <= F.col(x))) | ((opens < F.col(x)) & (high >= F.col(x))) for x in ("prev_day_poc", "prev_day_vah", "prev_day_val", "prev_day_vwap")}
    return out.withColumns({"session_mid": (high + low) / 2, "session_range": high - low, **flags})


LEVELS = ("open", "high", "low", "close", "volume", "vwap", "vwap_close", "poc", "vah", "val")


def previous_period(bars: DataFrame, period: str = "week") -> DataFrame:
    """High, low and closing VWAP of the ISO week or month before each date's, for dates that have one with bars."""
    days = bars.withColumn("date", F.to_date("time")).groupBy("instrument", "date").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.sum(F.col("close") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
    begins = F.date_trunc(period, "date").cast("date")
    whole = days.groupBy("instrument", begins.alias("begins")).agg(F.max("h").alias(f"prev_{period}_high"), F.min("l").alias(f"prev_{period}_low"), F.when(F.sum("v") > 0, F.try_divide(F.sum("pv"), F.sum("v"))).alias(f"prev_{period}_vwap"))
    following = F.date_add("begins", 7) if period == "week" else F.add_months("begins", 1)
    return days.select("instrument", "date", begins.alias("begins")).join(whole.withColumn("begins", following), ["instrument", "begins"]).drop("begins")


SUPPORTS = ("session_low", "day_low", "prev_day_low", "weekly_low", "monthly_low", "session_val", "day_val", "prev_day_val")
RESISTANCES = ("session_high", "day_high", "prev_day_high", "weekly_high", "monthly_high", "session_vah", "day_vah", "prev_day_vah")


def level_features(events: DataFrame, near: float = 50.0) -> DataFrame:
    """Nearest support and resistance of breakout_price among the level columns, their distance, how many levels are near, and the
    share of space ahead in the event's direction (a half where there is none)."""
    p = F.col("breakout_price")
    present = lambda names: F.filter(F.array(*(F.col(n) for n in names if n in events.columns)), lambda x: x.isNotNull())
    support = F.array_max(F.filter(present(SUPPORTS), lambda x: x <= p))
    resistance = F.array_min(F.filter(present(RESISTANCES), lambda x: x >= p))
    close_by = F.size(F.filter(present(SUPPORTS + RESISTANCES), lambda x: F.abs(x - p) <= near)).cast("double")
    out = events.withColumns({"ml_nearest_support": support, "ml_nearest_resistance": resistance, "ml_cluster_strength": close_by, "ml_density": close_by / near})
    below, above = p - F.col("ml_nearest_support"), F.col("ml_nearest_resistance") - p
    ahead = F.when(below + above == 0, 0.5).otherwise(F.when(F.col("direction") == "up", above).otherwise(below) / F.when(below + above != 0, below + above))
    out = out.withColumns({"ml_distance_to_level": F.least(below, above), "ml_alignment_score": ahead})
    return out.withColumn("ml_distance_atr", ratio(F.col("ml_distance_to_level"), F.col("atr_before"))) if "atr_before" in out.columns else out


def dated_events(events: DataFrame, sessions: tuple = SESSIONS) -> DataFrame:
    """Events with their date and the first session that their time lies in; 'off' outside all."""
    minute = F.hour("breakout_time") * 60 + F.minute("breakout_time")
    names = F.filter(F.array(*(F.when(in_session(minute, a, z), n) for n, a, z in sessions)), lambda x: x.isNotNull())
    return events.withColumns({"date": F.to_date("breakout_time"), "session_name": F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("off"))})


def enriched(events: DataFrame, levels: DataFrame) -> DataFrame:
    """Events with the levels of their instrument, date and session, names compared in lower case; of several rows the last written
    (by `written` if there is one) counts, and an event without a match keeps NULLs."""
    keys = ["instrument", "date", "session_name"]
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("written") if "written" in levels.columns else F.desc("session_close")))
    tidy = lambda df: df.withColumns({"instrument": F.upper("instrument"), "session_name": F.lower("session_name")})
    one = tidy(levels).withColumn("_n", last).where("_n = 1").drop("_n")
    return level_features(tidy(events).join(one, keys, "left"))

"""Similar windows of bars, templates of candles, and what followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import selection
from ..functions.scalars import channel_similarity, cosine_distance, rms_distance, tolerance_score
from ..sources.tables import SERIES, indexed
from .balances import within
from .bars import forward_extrema, near, rolling, rows

c = F.col
TINY = 1e-12


def windows(bars: DataFrame, length: int) -> DataFrame:
    """Every window of `length` bars: the index and time of its first and last bar, and the vectors of its channels.

    Price: range, body, upper and lower wick of each bar over the window's mean range. Volume and delta: over their mean.
    """
    frame, channels = rows(0, length - 1), ("open", "high", "low", "close", "volume", "delta")
    taken = rolling(indexed(bars).select(*SERIES, "bar_index", "time", *channels), [{"w": F.collect_list(F.struct(*channels)).over(frame), "end_time": F.last("time").over(frame)}], 0, length - 1)
    full = taken.where(F.size("w") == length)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / length
    guarded = lambda m: F.when(F.abs(m) < TINY, TINY).otherwise(m)
    full = full.withColumn("scale", F.greatest(mean(F.transform("w", lambda b: b["high"] - b["low"])), F.lit(TINY)))
    full = full.withColumn("mean_volume", guarded(mean(F.transform("w", lambda b: b["volume"])))).withColumn("mean_delta", guarded(mean(F.transform("w", lambda b: b["delta"]))))
    zero = lambda x: F.greatest(x, F.lit(0.0)) / c("scale")
    shape = lambda b: F.array(zero(b["high"] - b["low"]), F.abs(b["close"] - b["open"]) / c("scale"), zero(b["high"] - F.greatest(b["open"], b["close"])), zero(F.least(b["open"], b["close"]) - b["low"]))
    return full.select(
        *SERIES,
        c("bar_index").alias("start_index"),
        c("time").alias("start_time"),
        "end_time",
        (c("bar_index") + length - 1).alias("end_index"),
        F.flatten(F.transform("w", shape)).alias("price"),
        F.transform("w", lambda b: b["volume"] / c("mean_volume")).alias("volume"),
        F.transform("w", lambda b: b["delta"] / c("mean_delta")).alias("delta"),
    )


def reference(found: DataFrame, instrument: str, start_index: int) -> dict[str, list[float]]:
    """The channels of one window, a few numbers, to compare all others with."""
    row = found.where((c("instrument") == instrument) & (c("start_index") == start_index)).first()
    if row is None:
        raise ValueError("no such window")
    return {n: list(row[n]) for n in ("price", "volume", "delta")}


def similarity(found: DataFrame, wanted: dict[str, list[float]], weights: dict[str, float], caps: dict[str, float], method: str = "euclidean") -> DataFrame:
    """Windows with their similarity to the wanted channels."""
    measure = {"euclidean": rms_distance, "cosine": cosine_distance}[method]
    vector = lambda v: F.array(*(F.lit(float(x)) for x in v))
    return found.withColumn("score", channel_similarity([(measure(c(n), vector(v)), weights.get(n, 0.0), caps.get(n, 1.0)) for n, v in wanted.items()]))


def matches(scored: DataFrame, tolerance: float) -> DataFrame:
    return scored.where(c("score") >= tolerance).select(*SERIES, "start_index", "start_time", "end_index", "end_time", "score")


def top(found: DataFrame, n: int = 10) -> DataFrame:
    """The n best, earlier ones first among equals."""
    return found.orderBy(F.desc("score"), "start_time", *SERIES).limit(n)


def candle_scores(bars: DataFrame, template: list[dict], tick: float, percents: dict[str, float]) -> DataFrame:
    """Every window of as many bars as the template has candles, with the mean of the candles' scores.

    A candle's score is the weighted mean of direction, body, wicks, volume, delta and where it closed (quarters of its range).
    """
    span = c("high") - c("low")
    place = F.when(span <= 0, "middle").otherwise(F.when((c("close") - c("low")) / F.when(span > 0, span) >= 0.75, "high").when((c("close") - c("low")) / F.when(span > 0, span) <= 0.25, "low").otherwise("middle"))
    way = F.when(c("close") > c("open"), "bullish").when(c("close") < c("open"), "bearish").otherwise("neutral")
    made = indexed(bars).withColumns({"_way": way, "_place": place, "_body": F.abs(c("close") - c("open")) / tick, "_upper": (c("high") - F.greatest("open", "close")) / tick, "_lower": (F.least("open", "close") - c("low")) / tick})
    same = lambda x, wanted: F.lit(1.0) if wanted in (None, "any") else F.when(x == wanted, 1.0).otherwise(0.0)

    def score(t: dict) -> Column:
        parts = [
            (same(c("_way"), t.get("direction")), 1.0),
            (tolerance_score(c("_body"), t.get("body_ticks"), percents["body"]), 1.0),
            (tolerance_score(c("_upper"), t.get("upper_wick_ticks"), percents["wick"]), 1.0),
            (tolerance_score(c("_lower"), t.get("lower_wick_ticks"), percents["wick"]), 1.0),
            (tolerance_score(c("volume"), t.get("volume"), percents["volume"]), 0.5),
            (tolerance_score(c("delta"), t.get("delta"), percents["delta"]), 0.5),
            (same(c("_place"), t.get("close_position")), 0.75),
        ]
        return sum((s * w for s, w in parts), F.lit(0.0)) / sum(w for _, w in parts)

    made = made.withColumns({f"_s{k}": score(t) for k, t in enumerate(template)})
    total = sum((F.lead(f"_s{k}", k).over(near()) for k in range(len(template))), F.lit(0.0)) / len(template)
    last = F.lead("time", len(template) - 1).over(near())
    made = rolling(made.select(*SERIES, "bar_index", "time", *(f"_s{k}" for k in range(len(template)))), [{"end_time": last, "score": total}], 0, len(template) - 1)
    return made.select(*SERIES, c("bar_index").alias("start_index"), c("time").alias("start_time"), "end_time", "score").where("score is not null")


def outcomes(found: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Best and worst moves of the `horizon` bars after each match, for both sides; matches with fewer bars after them go."""
    after = forward_extrema(indexed(bars), horizon).where(c("next_bars") == horizon).select(*SERIES, c("bar_index").alias("end_index"), "close", "next_high", "next_low")
    out = found.join(after, [*SERIES, "end_index"])
    return out.withColumns({"long_mfe": c("next_high") - c("close"), "long_mae": c("close") - c("next_low"), "short_mfe": c("close") - c("next_low"), "short_mae": c("next_high") - c("close")}).drop("close", "next_high", "next_low")


def outcome_stats(found: DataFrame, values: list[str]) -> DataFrame:
    """For each value a row: n, mean, median and quartiles (linear), and the ninth decile."""
    pairs = ", ".join(f"'{v}', {v}" for v in values)
    long = found.selectExpr(f"stack({len(values)}, {pairs}) as (name, value)")
    return selection.grouped(long, ["name"], c("value"), {"median": 0.5, "q25": 0.25, "q75": 0.75, "q90": 0.9}, [F.count("value").alias("n"), F.avg("value").alias("mean")])


def hit_rates(found: DataFrame, levels: list[float]) -> DataFrame:
    """For each level the share of matches whose best move reached it and whose worst stayed within it."""
    level = F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("level")
    return found.select("long_mfe", "long_mae", level).groupBy("level").agg(F.avg((c("long_mfe") >= c("level")).cast("double")).alias("reached"), F.avg((c("long_mae") <= c("level")).cast("double")).alias("within"))


def context(found: DataFrame, bars: DataFrame, before: int, after: int) -> DataFrame:
    """The bars of each match and around it."""
    spans = found.select(*SERIES, "start_index", "end_index", F.greatest(c("start_index") - before, F.lit(0)).alias("_first"), (c("end_index") + after).alias("_last"))
    return within(indexed(bars), spans, "_first", "_last").drop("_first", "_last")


def snapped(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (instrument, at) the first bar at or after it: both are put in one order, a day at a time, and the next bar's
    time looked up; where a day has none left, the next day with bars tells."""
    both = bars.select("instrument", c("time").alias("t"), c("time").alias("bar"), F.lit(0).alias("asked")).unionByName(wanted.select("instrument", c("at").alias("t"), F.lit(None).cast("timestamp_ntz").alias("bar"), F.lit(1).alias("asked")))
    both = both.withColumn("_day", F.to_date("t"))
    ahead = W.partitionBy("instrument", "_day").orderBy("t", F.desc("asked")).rowsBetween(0, W.unboundedFollowing)
    later = W.partitionBy("instrument").orderBy("_day").rowsBetween(1, W.unboundedFollowing)
    days = both.groupBy("instrument", "_day").agg(F.min("bar").alias("_first")).select("instrument", "_day", F.first("_first", ignorenulls=True).over(later).alias("_then"))
    found = both.withColumn("bar", F.first("bar", ignorenulls=True).over(ahead)).where("asked = 1").join(days, ["instrument", "_day"])
    return found.select("instrument", c("t").alias("at"), F.coalesce("bar", "_then").alias("snapped"))

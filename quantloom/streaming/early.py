"""Early signs of breakouts on streams: breakouts meet the bars of a lower timeframe before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

c = F.col


def early_signs_of_stream(events: DataFrame, lower: DataFrame, since: str, longest: str, late: str = "10 minutes", min_run: int = 1, penetration: float = 0.0, max_lead_minutes: float = 600) -> DataFrame:
    """The rows of `breakouts.early_signs` for a stream of events (instrument, range_id, direction, boundary_price, breakout_time, and the
    column `since` at which the range began) and one of lower bars (instrument, time, close), each once the watermark has passed
    its breakout.

    `longest` bounds how long before its breakout a range may have begun; a lower bar is dropped from the state that long after its
    time and `late`, and bars before that count for no range. An event's bars are gathered in its own state row, as many as the bound
    allows, and leave with it.
    """
    kind = events.schema["breakout_time"].dataType
    instant = lambda n: c(n).cast("timestamp")
    e = events.select(c("instrument").alias("_instrument"), "range_id", "direction", "boundary_price", instant("breakout_time").alias("breakout_time"), instant(since).alias("_since")).withWatermark("breakout_time", late)
    b = lower.select("instrument", instant("time").alias("low_time"), c("close").alias("low_close")).withWatermark("low_time", late)
    near = (c("instrument") == c("_instrument")) & (c("low_time") >= c("breakout_time") - F.expr(f"interval {longest}")) & (c("low_time") < c("breakout_time"))
    met = e.join(b, near & (c("low_time") >= c("_since")))
    beyond = F.when(c("direction") == "up", c("low_close") > c("boundary_price") + penetration).otherwise(c("low_close") < c("boundary_price") - penetration)
    bars = F.sort_array(F.collect_list(F.struct("low_time", "low_close", beyond.alias("beyond"))))
    made = met.groupBy("instrument", "range_id", "breakout_time").agg(bars.alias("bars"))
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("timestamp").alias("time"), F.lit(None).cast("double").alias("price"), F.lit(False).alias("found"))

    def step(s: Column, x: Column) -> Column:
        goes_on, begins = x["beyond"] & (s["n"] > 0), x["beyond"] & (s["n"] == 0)
        n = F.when(x["beyond"], s["n"] + 1).otherwise(0)
        own = F.struct(n.alias("n"), F.when(begins, x["low_time"]).when(goes_on, s["time"]).alias("time"), F.when(begins, x["low_close"]).when(goes_on, s["price"]).alias("price"), (n >= min_run).alias("found"))
        return F.when(s["found"], s).otherwise(own)

    told = made.withColumn("run", F.aggregate("bars", none, step)).where("run.found")
    lead = F.timestamp_diff("SECOND", c("run.time"), c("breakout_time")) / 60
    out = told.select("instrument", "range_id", c("breakout_time").cast(kind).alias("breakout_time"), c("run.time").cast(kind).alias("early_time"), c("run.price").alias("early_price"), lead.alias("lead_minutes"))
    return out.where(c("lead_minutes") <= max_lead_minutes)

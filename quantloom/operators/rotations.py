"""Rotations: runs of bars in one direction, from windows over blocks of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scans
from ..sources.tables import SERIES, placed

BEFORE = ("time", "close", "volume", "delta", "high", "low")


def directed(bars: DataFrame) -> DataFrame:
    """Bars with their direction and the number of their run of one direction (from 0; NULL before the first), and with some
    columns of the bar before.

    A bar goes up by a higher high, else down by a lower low, else as the bar before. Within a block the last direction known is
    filled forward and turns are counted; each block passes on its first and last direction and its turns.
    """
    w, block = scans.in_block(SERIES, "bar_index"), [*SERIES, "_block"]
    so_far, earlier = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    own = F.when(F.col("high") > F.lag("high").over(w), "up").when(F.col("low") < F.lag("low").over(w), "down")
    near = scans.blocks(placed(bars), SERIES, "bar_index", behind=1).withColumns({"_own": own, **{f"before_{n}": F.lag(n).over(w) for n in BEFORE}}).where("_home").drop("_home")
    filled = near.withColumns({"_filled": F.last("_own", ignorenulls=True).over(so_far), "_prior": F.last("_own", ignorenulls=True).over(earlier)})
    turned = filled.withColumn("_turn", F.coalesce((F.col("_filled") != F.col("_prior")).cast("long"), F.lit(0)))
    told = turned.groupBy(*block).agg(
        F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("bar_index"))).alias("_first"),
        F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("bar_index"))).alias("_last"),
        F.sum("_turn").alias("_turns"),
    )
    told = told.withColumn("_incoming", F.last("_last", ignorenulls=True).over(scans.earlier(SERIES)))
    told = told.withColumn("_begins", F.coalesce((F.col("_first") != F.coalesce("_incoming", F.lit(""))).cast("long"), F.lit(0)))
    told = told.select(*block, "_incoming", "_begins", scans.carried(F.col("_turns") + F.col("_begins"), SERIES).alias("_before"))
    number = F.col("_before") + F.sum("_turn").over(so_far) + F.when(F.col("_filled").isNotNull(), F.col("_begins")).otherwise(0) - 1
    out = turned.join(told, block).withColumns({"direction": F.coalesce("_filled", "_incoming"), "rotation_index": number})
    return out.withColumn("rotation_index", F.when(F.col("direction").isNotNull(), F.col("rotation_index"))).drop("_block", "_own", "_filled", "_prior", "_turn", "_incoming", "_begins", "_before")


def rotations(bars: DataFrame, min_amplitude: float = 0.0, min_bars: int = 0, whipsaw_bars: int = 0) -> DataFrame:
    """One row a rotation. A rotation's first bar is the one before its direction begins, which it shares with the rotation before.

    Two neighbours of at most whipsaw_bars bars each are both invalid, as are too small or too short rotations.
    """
    first = lambda n: F.min_by(n, "bar_index")
    made = directed(bars).where("direction is not null").groupBy(*SERIES, "rotation_index").agg(
        F.first("direction").alias("direction"),
        (F.min("bar_index") - 1).alias("start_index"),
        F.max("bar_index").alias("end_index"),
        first("before_time").alias("start_time"),
        F.max("time").alias("end_time"),
        first("before_close").alias("start_price"),
        F.max_by("close", "bar_index").alias("end_price"),
        (F.count(F.lit(1)) + 1).alias("bar_count"),
        (F.sum("volume") + first("before_volume")).alias("volume"),
        (F.sum("delta") + first("before_delta")).alias("delta"),
    )
    made = made.withColumn("amplitude", F.abs(F.col("end_price") - F.col("start_price")))
    n = F.col("bar_count")
    kind = F.when(n >= 5, "structural").when(n >= 3, "standard").when(n >= 2, "micro").otherwise("invalid")
    valid = (F.col("amplitude") >= min_amplitude) & (n >= min_bars)
    made = made.withColumn("rotation_type", kind)
    if whipsaw_bars < 2:  # a rotation has two bars at least
        return made.withColumn("valid", valid)
    w = scans.in_block(SERIES, "rotation_index")
    short = lambda other: F.coalesce(other <= whipsaw_bars, F.lit(False)) & (n <= whipsaw_bars)
    whipsaw = short(F.lag("bar_count").over(w)) | short(F.lead("bar_count").over(w))
    return scans.framed(made, SERIES, "rotation_index", [{"valid": valid & ~whipsaw}], 1, 1)

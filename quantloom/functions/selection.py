"""Exact quantiles of groups of any size, by distributed selection.

The built-in percentile holds a group's different values in one buffer. Here only groups with at most about LIMIT of these are left to
it. In others each rank that a quantile needs has a bracket, first from the group's least value to its greatest. A pass cuts brackets
into parts and counts the values of each, with partial counts before its shuffle, so a rank's part is known exactly and is its next
bracket; and again, until so few values are left that they are sorted. No task reads more than counts of parts, or a few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.stash import drop, stash

#: Different values of a group that one buffer may hold.
LIMIT = 1 << 18
#: Parts that a pass cuts a bracket into.
PARTS = 1000

c = F.col


def grouped(df: DataFrame, keys: Sequence[str], value: Column, quantiles: dict[str, float], more: Sequence[Column] = (), limit: int = LIMIT) -> DataFrame:
    """A row a group (one in all without keys): the aggregates `more`, and by name each quantile of the values that are not NULL,
    interpolated between its two neighbours; NULL without values. Missing keys are a group of their own.

    Groups' different values are counted first, by a sketch, so this runs a job; groups with more than `limit` of them are selected
    from in further ones. In others one buffer of values serves all quantiles.
    """
    rows = df.withColumns({"_key": F.struct(F.lit(0).alias("_"), *keys), "_v": value})
    by = [c("_key")[k].alias(k) for k in keys]
    counts = rows.groupBy("_key").agg(F.count("_v").alias("n"), F.approx_count_distinct("_v").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hot = stash(counts.where(c("_d") > limit).select("_key", "n", c("_lo").cast("double"), c("_hi").cast("double")))
    if hot.isEmpty():
        drop(hot)
        out = df.groupBy(*keys).agg(*more, F.percentile(value, list(quantiles.values())).alias("_few"))
        return out.withColumns({name: F.get("_few", F.lit(k)) for k, name in enumerate(quantiles)}).drop("_few")
    few = rows.join(hot.select("_key", F.lit(True).alias("_hot")), "_key", "left")
    own = few.groupBy("_key").agg(*more, F.percentile(F.when(c("_hot").isNull(), c("_v")), list(quantiles.values())).alias("_few"))
    found = selected(rows.select("_key", c("_v").cast("double")).where("_v is not null"), hot, quantiles, limit)
    out = own.join(found, "_key", "left")
    names = [n for n in own.columns if n not in ("_key", "_few")]
    return out.select(*by, *names, *(F.coalesce(c(name), F.get("_few", F.lit(k))).alias(name) for k, name in enumerate(quantiles)))


def octave(x: Column) -> Column:
    """A double's signed place among the octaves, never falling as doubles rise; zeros, infinities and NaN are more than one from others."""
    size = F.abs(x)
    return F.when(F.isnan(x), 2104.0).when(x == 0, 0.0).otherwise(F.signum(x) * F.when(size == float("inf"), 2102.0).otherwise(F.log2(size) + 1076))


def inside(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows in the ranks' brackets, ends included, a row once: the brackets of a group are the same or apart."""
    brackets = ranks.select(c("_key").alias("_k"), "_lo", "_hi").distinct()
    brackets = brackets.withColumns({"_from": octave(c("_lo")), "_wide": octave(c("_hi")) - octave(c("_lo"))})
    return rows.join(F.broadcast(brackets), (c("_key") == c("_k")) & c("_v").between(c("_lo"), c("_hi"))).drop("_k")


def selected(rows: DataFrame, groups: DataFrame, quantiles: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """(_key, a column a quantile) of the groups (_key, n, _lo, _hi: least and greatest value) over rows (_key, _v) of doubles.

    Brackets wider than an octave are cut by logarithms, others evenly; the lower end falls into part 0, the upper one into part PARTS.
    Two passes narrow all doubles to an octave and five an octave to one value, however the values lie.
    """
    at = lambda p: (c("n") - 1) * F.lit(float(p))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), (F.ceil(at(p)) if up else F.floor(at(p))).cast("long").alias("r"), at(p).alias("h")) for name, p in quantiles.items() for up in (False, True)])
    open_ = stash(groups.select("_key", c("n").alias("_n"), "_lo", "_hi", F.explode(ranks).alias("x")).select("_key", "x.*", "_n", "_lo", "_hi"))
    bracket, many, narrowed = ["_key", "_lo", "_hi"], (c("_n") > limit) & (c("_lo") < c("_hi")), []
    while True:
        narrowed.append(open_.where(~many))
        large = open_.where(many)
        if large.isEmpty():
            break
        share = F.when(c("_wide") > 1, (octave(c("_v")) - c("_from")) / c("_wide")).otherwise((c("_v") - c("_lo")) / (c("_hi") - c("_lo")))
        parts = inside(rows, large).groupBy(*bracket, F.floor(share * PARTS).alias("_part")).agg(F.count("_v").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        parts = parts.withColumn("_before", F.sum("_m").over(W.partitionBy(*bracket).orderBy("_part")) - c("_m"))
        own = large.join(parts, bracket).where((c("r") >= c("_before")) & (c("r") < c("_before") + c("_m")))
        open_ = stash(own.select("_key", "name", "up", (c("r") - c("_before")).alias("r"), "h", c("_m").alias("_n"), c("_a").alias("_lo"), c("_z").alias("_hi")))
    all_ = narrowed[0]
    for more in narrowed[1:]:
        all_ = all_.unionByName(more)
    few = all_.where("_lo < _hi")
    lists = inside(rows, few).groupBy(*bracket).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    sorted_ = stash(few.join(lists, bracket).select("_key", "name", "up", "h", F.get("_all", c("r").cast("int")).alias("answer")))
    all_ = all_.where("_lo = _hi").select("_key", "name", "up", "h", c("_lo").alias("answer")).unionByName(sorted_)
    ends = all_.groupBy("_key", "name", "h").agg(F.max(F.when(~c("up"), c("answer"))).alias("x"), F.max(F.when(c("up"), c("answer"))).alias("y"))
    low, high = F.floor("h"), F.ceil("h")
    made = F.when((low == high) | (c("x") == c("y")), c("x")).otherwise((high - c("h")) * c("x") + (c("h") - low) * c("y"))
    return ends.groupBy("_key").agg(*(F.max(F.when(c("name") == name, made)).alias(name) for name in quantiles))

"""Balances: clusters of rotations within a width, with the volume profile of their bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scans
from ..functions.scalars import clamp, saturating, true_range
from ..sources.stash import drop, stash
from ..sources.tables import SERIES, placed


def clustered(rotations: DataFrame, max_gap_bars: float = 3, max_width: float | None = None, min_rotations: int = 2, bar_seconds: float = 60) -> DataFrame:
    """Valid rotations with the cluster they belong to. A rotation starts a new one when it begins more than max_gap_bars bars
    after the last one's end or would make the cluster wider than max_width; clusters of too few rotations go.

    Where a cluster ends depends on where it began, so for every rotation the start of the next cluster is found, had one begun
    with it (`reached`); the chain of these jumps from a series' first rotation names the clusters (`chained`). No step holds a
    series in one task. The rotations are written on the way, so that neither they nor what follows is computed twice.
    """
    at = W.partitionBy(*SERIES, "_block").orderBy("_place")
    gap = F.timestamp_diff("MICROSECOND", F.lag("end_time").over(at), F.col("start_time")) / 1e6
    written = stash(rotations.where("valid"))
    valid = scans.numbered(written, SERIES, "rotation_index", "_place", F.floor(F.col("rotation_index") / scans.BLOCK))
    bounds = {"_cut": F.coalesce(gap > max_gap_bars * bar_seconds, F.lit(True)), "_low": F.least("start_price", "end_price"), "_high": F.greatest("start_price", "end_price")}
    jumps = reached(valid, bounds, float("inf") if max_width is None else max_width)
    drop(written)
    found = jumps.select(*rotations.columns, "_place").join(chained(jumps), [*SERIES, "_place"]).drop("_place")
    large = found.groupBy(*SERIES, "cluster").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rotations).drop("_n")
    return found.join(large, [*SERIES, "cluster"], "left_semi").select(*rotations.columns, "cluster")


#: Rotations that are looked ahead in a row; clusters that go on from there are followed by doubling.
REACH = 256


def looked_ahead(found: DataFrame, first: list[dict[str, Column]], behind: int) -> DataFrame:
    """Rotations with `_ahead`, the bounds of themselves and those after them."""
    frame = W.partitionBy(*SERIES, "_block").orderBy("_place").rowsBetween(0, REACH - 1)
    return scans.framed(found, SERIES, "_place", [*first, {"_ahead": F.collect_list(F.struct("_cut", "_low", "_high")).over(frame)}], behind, REACH - 1)


def fitting(ahead: str | Column, n: Column, low: Column, high: Column, width: float) -> Column:
    """How many rotations the cluster has with those of `ahead` that still fit, and its bounds then; open: all of them do."""
    begun = F.struct(n.cast("long").alias("n"), low.alias("low"), high.alias("high"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        low, high = F.least(s["low"], x["_low"]), F.greatest(s["high"], x["_high"])
        fits = s["open"] & ~x["_cut"] & (high - low <= width)
        return F.struct((s["n"] + fits.cast("long")).alias("n"), F.when(fits, low).otherwise(s["low"]).alias("low"), F.when(fits, high).otherwise(s["high"]).alias("high"), fits.alias("open"))

    return F.aggregate(ahead, begun, step)


def reached(found: DataFrame, bounds: dict[str, Column], width: float) -> DataFrame:
    """Rotations with `_jump`, the place of the first one that can't be in a cluster begun here, and `_cut`; written.

    A frame of REACH rotations tells most jumps. Where all of them fit, ranges of twice the length are made of two that fit, until
    none does; then each open rotation's range is extended by the ranges of falling length.
    """
    near = looked_ahead(found, [bounds], 1)
    run = fitting(F.slice("_ahead", 2, REACH - 1), F.lit(1), F.col("_low"), F.col("_high"), width)
    out = near.select(*(n for n in near.columns if n != "_ahead"), run.alias("_run"))
    out = stash(out.withColumn("_jump", F.col("_place") + F.col("_run.n")))
    whole = out.where((F.col("_run.n") == REACH) & (F.col("_run.high") - F.col("_run.low") <= width))
    if whole.isEmpty():
        return out
    level = lambda df, low, high: df.select(*SERIES, F.col("_place").alias("_from"), F.col("_cut").alias("_own_cut"), low.alias("_its_low"), high.alias("_its_high"))
    longer = [level(whole, F.col("_run.low"), F.col("_run.high"))]
    size = REACH
    while True:
        last = longer[-1]
        then = last.select(*SERIES, (F.col("_from") - size).alias("_from"), F.col("_own_cut").alias("_c"), F.col("_its_low").alias("_l"), F.col("_its_high").alias("_h"))
        low, high = F.least("_its_low", "_l"), F.greatest("_its_high", "_h")
        twice = stash(last.join(then, [*SERIES, "_from"]).where(~F.col("_c") & (high - low <= width)).select(*SERIES, "_from", "_own_cut", low.alias("_its_low"), high.alias("_its_high")))
        if twice.isEmpty():
            break
        longer.append(twice)
        size *= 2
    state = whole.select(*SERIES, "_place", F.col("_jump").alias("_from"), F.col("_run.low").alias("_l"), F.col("_run.high").alias("_h"))
    for k, ranges in reversed(list(enumerate(longer))):
        low, high = F.least("_l", "_its_low"), F.greatest("_h", "_its_high")
        fits = F.coalesce(~F.col("_own_cut") & (high - low <= width), F.lit(False))
        state = state.join(ranges, [*SERIES, "_from"], "left").select(*SERIES, "_place", (F.col("_from") + F.when(fits, REACH << k).otherwise(0)).alias("_from"), F.when(fits, low).otherwise(F.col("_l")).alias("_l"), F.when(fits, high).otherwise(F.col("_h")).alias("_h"))
    rest = looked_ahead(out.select(*SERIES, "_place", "_cut", "_low", "_high"), [], 0).select(*SERIES, F.col("_place").alias("_from"), "_ahead")
    state = state.join(rest, [*SERIES, "_from"], "left").select(*SERIES, "_place", (F.col("_from") + F.coalesce(fitting("_ahead", F.lit(0), F.col("_l"), F.col("_h"), width)["n"], F.lit(0))).alias("_from"))
    far = state.select(*SERIES, "_place", F.col("_from").alias("_far"))
    made = stash(out.join(far, [*SERIES, "_place"], "left").withColumn("_jump", F.coalesce("_far", "_jump")).drop("_far"))
    drop(out, *longer[1:], twice)
    return made


#: Rotations of a block whose chain is followed in one row.
CHAIN = 2048


def chained(jumps: DataFrame, size: int = CHAIN) -> DataFrame:
    """(place, cluster): clusters are numbered from 0 along the chain of jumps from each series' first place.

    A block of places is one row. From its end back it is told for each place where a chain through it leaves the block. The chain
    meets every cut, so a block with one passes on the same place wherever it was entered; only through runs of blocks
    without a cut the exits are doubled, as often as the logarithm of such a run. Then each block is walked from its entry.
    """
    block = [*SERIES, "_block"]
    row = F.struct("_place", "_jump", "_cut")
    packed = jumps.select(*SERIES, F.floor(F.col("_place") / size).alias("_block"), row.alias("r")).groupBy(*block).agg(F.sort_array(F.collect_list("r")).alias("_rows"))
    end = F.element_at("_rows", -1)["_place"]
    back = F.aggregate(F.reverse("_rows"), F.array().cast("array<long>"), lambda a, x: F.array_prepend(a, F.when(x["_jump"] > end, x["_jump"]).otherwise(F.get(a, (x["_jump"] - x["_place"] - 1).cast("int")))))
    cuts = F.transform("_rows", lambda x: x["_cut"].cast("int"))
    last_cut = F.size("_rows") - F.array_position(F.reverse(cuts), 1) + 1
    packed = stash(packed.withColumn("_exits", back).withColumn("_passed", F.when(F.array_contains(cuts, 1), F.element_at("_exits", last_cut.cast("int")))))
    entries = packed.select(*SERIES, F.col("_passed").alias("_place")).where("_place is not null").unionByName(packed.where("_block = 0").select(*SERIES, F.lit(0).cast("long").alias("_place")))
    used = []
    if not packed.where("_passed is null").isEmpty():
        exits = packed.where("_passed is null").select(*SERIES, F.explode(F.arrays_zip(F.col("_rows._place").alias("p"), "_exits")).alias("x")).select(*SERIES, F.col("x.p").alias("_place"), F.col("x._exits").alias("_to"))
        entries, exits = stash(entries), stash(exits)
        used = [entries, exits]
        while not exits.isEmpty():
            to = entries.join(exits, [*SERIES, "_place"]).select(*SERIES, F.col("_to").alias("_place"))
            then = exits.select(*SERIES, F.col("_place").alias("_to"), F.col("_to").alias("_then"))
            entries, exits = stash(entries.unionByName(to).distinct()), stash(exits.join(then, [*SERIES, "_to"]).select(*SERIES, "_place", F.col("_then").alias("_to")))
            drop(*used)
            used = [entries, exits]
    entered = entries.groupBy(*SERIES, F.floor(F.col("_place") / size).alias("_block")).agg(F.min("_place").alias("_entry"))
    begun = F.struct(F.coalesce("_entry", F.lit(-1)).cast("long").alias("next"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        starts = x["_place"] == s["next"]
        k = s["k"] + starts.cast("int")
        return F.struct(F.when(starts, x["_jump"]).otherwise(s["next"]).alias("next"), k.alias("k"), F.array_append(s["out"], k).alias("out"))

    walked = packed.join(entered, block, "left").withColumn("_walk", F.aggregate("_rows", begun, step)).select(*block, "_rows._place", F.col("_walk.k").alias("_starts"), F.col("_walk.out").alias("_out"))
    numbered = walked.withColumn("_base", scans.carried(F.col("_starts"), SERIES) - 1)
    told = numbered.select(*SERIES, "_base", F.explode(F.arrays_zip("_place", "_out")).alias("x"))
    return told.select(*SERIES, F.col("x._place").alias("_place"), (F.col("_base") + F.col("x._out")).cast("int").alias("cluster"))


def filtered(members: DataFrame, min_rotations: int | None = None, min_minutes: float | None = None, min_width: float | None = None, max_width: float | None = None) -> DataFrame:
    """The members of clusters with so many rotations, from the first one's start to the last one's end so many minutes, and so wide."""
    w = W.partitionBy(*SERIES, "cluster")
    width = F.max(F.greatest("start_price", "end_price")).over(w) - F.min(F.least("start_price", "end_price")).over(w)
    minutes = F.timestamp_diff("SECOND", F.min("start_time").over(w), F.max("end_time").over(w)) / 60
    tests = {"_count": (min_rotations, F.count(F.lit(1)).over(w), 1), "_minutes": (min_minutes, minutes, 1), "_least": (min_width, width, 1), "_most": (max_width, width, -1)}
    asked = {name: (limit, value, sign) for name, (limit, value, sign) in tests.items() if limit is not None}
    out = members.withColumns({name: value for name, (_, value, _) in asked.items()})
    for name, (limit, _, sign) in asked.items():
        out = out.where(F.col(name) * sign >= limit * sign)
    return out.drop(*asked)


KEYS = [*SERIES, "cluster"]


def inside(bars: DataFrame, members: DataFrame) -> DataFrame:
    """The bars of each cluster, from its first rotation's first bar to its last one's last; bars meet clusters by the blocks of
    their index range."""
    spans = members.groupBy(*KEYS).agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.count(F.lit(1)).alias("rotation_count"), F.count_if("valid").alias("valid_rotations"))
    return within(placed(bars), spans)


def of_bars() -> dict:
    """What a balance sums of its bars."""
    return {
        "start_time": F.min("time"),
        "end_time": F.max("time"),
        "high": F.max("high"),
        "low": F.min("low"),
        "bar_count": F.count(F.lit(1)),
        "volume": F.sum("volume"),
        "delta": F.sum("delta"),
        "rotation_count": F.first("rotation_count"),
        "valid_rotations": F.first("valid_rotations"),
    }


def _sized(made: DataFrame) -> DataFrame:
    made = made.withColumn("range_size", F.col("high") - F.col("low"))
    return made.withColumns({"midpoint": (F.col("high") + F.col("low")) / 2, "avg_candle_range": F.col("range_size") / F.col("bar_count"), "balance_id": F.concat_ws("_", F.lit("bal"), "instrument", "cluster")})


def balances(bars: DataFrame, members: DataFrame, min_bars: int = 1) -> DataFrame:
    """A row a cluster: its bars' range, sums and its rotations."""
    told = members.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("rotation_index", "direction", "rotation_type", "valid", "end_time", "delta", "volume"))).alias("rotations"))
    made = inside(bars, members).groupBy(*KEYS, "start_index", "end_index").agg(*(x.alias(n) for n, x in of_bars().items()))
    return _sized(made.where(F.col("bar_count") >= min_bars).join(told, KEYS))


BLOCK = 64


def within(bars: DataFrame, spans: DataFrame, first: str = "start_index", last: str = "end_index") -> DataFrame:
    """Bars joined to the spans of indexes they lie in, as an equi-join on blocks of indexes instead of a loop over ranges."""
    blocks = F.explode(F.sequence(F.floor(F.col(first) / BLOCK), F.floor(F.col(last) / BLOCK))).alias("_block")
    cut = spans.select(*SERIES, *[x for x in spans.columns if x not in SERIES], blocks)
    joined = bars.withColumn("_block", F.floor(F.col("bar_index") / BLOCK)).join(cut, [*SERIES, "_block"])
    return joined.where(F.col("bar_index").between(F.col(first), F.col(last))).drop("_block")


def profile(inside: DataFrame, keys: list[str], bin_size: float, high_factor: float = 1.5, low_factor: float = 0.5, around: float = 1.0) -> DataFrame:
    """Histogram of closes by volume for each group of bars: point of control, high and low volume levels, moments and shares.

    Bins start at the lowest close; the last one is closed to the right. Empty bins count in the mean.
    """
    w = W.partitionBy(*keys)
    bounds = inside.withColumns({"_min": F.min("close").over(w), "_max": F.max("close").over(w)})
    top = F.when(F.col("_max") == F.col("_min"), F.col("_min") + bin_size).otherwise(F.col("_max"))
    number = F.greatest(F.ceil((top - F.col("_min") + bin_size) / bin_size) - 1, F.lit(1))
    bins = bounds.withColumn("_bins", number.cast("int")).withColumn("_bin", F.least(F.floor((F.col("close") - F.col("_min")) / bin_size), F.col("_bins") - 1).cast("int"))
    sums = bins.groupBy(*keys, "_min", "_max", "_bins", "_bin").agg(F.sum("volume").alias("v"))
    dense = sums.groupBy(*keys, "_min", "_max", "_bins").agg(F.map_from_entries(F.collect_list(F.struct("_bin", "v"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_bins") - 1), lambda k: F.struct((F.col("_min") + (k + 0.5) * bin_size).alias("p"), F.coalesce(F.try_element_at("m", k), F.lit(0.0)).alias("v")))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    out = dense.withColumn("cells", cells).withColumn("total_volume", total(F.col("cells"), lambda x: x["v"])).withColumn("mean_volume", F.col("total_volume") / F.col("_bins"))
    out = out.withColumn("poc_volume", F.array_max(F.transform("cells", lambda x: x["v"]))).withColumn("poc_price", F.filter("cells", lambda x: x["v"] == F.col("poc_volume"))[0]["p"])
    levels = lambda keep: F.transform(F.filter("cells", keep), lambda x: x["p"])
    out = out.withColumns({"hvn": F.when(F.col("mean_volume") > 0, levels(lambda x: x["v"] > high_factor * F.col("mean_volume"))), "lvn": F.when(F.col("mean_volume") > 0, levels(lambda x: x["v"] < low_factor * F.col("mean_volume")))})
    out = out.withColumn("mean_price", F.try_divide(total(F.col("cells"), lambda x: x["p"] * x["v"]), F.col("total_volume")))
    moment = lambda k: F.try_divide(total(F.col("cells"), lambda x: F.pow(x["p"] - F.col("mean_price"), k) * x["v"]), F.col("total_volume"))
    none = F.lit(0.0)
    out = out.withColumn("_sd", F.sqrt(F.greatest(moment(2), F.lit(1e-9)))).withColumns({"skewness": F.coalesce(moment(3) / F.pow("_sd", 3), none), "kurtosis": F.coalesce(moment(4) / F.pow("_sd", 4), none)})
    volume = lambda keep: total(F.filter("cells", keep), lambda x: x["v"])
    share = lambda keep: F.coalesce(F.try_divide(volume(keep), F.col("total_volume")), none)
    closed = F.when(F.col("_max") == F.col("_min"), F.col("_min") + bin_size).otherwise(F.col("_max"))
    middle = (F.col("_min") + closed) / 2
    out = out.withColumns(
        {
            "concentration": share(lambda x: F.abs(x["p"] - F.col("poc_price")) <= around),
            "asymmetry": share(lambda x: x["p"] > middle) - share(lambda x: x["p"] <= middle),
            "density_around_mid": share(lambda x: F.abs(x["p"] - middle) <= around),
            "_above": volume(lambda x: x["p"] > middle),
            "_below": volume(lambda x: x["p"] <= middle),
            "volume_lower_boundary": F.col("cells")[0]["v"],
            "volume_upper_boundary": F.element_at("cells", -1)["v"],
            "profile_width": closed - F.col("_min"),
        }
    )
    upper = F.when(F.col("_below") > 0, F.try_divide("_above", "_below")).when(F.col("_above") > 0, float("inf")).otherwise(1.0)
    return out.withColumn("upper_vs_lower", upper).drop("_min", "_max", "_bins", "_sd", "m", "mean_price", "_above", "_below")


def volatility(inside: DataFrame, keys: list[str], window: int = 14, more: dict | None = None) -> DataFrame:
    """For each group of bars the mean of its last `window` true ranges, the deviation of its closes, that of its last
    `window` closes, how large the range is for the whole, and how stable that is; all 0 for a single bar. `more` are further
    aggregates by name."""
    before = F.lag("close").over(W.partitionBy(*keys).orderBy("time"))
    marked = inside.withColumns({"_tr": F.when(before.isNotNull(), true_range(F.col("high"), F.col("low"), before)), "_left": F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("time")))})
    last = F.col("_left") <= window
    out = marked.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(last, F.col("_tr"))), F.lit(0.0)).alias("internal_atr"),
        F.stddev_pop("close").alias("internal_volatility"),
        F.stddev_pop(F.when(last, F.col("close"))).alias("recent_volatility"),
        (F.max("high") - F.min("low")).alias("_range"),
        F.count(F.lit(1)).alias("_n"),
        *(x.alias(n) for n, x in (more or {}).items()),
    )
    ratio = F.when(F.col("_range") > 0, F.try_divide("internal_atr", "_range")).otherwise(0.0)
    several = F.col("_n") > 1
    return out.withColumn("compression_ratio", F.when(several, ratio).otherwise(0.0)).withColumn("stability_score", F.when(several, 1 / (1 + F.col("compression_ratio"))).otherwise(0.0)).drop("_range", "_n")


def detected(bars: DataFrame, members: DataFrame, bin_size: float, window: int = 14, **profiled: float) -> DataFrame:
    """Balances with their volume profile and volatility, a row each: what breakouts start from."""
    own = inside(bars, members)
    out = _sized(volatility(own, [*KEYS, "start_index", "end_index"], window, of_bars())).join(profile(own, KEYS, bin_size, **profiled), KEYS)
    return out.withColumns({"n_levels": F.size("cells"), "edge_share": (F.col("volume_upper_boundary") + F.col("volume_lower_boundary")) / F.greatest("total_volume", F.lit(1e-9))})


def kinds(found: DataFrame, compressed: float = 0.25, wide: float = 1.75, asymmetry: float = 0.25, center: float = 0.35, edge: float = 0.2) -> DataFrame:
    """Six flags: how the range's size stands to its profile's width (one of three), and where its volume lies."""
    ratio = F.col("range_size") / F.greatest("profile_width", F.lit(1e-9))
    return found.withColumns(
        {
            "is_compressed": ratio <= compressed,
            "is_wide": (ratio > compressed) & (ratio >= wide),
            "is_standard": (ratio > compressed) & (ratio < wide),
            "is_asymmetric": F.abs("asymmetry") >= asymmetry,
            "is_center_heavy": F.col("density_around_mid") >= center,
            "is_edge_heavy": F.col("edge_share") >= edge,
        }
    )


#: The six terms' weights and references.
EQUILIBRIUM = {"width": (0.2, 1.0), "asymmetry": (0.2, 0.5), "center": (0.25, 0.4), "hvn": (0.15, 0.25), "lvn": (0.1, 0.15), "edge": (0.1, 0.1)}


def equilibrium(found: DataFrame, terms: dict[str, tuple[float, float]] = EQUILIBRIUM) -> DataFrame:
    """How orderly a balance is, from 0 to 1: the weighted mean of six terms, each 1 at its reference."""
    near = lambda x, reference: F.greatest(1 - F.abs(x - reference) / max(reference, 1e-9), F.lit(0.0))
    level = lambda name: F.size(name) / F.greatest("n_levels", F.lit(1))
    share = {name: reference for name, (_, reference) in terms.items()}
    score = {
        "width": near(F.col("range_size") / F.greatest("profile_width", F.lit(1e-9)), share["width"]),
        "asymmetry": F.greatest(1 - F.abs("asymmetry") / max(share["asymmetry"], 1e-9), F.lit(0.0)),
        "center": saturating(F.col("density_around_mid"), max(share["center"], 1e-9)),
        "hvn": near(F.coalesce(level("hvn"), F.lit(0.0)), share["hvn"]),
        "lvn": near(F.coalesce(level("lvn"), F.lit(0.0)), share["lvn"]),
        "edge": F.when(F.col("edge_share") <= share["edge"], 1.0).otherwise(F.greatest(1 - (F.col("edge_share") - share["edge"]) / max(share["edge"], 1e-9), F.lit(0.0))),
    }
    whole = max(sum(w for w, _ in terms.values()), 1e-9)
    return found.withColumn("equilibrium_score", clamp(sum((score[n] * (w / whole) for n, (w, _) in terms.items()), F.lit(0.0))))


def before_breakout(found: DataFrame, pickup: float = 1.5, boundary: float = 0.5, distance: float = 0.1, bias: float = 1.2) -> DataFrame:
    """Four signs that a balance will break: closes that move more of late, thin edges, a low-volume level near an edge, and
    volume on one side; two of them make a candidate. `volatility` gives the recent closes' deviation."""
    near = lambda edge: F.exists("lvn", lambda p: F.abs(p - F.col(edge)) <= distance * F.col("range_size"))
    ratio, mean = F.col("upper_vs_lower"), F.col("total_volume") / F.greatest("n_levels", F.lit(1))
    out = found.withColumns(
        {
            "volatility_pickup": (F.col("internal_volatility") > 0) & (F.col("recent_volatility") > pickup * F.col("internal_volatility")),
            "boundary_volume_drop": (mean > 0) & (F.col("volume_upper_boundary") + F.col("volume_lower_boundary") < boundary * mean),
            "lvn_near_boundaries": F.coalesce(near("low") | near("high"), F.lit(False)),
            "directional_bias": F.when(ratio > bias, "up").when(ratio < 1 / bias, "down").otherwise("neutral"),
        }
    )
    signs = [F.col(n).cast("int") for n in ("volatility_pickup", "boundary_volume_drop", "lvn_near_boundaries")]
    return out.withColumn("is_pre_breakout", sum(signs, (F.col("directional_bias") != "neutral").cast("int")) >= 2)


def pre_breakout_score(found: DataFrame, weights: dict[str, float], max_lvn_distance: float = 0.5, min_volatility_increase: float = 1.0, min_delta_bias: float = 0.2, min_score: float = 0.5) -> DataFrame:
    """Four saturating scores (compression, lvn_proximity, volatility, delta_bias), their weighted sum, and whether it is enough."""
    to_lvn = F.array_min(F.transform("lvn", lambda p: F.abs(F.col("midpoint") - p)))
    at_most_one = lambda x: F.coalesce(F.least(x, F.lit(1.0)), F.lit(0.0))
    out = found.withColumns(
        {
            "compression_score": at_most_one(F.col("compression_ratio")),
            "lvn_proximity_score": F.coalesce(1 - F.least(F.try_divide(to_lvn, F.col("range_size")) / max_lvn_distance, F.lit(1.0)), F.lit(0.0)),
            "volatility_score": at_most_one(F.try_divide("internal_volatility", "avg_candle_range") / min_volatility_increase),
            "delta_bias_score": at_most_one(F.try_divide(F.abs("delta"), "total_volume") / min_delta_bias),
        }
    )
    whole = sum((F.col(f"{n}_score") * w for n, w in weights.items()), F.lit(0.0))
    return out.withColumn("pre_total_score", whole).withColumn("is_candidate", F.col("pre_total_score") >= min_score)

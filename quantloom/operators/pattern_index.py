"""An index of bar windows for exact retrieval: leaves of similar windows, bounds of their distance, refinement in bound order.

Each channel of a window is cut into a few parts of its bars; the parts' means are its short form. Means are coded by quarters of all
windows, the codes of the means that vary most come first, and a leaf is the shortest beginning of this word that at most
`leaf` windows share. A leaf knows the least and the largest of each mean. Cauchy's inequality bounds the distance of two windows by
that of their means from below, and so the score from above: for a window by its own means, for a leaf by its box.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import channel_similarity, rms_distance
from ..sources.stash import stash
from ..sources.tables import SERIES

#: Values that a bar adds to each channel.
WIDTH = {"price": 4, "volume": 1, "delta": 1}
#: Symbols of a word that may name a leaf, from the first two on.
STEP = 2

c = F.col


class Index(NamedTuple):
    """windows: all windows with their means and leaf, in the leaf's order. leaves: one row each, its number of windows and box."""

    windows: DataFrame
    leaves: DataFrame
    length: int
    parts: int

    def write(self, path: str) -> None:
        self.windows.write.mode("overwrite").parquet(f"{path}/windows")
        self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")


def read(spark: SparkSession, path: str, length: int, parts: int) -> Index:
    return Index(spark.read.parquet(f"{path}/windows"), spark.read.parquet(f"{path}/leaves"), length, parts)


def groups(length: int, parts: int) -> dict[str, list[list[int]]]:
    """For each channel the positions in its vector that share a mean: one value of consecutive bars."""
    cuts = [length * k // parts for k in range(parts + 1)]
    return {n: [[w * bar + v for bar in range(a, z)] for v in range(w) for a, z in zip(cuts, cuts[1:]) if a < z] for n, w in WIDTH.items()}


def _means(length: int, parts: int) -> list[Column]:
    return [sum((F.get(n, F.lit(i)) for i in g), F.lit(0.0)) / len(g) for n, of in groups(length, parts).items() for g in of]


def build(windows: DataFrame, length: int, parts: int = 2, leaf: int = 256) -> Index:
    """The index of `patterns.windows` of that many bars. Windows with the same word stay one leaf, however many they are."""
    short = stash(windows.withColumn("means", F.array(*_means(length, parts))))
    dims = sum(len(of) for of in groups(length, parts).values())
    mean = lambda k: F.get("means", F.lit(k))
    told = short.agg(*(F.stddev_pop(mean(k)).alias(f"s{k}") for k in range(dims)), *(F.percentile_approx(mean(k), [0.25, 0.5, 0.75]).alias(f"q{k}") for k in range(dims))).first()
    order = sorted(range(dims), key=lambda k: -(told[f"s{k}"] or 0.0))
    code = lambda k: sum(((mean(k) > float(q)).cast("int") for q in told[f"q{k}"] or ()), F.lit(0)).cast("string")
    coded = short.withColumn("word", F.concat(*(code(k) for k in order)))
    lengths = list(range(STEP, dims, STEP)) + [dims]
    prefix = F.explode(F.array(*(F.substring("word", 1, n) for n in lengths))).alias("leaf")
    small = coded.select(prefix).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where((c("n") <= leaf) | (F.length("leaf") == dims))
    fits = coded.select("word").distinct().withColumn("leaf", F.explode(F.array(*(F.substring("word", 1, n) for n in lengths)))).join(small, "leaf")
    named = fits.groupBy("word").agg(F.min_by("leaf", F.length("leaf")).alias("leaf"))
    placed = stash(coded.join(named, "word").drop("word").repartitionByRange("leaf").sortWithinPartitions("leaf"))
    box = [x for k in range(dims) for x in (F.min(mean(k)).alias(f"a{k}"), F.max(mean(k)).alias(f"z{k}"))]
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *box)
    leaves = boxes.select("leaf", "n", F.array(*(f"a{k}" for k in range(dims))).alias("least"), F.array(*(f"z{k}" for k in range(dims))).alias("most"))
    return Index(placed, stash(leaves), length, parts)


def _bound(index: Index, wanted: dict[str, list[float]], weights: dict[str, float], caps: dict[str, float], least: str, most: str) -> Column:
    """The score that nothing between these means can exceed."""
    distances, at = [], 0
    for name, of in groups(index.length, index.parts).items():
        squares = F.lit(0.0)
        for k, g in enumerate(of, at):
            if name in wanted:
                own = sum(float(wanted[name][i]) for i in g) / len(g)
                gap = F.greatest(F.get(least, F.lit(k)) - own, own - F.get(most, F.lit(k)), F.lit(0.0))
                squares += gap * gap * len(g)
        at += len(of)
        if name in wanted:
            distances.append((F.sqrt(squares / len(wanted[name])), weights.get(name, 0.0), caps.get(name, 1.0)))
    return channel_similarity(distances)


#: Rounding may lift a score over its bound by less than this.
SLACK = 1e-9


def search(index: Index, wanted: dict[str, list[float]], weights: dict[str, float], caps: dict[str, float], n: int = 10, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The n windows most similar to the wanted channels by Euclidean distance, of at least the tolerance, as `patterns.top` of all
    would give them; and how much was looked at: windows, refined, share.

    The leaves of the highest bounds, until they hold n windows, are refined first. Their n-th score is a floor: leaves and then windows whose bound is below
    it hold no match, all others are refined.
    """
    score = channel_similarity([(rms_distance(c(k), F.array(*(F.lit(float(x)) for x in v))), weights.get(k, 0.0), caps.get(k, 1.0)) for k, v in wanted.items()])
    leaves = index.leaves.withColumn("bound", _bound(index, wanted, weights, caps, "least", "most"))
    ahead = leaves.orderBy(F.desc("bound"), "leaf").limit(n).select("leaf", "n").collect()
    first = [r["leaf"] for k, r in enumerate(ahead) if sum(x["n"] for x in ahead[:k]) < n]
    begun = index.windows.where(c("leaf").isin(first)).withColumn("score", score)
    best = [r["score"] for r in begun.orderBy(F.desc("score")).limit(n).select("score").collect()]
    floor = max(tolerance, best[-1] if len(best) == n else 0.0) - SLACK
    open_ = leaves.where((c("bound") >= floor) & ~c("leaf").isin(first)).select("leaf")
    rest = index.windows.join(open_, "leaf", "left_semi").where(_bound(index, wanted, weights, caps, "means", "means") >= floor).withColumn("score", score)
    refined = begun.unionByName(rest)
    found = refined.where(c("score") >= tolerance).select(*SERIES, "start_index", "start_time", "end_index", "end_time", "score")
    windows = index.leaves.agg(F.sum("n")).first()[0] or 0
    looked = refined.agg(F.count(F.lit(1)).alias("refined")).select(F.lit(windows).cast("long").alias("windows"), "refined", (c("refined") / max(windows, 1)).alias("share"))
    return found.orderBy(F.desc("score"), "start_time", *SERIES).limit(n), looked

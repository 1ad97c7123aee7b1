"""Findings from a grouped result (keys as text in `value`, `result`, `rows_valid`), judged, pruned and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

c = F.col

#: How much each type counts and which goes first among equals.
TYPES = {"dominant_segment": (1.0, 100), "imbalanced_distribution": (0.88, 90), "top_performer": (0.82, 80), "bottom_performer": (0.82, 70), "top_gap": (0.95, 60), "range_gap": (0.9, 50), "probability": (0.8, 40), "distribution": (0.76, 30), "scalar": (0.72, 20)}
SHARES = ("dominant_segment", "imbalanced_distribution", "probability", "distribution")
CLASSES = {"A": 1.0, "B": 0.85, "C": 0.7, "D": 0.0}
MOST = 7


def extracted(grouped: DataFrame, metric: str) -> DataFrame:
    """(type, value, metric_value, rows_valid): every row, the best and worst, the gaps, and a dominant share."""
    base_type = "distribution" if metric == "distribution" else "scalar"
    rows = grouped.where("result is not null").select("value", c("result").cast("double").alias("result"), "rows_valid")
    every = W.partitionBy()
    down, up = W.orderBy(F.desc("result"), "value"), W.orderBy("result", "value")
    ranked = rows.withColumns({"_n": F.count(F.lit(1)).over(every), "_top": F.row_number().over(down), "_low": F.row_number().over(up), "_second": F.lead("result").over(down), "_second_n": F.lead("rows_valid").over(down), "_max": F.max("result").over(every), "_min": F.min("result").over(every), "_sum": F.sum("result").over(every), "_valid": F.sum("rows_valid").over(every)})
    share = c("_max") / F.when(c("_sum") > 0, c("_sum"))
    row = lambda kind, value, metric_value, n: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), value.alias("value"), metric_value.alias("metric_value"), n.alias("rows_valid"))
    none = F.lit(None).cast("string")
    top, several = c("_top") == 1, c("_n") >= 2
    made = [
        row(base_type, c("value"), c("result"), c("rows_valid")),
        F.when(several & top, row("top_performer", c("value"), c("result"), c("rows_valid"))),
        F.when(several & (c("_low") == 1), row("bottom_performer", c("value"), c("result"), c("rows_valid"))),
        F.when(several & top, row("range_gap", none, c("_max") - c("_min"), c("_valid"))),
        F.when(several & top, row("top_gap", none, c("result") - c("_second"), F.least("rows_valid", "_second_n"))),
    ]
    if metric in ("distribution", "success_rate", "true_breakout_rate", "non_failed_rate"):
        made.append(F.when(several & top & (share >= 0.45), row(F.when(share >= 0.6, "dominant_segment").otherwise("imbalanced_distribution"), c("value"), share, c("rows_valid"))))
    return ranked.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("i")).select("i.*")


def judged(found: DataFrame) -> DataFrame:
    """Class A to D: D without rows, C for few rows or a weak signal, A for a strong one on eight rows at least."""
    v, kind = F.abs("metric_value"), c("type")
    weak = F.when(kind.isin("top_gap", "range_gap"), v <= 1e-9).when(kind.isin("dominant_segment", "imbalanced_distribution", "probability"), v < 0.15).otherwise(v <= 0)
    least = F.when(kind == "dominant_segment", 0.6).when(kind == "imbalanced_distribution", 0.45).when(kind == "probability", 0.7)
    strong = (c("rows_valid") >= 8) & F.when(least.isNotNull(), v >= least).otherwise(v > 0)
    cls = F.when(c("rows_valid").isNull() | (c("rows_valid") <= 0) | c("metric_value").isNull(), "D").when((c("rows_valid") < 5) | weak, "C").when(strong, "A").otherwise("B")
    return found.withColumn("class", cls)


def refined(found: DataFrame) -> DataFrame:
    """Without what a stronger type already says of the same value, class D, and gaps that are none."""
    over = {"scalar": ("top_performer", "bottom_performer"), "top_performer": ("dominant_segment",), "bottom_performer": ("imbalanced_distribution",)}
    said = reduce(DataFrame.unionByName, [found.where(c("type").isin(*by)).select(c("value").alias("_v"), F.lit(t).alias("_t")) for t, by in over.items()]).distinct()
    winners = found.where(c("type").isin("top_performer", "bottom_performer", "dominant_segment", "imbalanced_distribution")).limit(1).select(F.lit(True).alias("_won"))
    left = found.join(said, c("value").eqNullSafe(c("_v")) & (c("type") == c("_t")), "left_anti")
    left = left.join(winners, c("type") == "distribution", "left_anti")
    return left.where((c("class") != "D") & ~(c("type").isin("top_gap", "range_gap") & (c("metric_value") <= 0)))


def scored(found: DataFrame) -> DataFrame:
    """The most telling findings, at most seven: signal by support, class and type; a long tail is cut at 35 % of the best."""
    v = F.abs("metric_value")
    lookup = lambda values, key: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]
    signal = F.when(c("type").isin(*SHARES), F.least(v, F.lit(1.0))).otherwise(v / (1 + v))
    factor, priority = lookup({k: a for k, (a, _) in TYPES.items()}, c("type")), lookup({k: b for k, (_, b) in TYPES.items()}, c("type"))
    out = found.withColumn("severity", signal * c("rows_valid") / (c("rows_valid") + 10) * lookup(CLASSES, c("class")) * factor).where("severity > 0")
    every = W.partitionBy()
    out = out.withColumns({"_n": F.count(F.lit(1)).over(every), "_best": F.max("severity").over(every)}).where((c("_n") <= MOST) | (c("severity") >= 0.35 * c("_best")))
    return out.orderBy(F.desc("severity"), F.desc(priority), F.desc(v), "type", "value").drop("_n", "_best").limit(MOST)

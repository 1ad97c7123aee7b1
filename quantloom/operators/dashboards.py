"""Summaries for dashboards."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import end_of_day

c = F.col

#: Target columns by kind, and the columns a preview shows first.
TARGETS = {"clean_quant": r"is_clean_quant", "clean_tick": r"t\d+_clean_\d+ticks", "atr_scan": r"t\d+_\d+_\d+ATR", "tick_scan": r"t\d+_\d+ticks", "direct": r"t\d+"}
PREVIEW = "breakout_id breakout_time direction breakout_price breakout_outcome instrument side atr_before initial_delta delta_bucket initial_volume max_excursion retracement_depth session_calc weekday hour".split()


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows by value ('unknown' where missing), with their percentage of all."""
    n = df.groupBy(F.coalesce(c(key).cast("string"), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100 * c("n") / F.sum("n").over(W.partitionBy()))


def shares_within(df: DataFrame, parent: str, child: str) -> DataFrame:
    n = df.groupBy(F.coalesce(c(parent).cast("string"), F.lit("unknown")).alias("parent"), F.coalesce(c(child).cast("string"), F.lit("unknown")).alias("child")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100 * c("n") / F.sum("n").over(W.partitionBy("parent")))


def surface(df: DataFrame, row: str, column: str, success: str, value: str) -> DataFrame:
    """For each pair of keys the number of rows, the rate of success and the mean value."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"), F.avg(c(success).cast("double")).alias("win_rate"), F.avg(value).alias("mean_value"))


def outcome_stack(df: DataFrame, key: str, outcome: str, values: list[str]) -> DataFrame:
    """Outcome counts side by side for each key."""
    return df.groupBy(key).pivot(outcome, values).agg(F.count(F.lit(1))).na.fill(0, values)


def summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many different values each field has."""
    return df.agg(*(F.count_distinct(k).alias(k) for k in keys))


def mode(df: DataFrame, key: str, order: str) -> DataFrame:
    """The most common value; of equals the one seen first in `order`."""
    n = df.where(c(key).isNotNull() & (F.trim(c(key).cast("string")) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return n.agg(F.min_by(key, F.struct(-c("n"), c("_first"))).alias("mode"), F.max("n").alias("n"))


def delta_sign(df: DataFrame, delta: str) -> DataFrame:
    d = c(delta)
    return df.withColumn("delta_sign", F.when(d > 0, "positive").when(d < 0, "negative").when(d == 0, "neutral").otherwise("unknown"))


def highlights(df: DataFrame, value: str) -> DataFrame:
    """Rows with the largest and the smallest value."""
    every = W.partitionBy()
    return df.withColumns({"is_top": c(value) == F.max(value).over(every), "is_bottom": c(value) == F.min(value).over(every)})


def fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Value counts of several fields in one aggregation, as percentages of those present; only fields with several values."""
    pairs = ", ".join(f"'{n}', cast({n} as string)" for n in names)
    long = df.selectExpr(f"stack({len(names)}, {pairs}) as (field, value)").where("value is not null")
    n = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("field")
    return n.withColumns({"pct": 100 * c("n") / F.sum("n").over(w), "_k": F.count(F.lit(1)).over(w)}).where("_k > 1").drop("_k")


def page(df: DataFrame, order: list, number: int, size: int = 50) -> DataFrame:
    """One page of rows in an order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def target_columns(columns: list[str]) -> dict[str, list[str]]:
    """The target columns among these, by kind."""
    return {kind: [n for n in columns if re.fullmatch(pattern, n)] for kind, pattern in TARGETS.items()}


def said_true(name: str) -> Column:
    """Whether a label is true, "true" or 1; NULL where it is missing."""
    return F.lower(c(name).cast("string")).isin("true", "1")


def rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each target its rate in percent over all rows, where a missing label is a failure, and over the rows that have one."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *(x for k, n in enumerate(columns) for x in (F.count_if(said_true(n)).alias(f"_t{k}"), F.count(n).alias(f"_v{k}"))))
    long = counted.selectExpr("_n", f"stack({len(columns)}, {', '.join(f"'{n}', _t{k}, _v{k}" for k, n in enumerate(columns))}) as (target, successes, labelled)")
    return long.select("target", "successes", "labelled", F.coalesce(F.try_divide(100 * c("successes"), c("_n")), F.lit(0.0)).alias("rate_of_all"), F.try_divide(100 * c("successes"), c("labelled")).alias("rate_of_labelled"))


def event_counts(df: DataFrame) -> DataFrame:
    """Events in all, failed ones, others, and by direction."""
    failed = F.coalesce(c("is_failed"), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), F.count_if(~failed).alias("successful"), F.count_if(c("direction") == "up").alias("up"), F.count_if(c("direction") == "down").alias("down"))


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def similarity_stats(matches: DataFrame, score: str = "score") -> DataFrame:
    """Number, mean, least and largest score; all 0 without matches."""
    zero = F.lit(0.0)
    return matches.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(score), zero).alias("mean"), F.coalesce(F.min(score), zero).alias("least"), F.coalesce(F.max(score), zero).alias("most"))


def match_filters(matches: DataFrame, first: str | None = None, last: str | None = None, from_clock: str | None = None, to_clock: str | None = None, least: float | None = None, time: str = "start_time", score: str = "score") -> DataFrame:
    """Matches that start from a date to the end of another, between two times of the day (HH:MM), and score enough."""
    clock = F.date_format(time, "HH:mm")
    tests = [
        first and c(time) >= F.lit(dt.datetime.fromisoformat(first)),
        last and c(time) <= F.lit(end_of_day(last)),
        from_clock and clock >= from_clock,
        to_clock and clock <= to_clock,
        least and c(score) >= least,
    ]
    for test in tests:
        if test is not None and not isinstance(test, (str, float, int)):
            matches = matches.where(test)
    return matches


def preview(df: DataFrame, rows: int = 100, columns: int = 15) -> DataFrame:
    """The first rows with the columns that matter most, then others that are not nested."""
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    shown = [n for n in PREVIEW if n in df.columns]
    return df.select(*[*shown, *(n for n in plain if n not in shown)][:columns]).limit(rows)


def report_summary(grouped: DataFrame, metric: str) -> DataFrame:
    """Rows and valid rows of all groups; a ranking has no valid rows of its own."""
    valid = F.lit(None).cast("long") if metric == "ranking" else F.sum("rows_valid")
    return grouped.agg(F.coalesce(F.sum("rows_total"), F.lit(0)).alias("rows_total"), valid.alias("rows_valid"))


def report_rows(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of their keys' text, fields by name."""
    return grouped.orderBy(F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.coalesce(c(k).cast("string"), F.lit("None"))) for k in sorted(keys))))

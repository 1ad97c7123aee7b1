"""The query metrics, each as aggregate columns over the rows of a group."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions import selection
from ..functions.scalars import python_text
from .predicates import all_of, predicate

RATES = ("success_rate", "true_breakout_rate", "non_failed_rate")
VALUES = ("mean", "median", "std")
SCORES = ("count", *VALUES, *RATES)


def _numeric(df: DataFrame, field: str | None) -> Column:
    if field is None or field not in df.columns:
        raise ValueError(f"no column {field!r}")
    if not isinstance(df.schema[field].dataType, (NumericType, BooleanType)):
        raise ValueError(f"{field} is not numeric")
    return F.col(field).cast("int").cast("double") if isinstance(df.schema[field].dataType, BooleanType) else F.col(field).cast("double")


def aggregates(df: DataFrame, spec: dict[str, Any]) -> list[Column]:
    """rows_total, rows_valid and result (and counts of a probability) for a metric; a median's result is no aggregate."""
    metric = spec["metric"]
    total = F.count(F.lit(1)).alias("rows_total")
    if metric == "count":
        n = F.count(spec["value_field"] if spec.get("value_field") else F.lit(1))
        return [total, n.alias("rows_valid"), n.alias("result")]
    if metric in VALUES:
        v = _numeric(df, spec.get("value_field"))
        if metric == "median":  # of groups of any size: see `grouped`
            return [total, F.count(v).alias("rows_valid")]
        made = {"mean": F.avg, "std": F.stddev_pop}[metric](v)
        return [total, F.count(v).alias("rows_valid"), made.alias("result")]
    if metric in RATES:
        field, condition = spec["target_field"], spec["success_condition"]
        hit = predicate(df, field, condition["operator"], condition.get("value"))
        return [total, F.count(field).alias("rows_valid"), F.avg(F.when(F.col(field).isNotNull(), hit.cast("double"))).alias("result")]
    if metric == "probability":
        event, condition = spec["event_predicate"], spec["condition_predicate"]
        e, c = (predicate(df, p["field"], p["operator"], p.get("value")) for p in (event, condition))
        among, both = F.count_if(c & F.col(event["field"]).isNotNull()), F.count_if(c & e)
        return [total, F.count(condition["field"]).alias("rows_valid"), among.alias("condition_count"), both.alias("event_and_condition_count"), F.try_divide(both, among).alias("result")]
    raise ValueError(f"no metric {metric!r}")


def grouped(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Filter, then one row a group (one row in all without keys); missing keys are a group of their own."""
    df, keys = all_of(df, spec.get("filters") or []), spec.get("group_by") or []
    if spec["metric"] == "median":
        return selection.grouped(df, keys, _numeric(df, spec.get("value_field")), {"result": 0.5}, aggregates(df, spec))
    return df.groupBy(*keys).agg(*aggregates(df, spec))


def distribution(df: DataFrame, field: str, group_by: list[str] = [], share: bool = False, filters: list[dict] = []) -> DataFrame:  # noqa: B006
    """How often each value of a field occurs in a group, as rows (keys, value, n), or with its share of the valid rows."""
    df = all_of(df, filters)
    counts = df.where(F.col(field).isNotNull()).groupBy(*group_by, python_text(df, field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if not share:
        return counts
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*[F.col(k) for k in group_by] or [F.lit(0)])))


def ranking(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Groups of one key by a score: rank, key, rows_total, result. Groups without a score go; ties go by the key's text."""
    (key,) = spec["group_by"]
    if spec["score_metric"] not in SCORES:
        raise ValueError(f"{spec['score_metric']} is no score")
    scored = grouped(df, {**spec, "metric": spec["score_metric"]}).where("result is not null")
    text = F.concat(F.lit(f"{key}="), python_text(scored, key))
    by = F.col("result").asc() if spec.get("sort_direction") == "asc" else F.col("result").desc()
    return scored.select(F.row_number().over(W.orderBy(by, text)).alias("rank"), key, "rows_total", "result")

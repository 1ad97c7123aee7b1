"""From a declarative query to a DataFrame: checks first, then one lazy plan."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions import selection
from ..operators import metrics
from ..operators.predicates import all_of, predicate

#: What each metric needs.
NEEDS = {
    "count": (),
    "mean": ("value_field",),
    "median": ("value_field",),
    "std": ("value_field",),
    "success_rate": ("target_field", "success_condition"),
    "true_breakout_rate": ("target_field", "success_condition"),
    "non_failed_rate": ("target_field", "success_condition"),
    "probability": ("event_predicate", "condition_predicate"),
    "distribution": ("value_field",),
    "ranking": ("group_by", "score_metric"),
}
ALIASES = {"session": "session_calc", "time": "time_bucket", "outcome": "breakout_outcome"}


def normalised(spec: dict[str, Any]) -> dict[str, Any]:
    """Field aliases resolved and '=' read as '=='."""

    def field(name: Any) -> Any:
        return ALIASES.get(name, name)

    def condition(p: dict) -> dict:
        return {**p, **({"field": field(p["field"])} if "field" in p else {}), "operator": "==" if p["operator"] == "=" else p["operator"]}

    out = dict(spec)
    for k in ("value_field", "target_field"):
        if k in out:
            out[k] = field(out[k])
    for k in ("success_condition", "event_predicate", "condition_predicate"):
        if k in out:
            out[k] = condition(out[k])
    out["filters"] = [condition(p) for p in spec.get("filters") or []]
    out["group_by"] = [field(k) for k in spec.get("group_by") or []]
    return out


def checked(df: DataFrame, spec: dict[str, Any]) -> dict[str, Any]:
    """The normalised spec, or an error that says what is wrong with it."""
    spec = normalised(spec)
    metric = spec.get("metric")
    if metric not in NEEDS:
        raise ValueError(f"no metric {metric!r}")
    absent = [k for k in NEEDS[metric] if not spec.get(k)]
    if absent:
        raise ValueError(f"{metric} needs {', '.join(absent)}")
    if metric == "ranking":
        if len(spec["group_by"]) != 1:
            raise ValueError("ranking needs exactly one key")
        checked(df, {**spec, "metric": spec["score_metric"]})
    missing = [k for k in [*spec["group_by"], spec.get("value_field"), spec.get("target_field")] if k and k not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    for p in [*spec["filters"], *(spec[k] for k in ("event_predicate", "condition_predicate") if k in spec)]:
        predicate(df, p["field"], p["operator"], p.get("value"))
    return spec


def run(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    spec = checked(df, spec)
    if spec["metric"] == "ranking":
        return metrics.ranking(df, spec)
    if spec["metric"] == "distribution":
        return metrics.distribution(df, spec["value_field"], spec["group_by"], spec.get("normalization") == "share_of_valid_rows", spec["filters"])
    return metrics.grouped(df, spec)


def study(df: DataFrame, keys: list[str], metric: str, column: str, name: str, filters: list[dict] = [], quantile: float = 0.5) -> DataFrame:  # noqa: B006
    """A calendar study: rows by key with their number n and a mean, a probability of 1, a deviation or a quantile."""
    v = F.col(column).cast("double")
    rows, n = all_of(df, filters), F.count(F.lit(1)).alias("n")
    if metric == "quantile":
        return selection.grouped(rows, keys, v, {name: quantile}, [n])
    made = {"mean": F.avg(v), "prob": F.avg((v == 1).cast("double")), "std": F.stddev_pop(v)}[metric]
    return rows.groupBy(*keys).agg(n, made.alias(name))

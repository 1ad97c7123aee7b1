"""The twelve calendar studies over events with calendar columns, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.predicates import all_of
from .spec import study

FIRST_MONDAY = [{"field": "weekday", "operator": "==", "value": "Monday"}, {"field": "day_of_month", "operator": "<=", "value": 7}]
#: Keys, filters, what is measured, and the order ("metric" or "keys").
STUDIES = {
    "cal01": (["weekday"], [], "atr", "metric"),
    "cal02": (["month"], [], "atr", "metric"),
    "cal03": (["month"], FIRST_MONDAY, "atr", "keys"),
    "cal04": (["weekday"], [], "success", "metric"),
    "cal05": (["weekday", "session_name"], [], "success", "keys"),
    "cal06": (["week_of_month"], [], "atr", "keys"),
    "cal07": (["month"], [], "success", "metric"),
    "cal08": (["day_of_month"], [], "success", "metric"),
    "cal09": (["week_of_month"], [], "success", "metric"),
    "cal10": (["hour"], [], "success", "metric"),
    "cal11": (["day_of_month"], [], "atr", "metric"),
    "cal12": (["hour"], [], "atr", "metric"),
}
MEASURES = {"atr": ("mean", "atr_before", "avg_atr_before_pts"), "success": ("prob", "success_1atr", "p_success_1atr")}


def enriched(df: DataFrame, k: float = 1.0) -> DataFrame:
    """Events with the calendar columns of their time, the clock session, and whether the excursion reached k ranges."""
    t = F.col("breakout_time")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return df.select(
        "*",
        F.date_format(t, "EEEE").alias("weekday"),
        F.month(t).alias("month"),
        F.dayofmonth(t).alias("day_of_month"),
        (F.floor((F.dayofmonth(t) - 1) / 7) + 1).cast("int").alias("week_of_month"),
        F.hour(t).alias("hour"),
        clock_session(seconds).alias("session_name"),
        F.coalesce(F.col("max_excursion") >= k * F.col("atr_before"), F.lit(False)).cast("int").alias("success_1atr"),
    )


def clock_session(seconds):
    """usa from 15:30 to 22:00, else europe from 9:00 to 17:30, else asia from 1:00 to 10:00, else off."""
    at = lambda h, m=0: h * 3600 + m * 60
    return F.when((seconds >= at(15, 30)) & (seconds < at(22)), "usa").when((seconds >= at(9)) & (seconds < at(17, 30)), "europe").when((seconds >= at(1)) & (seconds < at(10)), "asia").otherwise("off")


def calendar(df: DataFrame, name: str) -> DataFrame:
    keys, filters, measure, order = STUDIES[name]
    metric, column, out = MEASURES[measure]
    found = study(df, keys, metric, column, out, filters)
    return found.orderBy(*([F.desc(out), *keys] if order == "metric" else keys))


def best_and_worst(df: DataFrame, key: str, measure: str) -> DataFrame:
    """The key's values with the largest and the smallest measure; the smaller value wins a tie."""
    metric, column, out = MEASURES[measure]
    found = study(df, [key], metric, column, out)
    return found.agg(F.min_by(key, F.struct(-F.col(out), F.col(key))).alias("best"), F.max(out).alias("best_value"), F.min_by(key, F.struct(F.col(out), F.col(key))).alias("worst"), F.min(out).alias("worst_value"))


def compare(df: DataFrame, key: str, a, b, measure: str) -> DataFrame:
    """The measure of two values of a key side by side, and their difference."""
    metric, column, out = MEASURES[measure]
    found = study(all_of(df, [{"field": key, "operator": "in", "value": [a, b]}]), [key], metric, column, out)
    left, right = (F.max(F.when(F.col(key) == v, F.col(out))) for v in (a, b))
    return found.agg(left.alias("a"), right.alias("b"), (left - right).alias("difference"))

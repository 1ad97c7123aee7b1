"""Predicates from {field, operator, value} to columns. A missing value satisfies none of them."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

RANGES = (">", ">=", "<", "<=")


def _comparable(df: DataFrame, field: str, value: Any) -> bool:
    kind = df.schema[field].dataType
    if isinstance(kind, (NumericType, BooleanType)):
        return isinstance(value, (bool, int, float))
    return not isinstance(kind, StringType) or isinstance(value, str)


def predicate(df: DataFrame, field: str, operator: str, value: Any = None) -> Column:
    """TRUE or FALSE for every row. Literals of another type equal nothing; a range over them is an error."""
    if field not in df.columns:
        raise ValueError(f"no column {field!r}")
    c, number = F.col(field), df.schema[field].dataType
    if isinstance(number, BooleanType) and not isinstance(value, bool) and operator not in ("isnull", "notnull"):
        c = c.cast("int")
    if operator == "isnull":
        return c.isNull()
    if operator == "notnull":
        return c.isNotNull()
    if operator in ("in", "notin"):
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError(f"{operator} needs a list of values")
        wanted = [v for v in value if v is not None and _comparable(df, field, v)]
        inside = c.isin(wanted) if wanted else F.lit(False)
        return c.isNotNull() & (inside if operator == "in" else ~inside)
    if operator == "between":
        low, high = value
        return c.isNotNull() & c.between(low, high)
    if isinstance(value, (list, tuple, dict)):
        raise ValueError(f"{operator} needs a single value")
    if value is None:
        return F.lit(False) if operator == "==" else c.isNotNull()
    if not _comparable(df, field, value):
        if operator in RANGES:
            raise ValueError(f"{field} and {value!r} have no order")
        return F.lit(False) if operator == "==" else c.isNotNull()
    compared = {"==": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}
    if operator not in compared:
        raise ValueError(f"no operator {operator!r}")
    return c.isNotNull() & compared[operator]


def all_of(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that satisfy every filter; Catalyst pushes them to the scan."""
    if not filters:
        return df
    return df.where(reduce(Column.__and__, [predicate(df, f["field"], f["operator"], f.get("value")) for f in filters]))

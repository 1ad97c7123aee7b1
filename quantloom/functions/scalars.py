"""Row-local building blocks; all of them are column expressions and stay in generated code."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def known(c: Column) -> Column:
    """NaN counts as missing: NULL instead."""
    return F.when(F.isnan(c), None).otherwise(c)


def without_nan(df: DataFrame) -> DataFrame:
    """One projection at the scan that makes NaN NULL in every floating column."""
    return df.select([known(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema])


def ratio(over: Column, under: Column) -> Column:
    """over / under where under is positive, else NULL."""
    return F.when(under > 0, over / under)


def true_or_false(c: Column) -> Column:
    """Missing comparisons count as false."""
    return F.coalesce(c, F.lit(False))


def half_even_bin(price: Column, size: float) -> Column:
    """The multiple of size next to the price, halves to the even multiple."""
    return F.bround(price / F.lit(size), 0) * F.lit(size)


def true_range(high: Column, low: Column, before: Column) -> Column:
    """Of the three ranges the largest; high - low where there is no bar before."""
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def payload(text: Column, ddl: str) -> Column:
    """A nested value that was written as Python or JSON text; what can't be read is a NULL row."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.from_json(plain, ddl, {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"})


def saturating(c: Column, reference: float) -> Column:
    """c / reference, at most 1."""
    return F.least(c / F.lit(reference), F.lit(1.0))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def squashed(raw: Column, method: str, least: float = 0.0, most: float = 5.0, steepness: float = 1.0) -> Column:
    """A raw score on [0, 1] by minmax, sigmoid or tanh."""
    if method == "minmax":
        return clamp((raw - least) / (most - least)) if most > least else F.lit(0.0)
    if method == "sigmoid":
        return clamp(1 / (1 + F.exp(-steepness * raw)))
    if method == "tanh":
        return clamp((F.tanh(raw) + 1) / 2)
    raise ValueError(f"unknown method {method!r}")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def rms_distance(a: Column, b: Column) -> Column:
    """Euclidean distance over the root of the length."""
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 for two zero vectors, 1 if one alone is zero."""
    dot = _total(F.zip_with(a, b, lambda x, y: x * y))
    na, nb = (F.sqrt(_total(F.transform(v, lambda x: x * x))) for v in (a, b))
    one = 1 - F.least(F.greatest(dot / (na * nb), F.lit(-1.0)), F.lit(1.0))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(one)


def channel_similarity(distances: list[tuple[Column, float, float]]) -> Column:
    """1 - the weighted mean of min(distance, cap) / cap over channels (distance, weight, cap)."""
    used = [(d, w, cap) for d, w, cap in distances if w > 0 and cap > 0]
    total = sum(w for _, w, _ in used)
    return clamp(1 - sum((F.least(d, F.lit(cap)) / cap * (w / total) for d, w, cap in used), F.lit(0.0)))


def tolerance_score(value: Column, template: float | None, percent: float) -> Column:
    """1 - |value - template| / (|template| * percent), at least 0; no template is 1, no value 0, a zero template wants a zero."""
    if template is None:
        return F.lit(1.0)
    if template == 0:
        return F.when(value == 0, 1.0).otherwise(0.0)
    width = abs(template) * percent / 100
    if width <= 0:
        return F.when(value == template, 1.0).otherwise(0.0)
    return F.coalesce(clamp(1 - F.abs(value - template) / width), F.lit(0.0))


def python_text(df: DataFrame, name: str) -> Column:
    """A value as Python's str() writes it, for keys: True, None, 1e+16 apart from that as Spark does."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if kind.simpleString() == "boolean":
        text = F.when(c, "True").otherwise("False")
    elif isinstance(kind, (DoubleType, FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e16)
        text = F.when(whole, F.concat(F.floor(c).cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "None").otherwise(text)


def end_of_day(day: str) -> dt.datetime:
    """The last second of a date that stands for the end of a range."""
    return dt.datetime.combine(dt.date.fromisoformat(day), dt.time(23, 59, 59))


def number(c: Column) -> Column:
    """Text as a double, with a decimal comma or point; what is no number is NULL, and so is NaN."""
    return known(F.regexp_replace(F.trim(c), ",", ".").try_cast("double"))


def moment(c: Column, pattern: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """Text as a time without zone; what is none is NULL."""
    return F.try_to_timestamp(F.trim(c), F.lit(pattern)).cast("timestamp_ntz")


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces; numbers that JSON lacks are null."""

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x if x is None or isinstance(x, (str, int, float, bool)) else str(x)

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), allow_nan=False)


def short_id(prefix: str, value: object) -> str:
    """A name that follows from the value: the prefix and 16 hexadecimal digits of its canonical JSON's SHA-256."""
    return prefix + hashlib.sha256(canonical_json(value).encode()).hexdigest()[:16]


def row_id(prefix: str, *names: str) -> Column:
    """The same for rows, of their columns' values joined by |."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)), 256), 1, 16))


def overlaid(price: Column, least: Column, most: Column, onto_least: Column, onto_most: Column, height: float = 1.0) -> Column:
    """A price of [least, most] drawn on [onto_least, onto_most], or on so much of its height; a range below 1 counts as 1."""
    one = F.lit(1.0)
    return onto_least + (price - least) * F.greatest(onto_most - onto_least, one) * height / F.greatest(most - least, one)

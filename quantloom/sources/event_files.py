"""Breakout events and levels as files: folders of CSV, whole CSV and JSON datasets, and the contract they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StructType

from ..functions.scalars import payload

#: The columns of an event dataset, its version, and those of the narrower input that may not be null.
EVENT_COLUMNS = tuple(
    "breakout_id parent_balance_id instrument symbol session_id timeframe breakout_time breakout_bar_index confirmation_time confirmation_bar_index computation_timestamp version direction breakout_type confirmation_status "
    "breakout_price confirmation_price boundary_price boundary_type balance_high balance_low balance_midpoint balance_range_size balance_vpoc balance_hvn balance_lvn balance_equilibrium_score balance_rotation_quality_score "
    "balance_structural_integrity_score initial_volume initial_volume_zscore initial_delta delta_peak delta_mean_post_breakout atr_before atr_after strength_components follow_through post_breakout_volume_profile "
    "bar_count_initial_move bars_observed is_failed is_retest_occurred config_snapshot tags notes early_time early_price early_bar_index early_timeframe minutes_of_anticipation rotation_context pre_breakout_signal global_rank "
    "session_rank ml_nearest_support ml_nearest_resistance ml_distance_to_level ml_cluster_strength ml_density ml_alignment_score schema_version".split()
)
SCHEMA_VERSION = "1.1.0"
REQUIRED = tuple("schema_version breakout_id direction breakout_price balance_range_size initial_delta initial_volume atr_before follow_through is_failed".split())
NUMBERS = ("breakout_price", "balance_range_size", "initial_delta", "initial_volume", "atr_before")
FOLLOWED = ("max_excursion", "retracement_depth", "time_to_retest_boundary")
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, spans_lines: bool = True) -> DataFrame:
    """A file or a folder of CSV files with headers, columns as text; quoted fields may hold commas and quotes.

    Where fields may hold line breaks (`spans_lines`) a file can't be split and is one partition; without, partitions are the
    chunks of a file that is read piece by piece."""
    return spark.read.options(**{**CSV, "multiLine": spans_lines}).csv(path)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """A folder of level files: dates are dates, instruments are upper case, flags and numbers are told by their names. The files
    are read once."""
    raw = spark.read.options(**{**CSV, "multiLine": False}).csv(path)
    text = ("instrument", "session_name")
    kind = lambda n: F.col(n) if n in text else F.col(n).cast("boolean") if n.startswith(("touched_", "broke_")) else F.col(n).cast("double")
    typed = raw.select(*(kind(n).alias(n) for n in raw.columns if n != "date"), F.to_date("date").alias("date"))
    return typed.withColumn("instrument", F.upper("instrument"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a dataset: the `breakouts` of a JSON object, or the rows of a CSV. One without events is refused."""
    if path.rstrip("/").endswith(".json"):
        whole = spark.read.option("multiLine", True).json(path)
        kind = whole.schema["breakouts"].dataType if "breakouts" in whole.columns else None
        if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)):
            raise ValueError(f"{path} holds no list of breakouts")
        events = whole.select(F.inline("breakouts"))
    else:
        events = read_csv(spark, path)
    if events.isEmpty():
        raise ValueError(f"{path} holds no events")
    return events


def check_columns(df: DataFrame, names: tuple[str, ...] = EVENT_COLUMNS) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns are absent: {absent}")


def check_version(df: DataFrame, version: str = SCHEMA_VERSION) -> None:
    """All rows that tell a version tell this one, and some do. Only two values are ever fetched."""
    told = [r[0] for r in df.where("schema_version is not null").select(F.col("schema_version").cast("string")).distinct().limit(2).collect()]
    if told != [version]:
        raise ValueError(f"not all of version {version}: {sorted(told)}")


def nulls(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(column, n) of required columns with nulls, counted in one pass."""
    counted = df.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names))
    return counted.selectExpr(f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) as (column, n)").where("n > 0")


def check_categorical(df: DataFrame, name: str) -> None:
    """A column that is neither a number nor a truth value."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    if isinstance(df.schema[name].dataType, (NumericType, BooleanType)):
        raise ValueError(f"{name!r} is not categorical")


def check_rising(bounds: dict[str, list[float]]) -> None:
    """The thresholds of each bucket column rise strictly."""
    wrong = [n for n, b in bounds.items() if any(y <= x for x, y in zip(b, b[1:], strict=False))]
    if wrong:
        raise ValueError(f"thresholds do not rise: {wrong}")


def narrowed(events: DataFrame) -> DataFrame:
    """The narrower input: required columns first, follow-through flattened, numbers as numbers, all others after by name.

    Nested columns may be text, as a CSV has them. A required column that is absent, or null anywhere, is refused."""
    check_columns(events, tuple(n for n in REQUIRED if n != "schema_version"))
    followed = F.col("follow_through") if isinstance(events.schema["follow_through"].dataType, StructType) else payload(F.trim("follow_through"), ", ".join(f"{n} double" for n in FOLLOWED))
    given = followed if not isinstance(events.schema["follow_through"].dataType, StructType) else None
    known = set(FOLLOWED) if given is not None else set(events.schema["follow_through"].dataType.fieldNames())
    field = lambda n: followed[n].cast("double") if n in known else F.lit(None).cast("double")
    flag = F.col("is_failed").cast("string")
    out = events.withColumns({"schema_version": F.lit(SCHEMA_VERSION), **{n: F.col(n).cast("double") for n in NUMBERS}, "is_failed": F.when(F.lower(flag).isin("true", "1"), True).when(F.lower(flag).isin("false", "0"), False), **{n: field(n) for n in FOLLOWED}})
    wrong = {r["column"]: r["n"] for r in nulls(out).collect()}
    if wrong:
        raise ValueError(f"nulls in required columns: {wrong}")
    first = [*REQUIRED, *FOLLOWED]
    return out.select(*first, *sorted(n for n in out.columns if n not in first))


def in_order(df: DataFrame, times: str = "breakout_time", ids: tuple[str, ...] = ("breakout_id", "parent_balance_id")) -> DataFrame:
    """Rows by time and ids, as far as there are such columns; without any, by all columns that have an order."""
    keys: list[Column | str] = [n for n in (times, *ids) if n in df.columns]
    return df.orderBy(*(keys or [f.name for f in df.schema if f.dataType.typeName() != "map"]))

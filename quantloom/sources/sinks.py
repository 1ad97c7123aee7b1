"""Writers of results: nested columns as JSON in CSV, and column order by a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select([F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema])


def aligned(df: DataFrame, baseline: list[tuple[str, str]]) -> DataFrame:
    """Exactly the baseline's (name, type) columns: absent ones are NULL, others go."""
    return df.select([F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in baseline])


def contract_order(df: DataFrame, first: list[str]) -> DataFrame:
    """The contract's columns in their order, then all others by name."""
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with a header, as one folder for each value of the columns `by` if given."""
    writer = flat(df).write.mode("overwrite").options(header=True, escape='"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)

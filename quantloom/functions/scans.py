"""Windows over series of any length, in two levels.

A window over a whole series runs in one task. Here a series is cut into blocks: each is scanned apart, what it passes on to later
blocks is one row, these rows are scanned, and what they carry is joined back. Frames of a few rows take copies of the rows
beside their block. Rows without a key are in no series and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

#: Rows of a block where rows are numbered already.
BLOCK = 4096


def carried(value: Column, keys: list[str], block: str = "_block") -> Column:
    """Over rows of one a block: the sum of a value over all blocks before."""
    return F.coalesce(F.sum(value).over(earlier(keys, block)), F.lit(0))


def earlier(keys: list[str], block: str = "_block") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: list[str], order: str, name: str, cell: Column) -> DataFrame:
    """Rows with their place in their series by `order`, from 0. `cell` rises with the order and cuts a series into blocks."""
    cut = df.withColumn("_cell", cell)
    counts = cut.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.select(*keys, "_cell", carried(F.col("_n"), keys, "_cell").alias("_first"))
    within = F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(order))
    return cut.join(firsts, [*keys, "_cell"]).withColumn(name, F.col("_first") + within - 1).drop("_cell", "_first")


def blocks(df: DataFrame, keys: list[str], place: str, behind: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows by `_block` of their place, and copies of the `behind` rows before each block and the `ahead` rows after it, for which
    `_home` is false."""
    x = F.col(place)
    first, last = F.greatest(F.floor((x - ahead) / size), F.lit(0)), F.floor((x + behind) / size)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_block") == F.floor(x / size))


def in_block(keys: list[str], place: str) -> WindowSpec:
    return W.partitionBy(*keys, "_block").orderBy(place)


def framed(df: DataFrame, keys: list[str], place: str, columns: list[dict[str, Column]], behind: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows with columns, step by step, of frames over `in_block` that reach `behind` rows back and `ahead` rows on."""
    out = blocks(df, keys, place, behind, ahead, size)
    for step in columns:
        out = out.withColumns(step)
    return out.where("_home").drop("_block", "_home")

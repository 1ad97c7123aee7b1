"""Row numbers within groups, without ever bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucket_bits(rows: int, per_bucket: int = 4096) -> int:
    """Bits that split so many rows into buckets of about per_bucket rows; 8 at least, 22 at most."""
    return min(22, max(8, (max(rows, 1) // per_bucket).bit_length()))


def top_bits(order: Column, bits: int) -> Column:
    return F.shiftrightunsigned(order, 64 - bits)


def rank_in_group(df: DataFrame, group: str, order: str, ties: list[str], rows: int) -> DataFrame:
    """Add `rank` (long, from 0) within `group` by the unsigned value of the long column `order`, then by `ties`, and
    `group_rows`. `group` holds no null.

    Rows are cut into buckets by the leading bits of `order`, which is a hash: a bucket of a hot group is as small as any
    other. Bucket counts, aggregated before they are shuffled, give each bucket's first rank; the rows then meet them on
    (group, bucket), by which the row numbers are made too.
    """
    df = df.withColumn("_bucket", top_bits(F.col(order), bucket_bits(rows)))
    counts = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.select(
        group,
        "_bucket",
        F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"),
        F.sum("_n").over(W.partitionBy(group)).alias("group_rows"),
    )
    within = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(order, *ties))
    return df.join(firsts, [group, "_bucket"]).withColumn("rank", F.col("_first") + within - 1).drop("_first", "_bucket")

"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .ranks import bucket_bits, rank_in_group
from .shared import stash


def interleave(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """Deal all documents into `shards` shards that each hold every source in the mixture's proportion.

    Rows are shuffled by a seeded hash and ranked within their source. A row's fractional rank, (rank + 1/2) / rows of its
    source, spreads each source evenly over [0, 1). In the order of fractional ranks the shards are consecutive cuts,
    whose row counts are at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (from 0 without gaps in a shard).
    Nulls: a null text has size 1 and the CRC of no bytes; a null source is a source of its own; a null doc_id is kept.
    Repeated rows are dealt as rows of their own. Ties of the hash fall to doc_id, CRC and size. An empty table gives none.
    Other columns, whatever their names, are not read.
    """
    slim = stash(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        ).withColumn("shuffled", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32")))
    )
    rows = slim.count()
    cells = 1 << bucket_bits(rows)
    ranked = rank_in_group(slim, "stratum", "shuffled", ["doc_id", "text_crc32", "size"], rows)
    twice = 2 * F.col("rank") + 1
    spread = stash(
        ranked.select(
            "doc_id",
            "size",
            "text_crc32",
            "stratum",
            "rank",
            (twice / (2 * F.col("group_rows"))).alias("fraction"),
            F.expr(f"((2 * rank + 1) * {cells}L) div (2 * group_rows)").alias("cell"),
        )
    )
    firsts = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", (F.sum("n").over(W.orderBy("cell")) - F.col("n")).alias("first"))
    within = F.row_number().over(W.partitionBy("cell").orderBy("fraction", "stratum", "rank"))
    placed = spread.join(firsts, "cell").withColumn("place", F.col("first") + within - 1)
    cut = placed.withColumn("shard", F.expr(f"(place * {shards}L) div {max(rows, 1)}L"))
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")).alias("slot"),
    )

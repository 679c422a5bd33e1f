"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import positions, table


def shard_by_bytes(spark: SparkSession, docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Cut documents, in doc_id order, into n_shards contiguous shards at equal byte targets.

    A row counts octet_length(text) + 1 bytes (null text: 1). Per-partition totals give each
    partition its global offset; a row goes to the shard that holds its middle byte, so no cut is
    further from its target than half the row at the cut. Equal texts may be parted by a cut: one
    group of copies can be larger than a shard. Null doc_ids come first, repeated rows keep their
    places side by side, an empty table gives an empty result; other columns are ignored.

    Returns doc_id, size, text_crc32, shard, slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = positions(spark, rows, ["doc_id", "text_crc32", "size"], "shards", "size")
    placed = placed.withColumn(
        "shard",
        F.least(F.lit(n_shards - 1), F.expr(f"({n_shards}L * (before * 2 + size)) div (2 * total)")).cast("int"),
    )
    first = placed.groupBy("shard").agg(F.min("pos").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("_first")).alias("slot")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law `bytes`."""
    return shard_by_bytes(spark, table(spark, sf_dir, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

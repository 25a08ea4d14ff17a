"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import global_prefix

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): contiguous shards in id order.

    A row's size is the UTF-8 length of its text plus one (null text: one). A row belongs to the
    shard in whose equal share of all bytes its first byte falls, so a shard's size differs from
    the target by less than one row at either end; ``slot`` counts from 0 within a shard.
    Null ids come first, rows with the same id are ordered by checksum and size, fully repeated
    rows take neighbouring slots, an empty table gives no rows, other columns are ignored.
    With more shards than bytes some shards stay empty.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select(
        "doc_id",
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = global_prefix(slim, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "size")
    # Decimal keeps the product exact at any size.
    cutting = placed.withColumn(
        "shard",
        F.least(F.expr(f"cast(sum_before as decimal(20,0)) * {int(shards)} div sum_total"), F.lit(shards - 1)).cast("int"),
    )
    firsts = cutting.groupBy("shard").agg(F.min("rows_before").alias("_first"))
    # One row for each shard, so the broadcast is bounded.
    return cutting.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Sharding by global prefix sums of byte sizes [DataFrame functions only].

Documents are dealt by ranges of their id; the totals of the ranges give each
range its global start; a running sum inside a range gives each document its
own. Cutting the global byte line at equal targets gives contiguous shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written


def byte_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus `overhead`; a null text has no bytes
    and the CRC of no bytes. The order is by id (nulls first), then CRC, then
    size; a document belongs to the shard in which its first byte lies, so a
    shard is off its target by less than one document. slot counts from 0 in each
    shard. Repeated rows are rows of their own. An empty table gives no rows; with
    few rows some shards stay empty. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    no_bytes = F.lit(b"")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("binary"), no_bytes)).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # The range of a row is stored with it: what is counted and what is placed can't differ if a task runs again.
    ranged = written(rows.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "shard-ranges")

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts = totals.select(  # a row per range: as many as shuffle partitions
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start_rows"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    first_byte: Column = F.col("start_bytes") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (
        ranged.join(F.broadcast(starts), "range")
        .withColumn("first_byte", first_byte)
        .withColumn("row", F.col("start_rows") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"first_byte * {n_shards} div all_bytes")).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    placed = written(placed, "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Sharding by a global prefix sum of bytes.

Rows are ordered by id and dealt to range partitions; every partition reports its total, the totals' running sum gives
each partition its start, and a row's shard is the equal-sized target range its middle byte falls into. Shards are
contiguous in id order and differ from the target by less than one document at either cut.

Defined results: a null text has no bytes and counts 1 like an empty one; its checksum is 0. A null id sorts first.
Rows with equal ids are ordered by checksum, then size. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize, shuffle_partitions

COLUMNS = "doc_id, size, text_crc32, law, shard, slot, grown_shard"


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard, start_byte."""
    spark = docs.sparkSession
    text = F.col(text_col)
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # The few bytes a document are written first, so that range bounds are sampled from them, not from the texts.
    ranged = materialize(sizes, "sizes").repartitionByRange(shuffle_partitions(spark), *order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row per range partition: its count is the number of partitions, whatever the input.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_byte"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_row"),
        F.sum("bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        ranged.withColumn("through", F.sum("size").over(running))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "part")
        .withColumn("start_byte", F.col("part_byte") + F.col("through") - F.col("size"))
        .withColumn("row", F.col("part_row") + F.col("nth"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * start_byte + size) * {shards} div (2 * total)")).cast("int"))
        .select(*order, "start_byte", "row", "shard")
    )
    rows = materialize(rows, "cuts")
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start_byte",
    )

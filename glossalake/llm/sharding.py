"""Sharding: contiguous shards of equal bytes, cut from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, whole
from .prefix import global_prefix

ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """Puts each row into one of `shards` contiguous runs of the id order, with sizes near equal.

    A row's size is the UTF-8 bytes of its text plus `row_bytes`. A row goes to the shard in whose byte range its
    middle falls, so a shard misses its target by half a row at either end at most. Returns doc_id, size, text_crc32,
    law ('bytes'), shard, slot (place in the shard, gapless from 0) and grown_shard (null: this law has none).
    Null and empty texts: size `row_bytes`, crc 0. Null ids stand first. Repeated ids and rows are put one after
    another, ordered by crc and size. An empty table gives no rows. One text longer than a shard leaves shards empty.
    Other columns are not read, so their names can't clash.
    """
    raw = F.encode(whole(F.col(text_col)), "UTF-8")
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw).cast("long") + row_bytes).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).withColumn("one", F.lit(1).cast("long"))
    light = materialise(light)  # the texts are read once; what follows moves 24 bytes a row
    placed = global_prefix(light, ["doc_id", "text_crc32", "size"], {"bytes_before": "size", "rows_before": "one"})
    total = light.agg(F.sum("size")).first()[0] or 1  # one number
    cut = placed.withColumn("shard", F.least(F.expr(f"({shards} * (bytes_before * 2 + size)) div {2 * total}"), F.lit(shards - 1)).cast("int"))
    starts = cut.groupBy("shard").agg(F.min("rows_before").alias("first_row"))  # one row for each shard
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rows_before") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))

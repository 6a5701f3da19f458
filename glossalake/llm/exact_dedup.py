"""Exact deduplication by content sort. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, materialise, pick, table, whole

#: Sampled keys for each range; more make the ranges more even.
SAMPLES_A_RANGE = 40
#: Code points of the normalised text that lead the sort key, before its digest.
PREFIX = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACE, " ")


def _range_of(key: Column, splitters: list[str]) -> Column:
    """The number of splitters at or below key, by binary search in a constant array: log2 steps a row."""
    if not splitters:
        return F.lit(0)
    steps = [1 << i for i in range(len(splitters).bit_length() - 1, -1, -1)]
    known, n = F.lit(splitters), len(splitters)
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(known, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at),
    )


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, k_text, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once each run of white space is one space; null counts as empty. The sort key is
    the normalised text's first code points, its digest and a hash of the id. Splitters sampled from the keys
    deal the rows to ranges; equal texts are neighbours in this order, and a group too large for one range runs
    on through several, so a hot group is shared out. Each range is sorted (externally, if need be), and each
    row's whole text is compared with its neighbour's. The runs at the edges of the ranges, two a range at most,
    are then joined by digest. The text moves once. The smallest doc_id of a group stays (nulls are the largest), and of
    repeated rows exactly one. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(some: DataFrame) -> DataFrame:
        norm = some.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k_text"), normalised(F.col(text_col)).alias("norm"))
        return norm.withColumn("sha", F.sha2(F.encode("norm", "UTF-8"), 256))

    place = F.concat_ws("\x00", F.substring("norm", 1, PREFIX), "sha", F.hex(F.xxhash64("doc_id")))
    rows = docs.count()
    if rows and n > 1:
        some = keyed(docs.sample(min(1.0, SAMPLES_A_RANGE * n / rows), seed=7)).select(place.alias("key"))
        tiles = some.withColumn("tile", F.ntile(n).over(Window.orderBy("key")))  # a bounded sample, about 40 keys a range
        splitters = [x["key"] for x in tiles.groupBy("tile").agg(F.min("key").alias("key")).filter("tile > 1").orderBy("key").collect()]
    else:
        splitters = []
    dealt = keyed(docs).withColumn("part", _range_of(place, splitters)).repartitionById(n, F.col("part"))
    last = F.col("doc_id").asc_nulls_last()
    order = Window.partitionBy("part").orderBy(F.substring("norm", 1, PREFIX), "sha", last)
    head = dealt.withColumn("head", ~F.col("norm").eqNullSafe(F.lag("norm").over(order)))
    runs = head.withColumn("run", F.sum(F.col("head").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("norm")
    run = Window.partitionBy("part", "run")
    local = runs.withColumn("run_id", F.min("doc_id").over(run)).withColumn("run_size", F.count(F.lit(1)).over(run))
    light = materialise(local)

    ends = light.groupBy("part").agg(F.max("run").alias("last_run")).withColumnRenamed("part", "p")
    edge = light.filter("head").join(F.broadcast(ends), F.col("part") == F.col("p")).filter("run = 1 OR run = last_run")
    first = F.min(F.struct(F.col("run_id").isNull(), "run_id", "part"))  # false before true: nulls last
    joined = edge.groupBy("sha").agg(F.min("run_id").alias("all_id"), F.sum("run_size").alias("all_size"), first["part"].alias("all_part"), F.count(F.lit(1)).alias("pieces"))
    joined = edge.select("part", "run", "sha").join(joined.filter("pieces > 1"), "sha").select(F.col("part").alias("p"), F.col("run").alias("r"), "all_id", "all_size", "all_part")
    # joined has two rows a range at most.
    both = light.join(F.broadcast(joined), (F.col("part") == F.col("p")) & (F.col("run") == F.col("r")), "left")
    whole_run = F.col("all_size").isNull()
    return both.select(
        "doc_id", "k_text",
        F.when(whole_run, F.col("run_id")).otherwise(F.col("all_id")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("head") & (whole_run | (F.col("part") == F.col("all_part")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the later copies of any text; all columns stay as they are."""
    marks = content_sort(docs).filter("kept").select(F.col("doc_id").alias("k_id"), "k_text")
    return pick(docs, marks)


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents")).drop("k_text")


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""

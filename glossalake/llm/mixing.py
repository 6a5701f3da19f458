"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, n_words, pick, table
from .prefix import global_prefix

SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (source, source_size) -> plus place, target.

    Sources in code-point order, null last, weigh `weights`, repeating. `budget` times all sizes is shared by
    weight; what a source would get beyond `most` times its size is shared anew by weight until none is above.
    Sorted by size over weight, the sources that are cut come first, so running sums give the final level at once.
    One row a source: both windows run over the source list, never over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    placed = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.get(F.lit(list(weights)), (F.col("place") - 1) % len(weights)).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    below, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every).cast("double") * budget
    level = (total - F.coalesce(F.sum("source_size").over(below), F.lit(0)).cast("double") * most) / F.sum("weight").over(rest)
    filled = placed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * most)
    final = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(every)["level"]
    filled = filled.withColumn("target", F.least(F.coalesce(final * F.col("weight"), F.col("source_size") * float(most)), F.col("source_size") * float(most)))
    return filled.select("source", "source_size", "place", "target")


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, k_text, source, size, source_size, target, copies, taken.

    Size: words of the text; null and empty texts have none. Each source's documents are shuffled by a hash of
    id and seed and queued `most` times over; a copy's virtual finish time is its source's words up to its end,
    divided by the source's target. All copies are sorted by finish time and taken as long as the words before
    them are under the budget, so every source ends within a document of its target, the last copy may pass the budget,
    and reruns agree. Both running sums come from range-partitioned prefix sums: a hot source spans many tasks.
    A copy without words comes when its place in the queue does and adds nothing. Null ids hash as the empty
    string; repeated rows are queued each. A source without words has target 0 and takes nothing.
    An empty table gives no rows. Other columns are not read.
    """
    light = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k_text"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    light = materialise(light.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    known = materialise(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most))
    starts = known.withColumn("start", F.coalesce(F.sum("source_size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed("source", "s")
    # The list of sources is small beside the documents; Spark broadcasts it if its size is under the threshold.
    queued = light.join(starts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    queued = global_prefix(queued, ["place", "draw", "doc_id", "k_text"], {"before": "size"})
    in_source = F.col("before") - F.col("start") + F.col("size")
    entered = queued.withColumn("copy", F.explode(F.lit(list(range(most))))).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + in_source).cast("double") / F.col("target"))
    )
    total = light.agg(F.sum("size")).first()[0] or 0  # one number
    served = global_prefix(entered.filter("finish IS NOT NULL"), ["finish", "place", "draw", "doc_id", "k_text", "copy"], {"served": "size"})
    taken = served.filter(F.col("served") < F.lit(float(total) * budget)).select("doc_id", "k_text", "source", "size", "source_size", "target", F.lit(1).alias("n"))
    # Copies that are not taken count as 0, so that every row has a result; a row's copies share all these columns.
    rows = light.join(starts, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "k_text", "source", "size", "source_size", "target", F.lit(0).alias("n"))
    sums = rows.union(taken).groupBy("doc_id", "k_text", "source", "size", "source_size", "target").agg(F.sum("n").alias("copies"), F.sum(1 - F.col("n")).alias("zeros"), F.count(F.lit(1)).alias("lines"))
    # Of r equal rows with c copies taken together, the first c mod r take one more than the others.
    spread = sums.withColumn("r", F.col("lines") - F.col("copies")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r"))))
    spread = spread.withColumn("copies", F.expr("copies div r + IF(i <= copies % r, 1, 0)"))
    return spread.select("doc_id", "k_text", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the queue takes it; all columns stay as they are."""
    copies = fair_queue(docs).select(F.col("doc_id").alias("k_id"), "k_text", "copies")
    return pick(docs, copies, "copies")


def op8_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
w AS (SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
        - CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2)
        / sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, place_order) AS level FROM (
        SELECT level, row_number() OVER (ORDER BY source_size / weight, place) AS place_order FROM l WHERE level * weight <= source_size * 2)),
t AS (SELECT l.source, source_size, place, least(coalesce(f.level * weight, source_size * 2::DOUBLE), source_size * 2::DOUBLE) AS target FROM l, f),
q AS (SELECT d.*, t.source_size, t.place, t.target,
        sum(size) OVER (PARTITION BY t.place ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS in_source
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(copy * source_size + in_source AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) c(copy) WHERE target > 0),
g AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, place, draw, doc_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS served FROM e),
n AS (SELECT doc_id, count(*) AS copies FROM g WHERE served < (SELECT CAST(sum(size) AS DOUBLE) * 1.5::DOUBLE FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.copies, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""

"""Running totals over all rows in one global order, without ever gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise


def global_prefix(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with one column more for each of `sums`: {new: value}, the sum of value over all rows before this one.

    Sampled splitters range-partition the rows by `order`; the parts are written once, so that a part's number
    belongs to its rows for good; the parts' totals (one row a part) are summed up before each part and sent to
    all tasks; inside a part a window adds what stands before the row. `order` should tell all rows apart that
    differ in a value; ties are equal rows, and any of their orders gives the same set of results. Null values count
    as 0. An empty input gives no rows. No column of df may be named like a new one or `_part`.
    """
    dealt = materialise(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    value = {new: F.coalesce(F.col(v), F.lit(0)) for new, v in sums.items()}
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{new}") for new, v in value.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_s_{new}") for new in sums])
    # starts has one row for each part, 16 bytes or so: its size is the number of shuffle partitions, not the data's.
    both = dealt.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return both.select(*df.columns, *[(F.col(f"_s_{new}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(new) for new, v in value.items()])

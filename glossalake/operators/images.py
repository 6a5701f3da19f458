"""Images of documents: near-duplicates by fingerprint, informative ones, and text and images of files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Differing bits of a near-duplicate, least side of an image by the kind of file it is in, and limits of grey range and deviation.
NEAR, LEAST_SIDE, FLAT_RANGE, FLAT_SIGMA = 4, {"pdf": 120, "pptx": 80}, 8, 3.0
DARK, LIGHT, EDGE_SIGMA = 4, 251, 8


def large_enough(width: Column, height: Column, kind: str) -> Column:
    return (width >= LEAST_SIDE[kind]) & (height >= LEAST_SIDE[kind])


def drop_near_images(images: DataFrame, near: int = NEAR, group: str = "material_id", order: tuple[str, ...] = ("page_index", "id"), mark: str = "fingerprint") -> DataFrame:
    """images without those whose fingerprint differs in `near` bits or fewer from one kept before it in its group. Blank fingerprints are never near.

    The first of equal fingerprints is found by an aggregation; only distinct fingerprints, without the images' other columns, are gathered by group,
    as which are kept depends on those kept before. A group's distinct fingerprints must fit a task: 80 bytes each.
    """
    keyed = images.withColumn("g_at", F.struct(*order))
    blank = F.coalesce(F.col(mark), F.lit("")) == ""
    firsts = keyed.filter(~blank).groupBy(F.col(group).alias("g"), F.col(mark).alias("f")).agg(F.min("g_at").alias("first"))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        kept: list[tuple[str, int | None]] = []
        for f in rows["f"]:
            try:
                bits = int(f, 16)
            except ValueError:
                bits = None
            if not any(f == k or bits is not None and b is not None and (bits ^ b).bit_count() <= near for k, b in kept):
                kept.append((f, bits))
        return pd.DataFrame({"n": rows["n"][rows["f"].isin([f for f, _ in kept])]})

    ranked = firsts.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("first")).cast("long"))
    kind = images.schema[group].dataType.simpleString()
    chosen = ranked.select("g", "f", "n").groupBy("g").applyInPandas(lambda key, rows: greedy(rows).assign(g=key[0]), f"n long, g {kind}")
    kept = ranked.join(chosen.withColumnRenamed("g", "c_g").withColumnRenamed("n", "c_n"), F.col("g").eqNullSafe(F.col("c_g")) & (F.col("n") == F.col("c_n")), "left_semi")
    good = keyed.filter(~blank).join(kept.select("g", "f", "first"), F.col(group).eqNullSafe(F.col("g")) & (F.col(mark) == F.col("f")) & (F.col("g_at") == F.col("first")), "left_semi")
    return good.union(keyed.filter(blank)).drop("g_at")


def informative(pixels: Column) -> Column:
    """Whether grey values (0 to 255) of a thumbnail are neither flat nor nearly black or white throughout. Null and empty ones count as informative."""
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v) / n
    sigma = F.sqrt(F.aggregate(pixels, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    edge = ((mean < DARK) | (mean > LIGHT)) & (sigma < EDGE_SIGMA)
    flat = (F.array_max(pixels) - F.array_min(pixels) < FLAT_RANGE) | (sigma < FLAT_SIGMA) | edge
    return F.when(pixels.isNull() | (n <= 0), True).otherwise(~flat)


def average_hash(pixels: Column) -> Column:
    """The fingerprint of a 16 x 16 grey thumbnail: a bit for each value not under the mean, as 64 hexadecimal digits; the empty text for other sizes."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v) / 256
    digit = lambda i: sum((F.when(F.element_at(pixels, i * 4 + k + 1) >= mean, 1 << (3 - k)).otherwise(0) for k in range(4)), F.lit(0))
    digits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lower(F.hex(digit(i).cast("long"))))
    return F.when(F.size(pixels) == 256, F.array_join(digits, "")).otherwise("")

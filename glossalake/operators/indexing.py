"""Embedding indexes of passages and images, kept up to date. The models are functions of the caller."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unit
from .evidence import image_labels as as_labels
from .evidence import image_text
from .repository import image_context_text, image_labels, unindexed, upsert

#: Characters of a text that are embedded; fixed value.
TEXT_LIMIT = 2000
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embedded(rows: DataFrame, text: str, embed: Embed, out: str = "embedding") -> DataFrame:
    """rows with the unit vectors that `embed` gives for their texts, batch by batch on the executors."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed(texts.tolist())], dtype=object)

    return rows.withColumn(out, run(F.substring(F.coalesce(F.col(text), F.lit("")), 1, TEXT_LIMIT))).withColumn(out, unit(F.col(out)))


def index_segments(segments: DataFrame, embeddings: DataFrame, model: str, embed: Embed | None, limit: int = 200, material_id: str | None = None, force: bool = False) -> DataFrame:
    """The embeddings after the next `limit` segments by id, those without one under the model (with `force`: all), are indexed.

    Without a function nothing is: the index stays as it is. embeddings: segment_id, material_id, model, embedding; a segment has one row, the last written.
    """
    if embed is None:
        return embeddings
    some = segments if material_id is None else segments.filter(F.col("material_id") == material_id)
    todo = some.orderBy("id").limit(limit) if force else unindexed(some, embeddings, model, limit)
    new = embedded(todo.select(F.col("id").alias("segment_id"), "material_id", F.lit(model).alias("model"), "content_text"), "content_text", embed).drop("content_text")
    return upsert(embeddings, new.select(*embeddings.columns), "segment_id")


def index_images(images: DataFrame, embeddings: DataFrame, segments: DataFrame, observations: DataFrame, model: str, version: str, embed: Embed | None, read: Callable | None = None, caption: Callable | None = None, informative: Column | None = None, limit: int = 100, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, embeddings, counters) after the next `limit` images are indexed.

    Of images without an embedding of model and version, the first max(20 * limit, 100) by time and page are looked at; those not `informative` are removed, and the first
    `limit` others get read text (`read(path)`) and a caption (`caption(path, context)`, made labels) where these are missing, and an embedding of both and of their
    observations, unless there is no text. counters: one row of removed, processed, captioned and indexed images.
    """
    if embed is None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("removed_blank_count", "processed_image_count", "captioned_count", "indexed_count")]
        return images, embeddings, images.sparkSession.range(1).select(*zero)
    left = images if force else unindexed(images, embeddings, model, key="image_id", version=version)
    seen = left.orderBy("created_at", "page_index", "id").limit(max(limit * 20, 100)).withColumn("good", F.coalesce(informative, F.lit(True)) if informative is not None else F.lit(True))
    todo = seen.filter("good").orderBy("created_at", "page_index", "id").limit(limit).drop("good")
    gone = seen.filter("NOT good").select("id")
    context = image_context_text(todo, segments).withColumnRenamed("image_id", "c_id")
    labels = image_labels(observations).select(F.col("source_image_id").alias("l_id"), F.col("labels").alias("observation_labels"))
    rows = todo.join(context, F.col("id") == F.col("c_id"), "left").join(labels, F.col("id") == F.col("l_id"), "left").drop("c_id", "l_id")

    @F.pandas_udf("string")
    def ocr(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([t or (read(p) if read else "") for p, t in zip(path, text, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def describe(path: pd.Series, text: pd.Series, about: pd.Series) -> pd.Series:
        return pd.Series([t if t and not force else (caption(p, c) if caption else "") for p, t, c in zip(path, text, about, strict=True)], dtype=object)

    wanted = F.lit(force) | (F.coalesce("visual_caption", F.lit("")) == "")
    done = rows.withColumn("new_ocr", ocr("image_path", "ocr_text")).withColumn("wanted", wanted).withColumn("said", describe("image_path", "visual_caption", "context"))
    done = done.withColumn("new_caption", F.when(F.col("wanted"), as_labels(F.col("said"))).otherwise(F.col("visual_caption"))).withColumn("own_text", image_text(F.col("new_ocr"), F.col("new_caption"), F.col("observation_labels")))
    done = done.cache()  # the functions run once; lost parts are made again
    new = embedded(done.filter("own_text <> ''").select(F.col("id").alias("image_id"), "material_id", F.lit(model).alias("model"), F.lit(version).alias("method_version"), "own_text"), "own_text", embed)
    fresh = done.select(F.col("id").alias("n_id"), "new_ocr", "new_caption")
    kept = images.join(gone.withColumnRenamed("id", "g_id"), F.col("id") == F.col("g_id"), "left_anti").join(fresh, F.col("id") == F.col("n_id"), "left")
    kept = kept.withColumns({"ocr_text": F.when(F.col("n_id").isNull(), F.col("ocr_text")).otherwise(F.col("new_ocr")), "visual_caption": F.when(F.col("n_id").isNull(), F.col("visual_caption")).otherwise(F.col("new_caption"))}).select(*images.columns)
    counters = done.agg(F.count(F.lit(1)).alias("processed_image_count"), F.count_if(F.col("wanted") & (F.col("new_caption") != "")).alias("captioned_count"), F.count_if(F.col("own_text") != "").alias("indexed_count"))
    counters = gone.agg(F.count(F.lit(1)).alias("removed_blank_count")).join(F.broadcast(counters))  # one row each
    return kept, upsert(embeddings, new.select(*embeddings.columns), "image_id"), counters


def token_table(segments: DataFrame, columns: Sequence[str] = ("content_text", "page_ref", "source_locator")) -> DataFrame:
    """(token, id, n): the inverted index of the segments, partitioned by nothing but its tokens' counts."""
    from ..functions.text import search_words

    words = F.filter(F.split(F.concat(*[search_words(F.coalesce(F.col(c), F.lit(""))) for c in columns]), " "), lambda t: t != "")
    return segments.select("id", F.explode(words).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("n"))


def follow(index: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """The inverted index after segments changed or were added (`changed`, whole rows) and others went (`gone`, id)."""
    touched = changed.select("id").union(gone.select("id")).distinct()
    return index.join(touched, "id", "left_anti").unionByName(token_table(changed))

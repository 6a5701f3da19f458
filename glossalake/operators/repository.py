"""Relational operators over the document repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import KEYWORD, clean_extracted, cosine, like_any_case, trim_context


# Runs under way and failed ones; what the columns of these names may hold.
RUNNING, FAILED = ("running", "extracting", "in_progress"), ("error", "failed")
SOURCE_TYPES = ("anthropological_record", "bibliography", "dictionary", "ethnography", "other", "pdf", "presentation", "publication", "slide", "workshop_material")
STATUSES = ("metadata_complete", "needs_metadata", "needs_review", "ready_for_text_extraction", "uploaded")
OBSERVATION_TYPES = ("material", "motif", "other", "place", "process", "term")
SEARCHED = ("title", "authors", "year", "collection", "abstract_or_notes", "raw_reference", "keywords", "auto_keywords")


# How an image's context is headed.
NEARNESS = ("Exact same source and page/slide as image ", "Same page/slide context as image ", "Nearby source context for image ")


def checked(value: str | None, allowed: tuple[str, ...], what: str) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    return value


def constants(spark: SparkSession) -> DataFrame:
    """(kind, value): source types, statuses and observation types, sorted."""
    rows = [(k, v) for k, vs in (("source_type", SOURCE_TYPES), ("status", STATUSES), ("observation_type", OBSERVATION_TYPES)) for v in vs]
    return spark.createDataFrame(rows, "kind string, value string").orderBy("kind", "value")


def with_file_count(materials: DataFrame, files: DataFrame) -> DataFrame:
    """Materials with the number of their files, 0 for none. Files are counted before they meet the materials."""
    n = files.groupBy(F.col("material_id").alias("m")).agg(F.count("id").alias("file_count"))
    return materials.join(n, materials["id"] == n["m"], "left").drop("m").withColumn("file_count", F.coalesce("file_count", F.lit(0).cast("long")))


def search_materials(materials: DataFrame, files: DataFrame, observations: DataFrame, term: str) -> DataFrame:
    """Materials that fit by one of the columns SEARCHED, a file's name, or an observation's text, notes or quote. A fit by file name alone counts the fitting files only."""
    like = lambda c: F.coalesce(like_any_case(F.col(c), term), F.lit(False))
    seen = observations.filter(like("observed_text") | like("notes") | like("context_quote")).select(F.col("material_id").alias("o")).distinct()
    n = files.groupBy(F.col("material_id").alias("m")).agg(F.count("id").alias("all_files"), F.count_if(F.col("id").isNotNull() & like("original_filename")).alias("hits"), F.max(like("original_filename")).alias("named"))
    both = materials.join(n, materials["id"] == n["m"], "left").join(seen, materials["id"] == seen["o"], "left")
    fit = F.col("o").isNotNull()
    for c in SEARCHED:
        fit = fit | like(c)
    shown = both.filter(fit | F.coalesce("named", F.lit(False)))
    return shown.select(*materials.columns, F.coalesce(F.when(fit, F.col("all_files")).otherwise(F.col("hits")), F.lit(0)).cast("long").alias("file_count"))


def list_materials(materials: DataFrame, files: DataFrame, observations: DataFrame, term: str | None = None, status: str | None = None, source_type: str | None = None, collection: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(a page, the newest first, ties by id; the total of all pages). All filters hold; unknown values and bounds are errors before anything runs."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")
    checked(status, STATUSES, "status"), checked(source_type, SOURCE_TYPES, "source_type")
    for c, v in (("status", status), ("source_type", source_type), ("collection", collection)):
        materials = materials.filter(F.col(c) == v) if v else materials
    found = search_materials(materials, files, observations, term) if term else with_file_count(materials, files)
    return found.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit), found.agg(F.count(F.lit(1)).alias("total"))


def collection_counts(materials: DataFrame) -> DataFrame:
    return materials.filter("trim(collection) <> ''").groupBy("collection").agg(F.count(F.lit(1)).alias("n")).orderBy(F.lower("collection"), "collection")


def ready_queue(materials: DataFrame, limit: int = 25) -> DataFrame:
    return materials.filter("status = 'ready_for_text_extraction'").orderBy(F.desc("updated_at"), "id").limit(limit)


def observation_summary(observations: DataFrame) -> DataFrame:
    return observations.groupBy("material_id", "observation_type").agg(F.count(F.lit(1)).alias("n"))


def extraction_status(materials: DataFrame, runs: DataFrame, segments: DataFrame) -> DataFrame:
    """Each material's latest run, its segments, and the status that follows: the run's, and only after a finished one the segments'."""
    latest = runs.groupBy("material_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("run_status"), F.count(F.lit(1)).alias("runs")).withColumnRenamed("material_id", "m")
    n = segments.groupBy("material_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("material_id", "s")
    both = materials.join(latest, materials["id"] == latest["m"], "left").join(n, materials["id"] == n["s"], "left")
    run, count = F.col("run_status"), F.coalesce("n", F.lit(0))
    status = F.when(F.col("runs").isNull(), "not_extracted").when(run.isin(*RUNNING), "extracting").when(run.isin(*FAILED), "extract_error").when(count > 0, "extracted").otherwise("no_text_found")
    return both.select("id", "run_status", count.alias("segment_count"), status.alias("extraction_status"))


def unindexed(segments: DataFrame, embeddings: DataFrame, model: str, limit: int | None = None, key: str = "segment_id", version: str | None = None) -> DataFrame:
    """Rows without an embedding of the model (and method version), by id; `limit` of them."""
    done = embeddings.filter(F.col("model") == model)
    done = done if version is None else done.filter(F.col("method_version") == version)
    left = segments.join(done.select(F.col(key).alias("e")), segments["id"] == F.col("e"), "left_anti")
    return left if limit is None else left.orderBy("id").limit(limit)


def image_labels(observations: DataFrame) -> DataFrame:
    """Per image, its observations' labels, one a line, in order."""
    note = F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.concat(F.lit(" - "), "notes")).otherwise("")
    line = F.concat("observation_type", F.lit(": "), "observed_text", note)
    return observations.filter("source_image_id IS NOT NULL").groupBy("source_image_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("labels"))


def image_context(images: DataFrame, segments: DataFrame, most: int = 6) -> DataFrame:
    """Segments for an image: of its page and file, else of its page, else of a neighbouring page; the first level that has any, its first `most` by id.

    Segments are cut to the first `most` of a page, and of a page and file, before they meet the images: more can't be shown.
    """
    s = segments.select(F.col("id").alias("segment_id"), F.col("material_id").alias("s_m"), F.col("page_index").alias("s_p"), F.col("source_locator").alias("s_loc"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("segment_id"))
    s = s.withColumn("by_page", first("s_m", "s_p")).withColumn("by_file", first("s_m", "s_p", "s_loc")).filter(f"by_page <= {most} OR by_file <= {most}")
    i = images.select(F.col("id").alias("image_id"), F.col("material_id").alias("m"), F.col("page_index").alias("p"), F.col("source_locator").alias("loc"))
    near = i.withColumn("page", F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1))).filter("page >= 0 OR page = p")  # an equality join, not a range join
    both = near.join(s, (F.col("m") == F.col("s_m")) & (F.col("page") == F.col("s_p")))
    own = F.col("page") == F.col("p")
    level = F.when(own & (F.col("loc") == F.col("s_loc")), 1).when(own, 2).otherwise(3)
    w = Window.partitionBy("image_id")
    ranked = both.withColumn("level", level).filter((F.col("level") == 1) & (F.col("by_file") <= most) | (F.col("by_page") <= most)).withColumn("least", F.min("level").over(w)).filter("level = least")
    return ranked.withColumn("k", F.row_number().over(w.orderBy("segment_id"))).filter(F.col("k") <= most).select("image_id", "segment_id", "level", "k")


def image_context_text(images: DataFrame, segments: DataFrame, most: int = 1600) -> DataFrame:
    """(image_id, context): a heading that says how near, and the segments of image_context(), cleaned and cut to `most` characters."""
    found = image_context(images, segments)
    body = found.join(segments.select(F.col("id").alias("s_id"), F.col("source_locator").alias("s_loc"), F.col("page_ref").alias("s_ref"), "content_text"), F.col("segment_id") == F.col("s_id"))
    line = F.concat(F.when(F.col("level") == 1, "").otherwise(F.concat(F.coalesce("s_loc", F.lit("None")), F.lit(" · "))), F.coalesce("s_ref", F.lit("None")), F.lit(": "), F.coalesce("content_text", F.lit("None")))
    text = body.groupBy("image_id").agg(F.min("level").alias("level"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("body"))
    of = images.select(F.col("id").alias("i"), F.concat(F.lit("("), F.coalesce("source_locator", F.lit("None")), F.lit(" · "), F.coalesce("page_ref", F.lit("None")), F.lit("):\n")).alias("place"))
    head = F.when(F.col("level") == 1, NEARNESS[0]).when(F.col("level") == 2, NEARNESS[1]).otherwise(NEARNESS[2])
    both = of.join(text, F.col("i") == F.col("image_id"), "left")
    return both.select(F.col("i").alias("image_id"), trim_context(F.concat(head, "place", F.coalesce("body", F.lit(""))), most).alias("context"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def delete_cascade(child: DataFrame, gone: DataFrame, column: str = "material_id") -> DataFrame:
    """Child rows whose parent is not in `gone` (one column, id)."""
    return child.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def set_null(child: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """References to rows of `gone` become null."""
    g = gone.select(F.col("id").alias("g_id"))
    return child.join(g, child[column] == g["g_id"], "left").withColumn(column, F.when(F.col("g_id").isNull(), F.col(column))).drop("g_id")


def semantic_top(embeddings: DataFrame, query: list[float], k: int = 12) -> DataFrame:
    """The k nearest by cosine; the query is a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return embeddings.select("segment_id", F.round(cosine(F.col("embedding"), q), 5).alias("score")).orderBy(F.desc("score"), "segment_id").limit(k)


def keyword_scores(docs: DataFrame, stop: list[str], least: int = 2, text: str = "content_text") -> DataFrame:
    """(phrase, score) of at least `least`: words, pairs and triples of what stop words leave, weighted 1, 3 and 5. One scan; phrases are counted before they move."""
    t = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(KEYWORD), F.lit(0)), lambda x: ~x.isin(stop))
    none, n = F.array().cast("array<string>"), F.size("t")
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    words = docs.select(t.alias("t")).withColumn("two", F.when(n >= 2, F.zip_with(F.slice("t", 1, n - 1), F.slice("t", 2, n - 1), joined)).otherwise(none))
    words = words.withColumn("three", F.when(n >= 3, F.zip_with(F.slice("two", 1, n - 2), F.slice("t", 3, n - 2), joined)).otherwise(none))
    counted = words.select(F.explode(F.concat("t", "two", "three")).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    # A word has no blank, a pair one, a triple two: 1, 3 and 5.
    return counted.select("phrase", (F.col("n") * (F.regexp_count("phrase", F.lit(" ")) * 2 + 1)).cast("long").alias("score")).filter(F.col("score") >= least)


def index_status(segments: DataFrame, embeddings: DataFrame, images: DataFrame, image_embeddings: DataFrame, model: str, version: str) -> DataFrame:
    """One row: segments and images, and how many of either are indexed under the model (and method version)."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    done = image_embeddings.filter((F.col("model") == model) & (F.col("method_version") == version))
    counts = [n(embeddings.filter(F.col("model") == model), "indexed_segments"), n(images, "images"), n(done, "indexed_images")]
    out = n(segments, "segments")
    for c in counts:
        out = out.join(F.broadcast(c))  # one row each
    return out


def observation_defaults(observations: DataFrame, segments: DataFrame, images: DataFrame) -> DataFrame:
    """Observations whose blank page, locator and quote are taken from their segment, and then from their image (caption and read text)."""
    s = segments.select(F.col("id").alias("s_id"), F.col("page_ref").alias("s_ref"), F.col("source_locator").alias("s_loc"), F.col("content_text").alias("s_text"))
    quote = clean_extracted(F.concat_ws("\n\n", F.nullif("visual_caption", F.lit("")), F.nullif("ocr_text", F.lit(""))))
    i = images.select(F.col("id").alias("i_id"), F.col("page_ref").alias("i_ref"), F.col("source_locator").alias("i_loc"), quote.alias("i_text"))
    both = observations.join(s, F.col("source_segment_id") == F.col("s_id"), "left").join(i, F.col("source_image_id") == F.col("i_id"), "left")
    first = lambda own, *rest: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (own, *rest)])
    filled = {"source_page_ref": first("source_page_ref", "s_ref", "i_ref"), "source_locator": first("source_locator", "s_loc", "i_loc"), "context_quote": first("context_quote", "s_text", "i_text")}
    return both.withColumns(filled).select(*observations.columns)

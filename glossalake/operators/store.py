"""Writes to the repository's tables: each gives the table as it is afterwards. Ids and times come from the caller, so reruns agree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType, StructField, StructType

from ..functions.text import safe_filename
from .repository import OBSERVATION_TYPES, SOURCE_TYPES, STATUSES, checked, delete_cascade, set_null

#: The most bytes of an upload, and columns that listings don't show.
MAX_UPLOAD, INTERNAL = 100 * 1024 * 1024, ("stored_path", "embedding_json", "embedding", "image_path")


def insert(table: DataFrame, rows: list[Mapping], defaults: Mapping | None = None) -> DataFrame:
    """table with new rows; columns that a row lacks take the default, else null. Unknown columns are an error."""
    schema = table.schema
    for r in rows:
        if extra := set(r) - set(schema.names):
            raise ValueError(f"unknown columns: {', '.join(sorted(extra))}")
    full = [{**(defaults or {}), **r} for r in rows]
    plain = StructType([StructField(f.name, f.dataType if isinstance(f.dataType, (NumericType, ArrayType, BooleanType)) else StringType()) for f in schema.fields])
    new = table.sparkSession.createDataFrame([tuple(r.get(c) for c in schema.names) for r in full], plain)
    return table.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))


def update(table: DataFrame, key: str, value, changes: Mapping, now: str | None = None) -> DataFrame:
    """The row of `key` with the given columns changed and, with `now`, its updated_at; other rows and columns stay."""
    new = dict(changes) | ({"updated_at": now} if now is not None and "updated_at" in table.columns else {})
    if missing := set(new) - set(table.columns):
        raise ValueError(f"unknown columns: {', '.join(sorted(missing))}")
    kinds = dict(table.dtypes)
    return table.withColumns({c: F.when(F.col(key).eqNullSafe(F.lit(value)), F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items()})


def ensure_column(table: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """table with the column, of the default where it wasn't there."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(kind))


def without_internal(table: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return table.drop(*INTERNAL, *more)


def validated(kind: str, values: Mapping) -> Mapping:
    """values, if their enumerations hold; else an error."""
    for c, allowed in (("source_type", SOURCE_TYPES), ("status", STATUSES), ("observation_type", OBSERVATION_TYPES)):
        if values.get(c) is not None:
            checked(values[c], allowed, c)
    if kind == "observation" and not (values.get("observed_text") or "").strip():
        raise ValueError("observed_text is required")
    return values


def existing(table: DataFrame, key: str, value, what: str) -> DataFrame:
    """The row of a key; none is a LookupError."""
    found = table.filter(F.col(key) == value)
    if found.isEmpty():
        raise LookupError(f"{what} not found")
    return found


def owned(references: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """References (material_id and `column`) that name a row of `parents` outside their own material or none at all. Null names nothing, and is fine."""
    own = parents.select(F.col("id").alias("p_id"), F.col("material_id").alias("p_material"))
    return references.filter(F.col(column).isNotNull()).join(own, (F.col(column) == F.col("p_id")) & (F.col("material_id") == F.col("p_material")), "left_anti")


def check_owned(references: DataFrame, parents: DataFrame, column: str) -> None:
    if not owned(references, parents, column).isEmpty():
        raise ValueError(f"{column} does not belong to this material")


def delete_material(tables: Mapping[str, DataFrame], material_id) -> dict[str, DataFrame]:
    """All tables without the material: it and the rows of its children go."""
    gone = tables["materials"].filter(F.col("id") == material_id).select("id")
    return {name: t.filter(F.col("id") != material_id) if name == "materials" else delete_cascade(t, gone) if "material_id" in t.columns else t for name, t in tables.items()}


def delete_segments(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after segments (id) go: their embeddings go too, and observations lose the reference."""
    out = dict(tables)
    out["segments"] = delete_cascade(tables["segments"], gone, "id")
    if "segment_embeddings" in out:
        out["segment_embeddings"] = delete_cascade(tables["segment_embeddings"], gone, "segment_id")
    if "observations" in out:
        out["observations"] = set_null(tables["observations"], gone, "source_segment_id")
    return out


def affected_images(*changed: DataFrame) -> DataFrame:
    """(image_id): images that any of the changed observations names, before or after."""
    out = None
    for df in changed:
        ids = df.select(F.col("source_image_id").alias("image_id")).dropna()
        out = ids if out is None else out.union(ids)
    return out.distinct()


def invalidate_images(embeddings: DataFrame, images: DataFrame) -> DataFrame:
    """Image embeddings without those of the images (image_id): they are to be indexed anew."""
    return embeddings.join(images, "image_id", "left_anti")


def uploads(files: DataFrame, name: str = "original_filename", size: str = "file_size") -> DataFrame:
    """Files that may be stored, not empty and of MAX_UPLOAD bytes at most, under a safe name."""
    safe = safe_filename(F.col(name))
    return files.filter(f"{size} > 0 AND {size} <= {MAX_UPLOAD}").withColumn(name, F.when(safe == "", "uploaded-file").otherwise(safe))


def listing(table: DataFrame, what: str, limit: int | None = None) -> DataFrame:
    """A table's rows in the order that its listing has; ties by id."""
    order: dict[str, list[Column]] = {
        "files": [F.desc("uploaded_at"), F.col("id")], "extraction_files": [F.col("uploaded_at"), F.col("id")], "segments": [F.col("id")], "links": [F.col("id")], "images": [F.col("page_index"), F.col("created_at"), F.col("id")],
        "runs": [F.desc("created_at"), F.desc("id")], "observations": [F.desc("updated_at"), F.col("id")], "image_index": [F.col("created_at"), F.col("page_index"), F.col("id")],
    }
    out = table.orderBy(*order[what])
    return out if limit is None else out.limit(limit)


def capped(segments: DataFrame, files: DataFrame, most: int = 1000) -> DataFrame:
    """The first `most` segments of a material's extraction: by the files' order, then the chunks'. segments: file_id, chunk; files: id, uploaded_at."""
    if not 1 <= most <= 5000:
        raise ValueError("1 to 5000 segments can be kept")
    f = files.select(F.col("id").alias("f_id"), "uploaded_at")
    return segments.join(f, F.col("file_id") == F.col("f_id")).orderBy("uploaded_at", "f_id", "chunk").limit(most).drop("f_id", "uploaded_at")

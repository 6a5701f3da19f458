"""Catalogue, star-schema and map queries over lexical datasets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import like_any_case, valid_coordinates


def star(languages: DataFrame, forms: DataFrame, parameters: DataFrame, glosses: list[str] | None = None) -> DataFrame:
    """Languages with their forms and glosses; the gloss filter reaches the parameter scan. Join strategies are left to AQE."""
    p = parameters.filter(F.col("Concepticon_Gloss").isin(glosses)) if glosses else parameters
    p = p.select(F.col("ID").alias("p_id"), F.col("Concepticon_Gloss").alias("parameter_name"))
    f = forms.select("Language_ID", "Parameter_ID", F.col("Value").alias("form_value"))
    return languages.join(f, languages["ID"] == f["Language_ID"]).join(p, F.col("Parameter_ID") == F.col("p_id")).drop("Language_ID", "Parameter_ID", "p_id")


def tile_rows(languages: DataFrame, forms: DataFrame, parameters: DataFrame, form: str | None = None, parameter: str | None = None, name: str | None = None) -> DataFrame:
    """A tile's points: languages, joined with forms and concepts (by their names) only if one of these is asked for."""
    rows = languages
    if form or parameter:
        p = parameters.select(F.col("ID").alias("p_id"), F.col("Name").alias("parameter_name"))
        f = forms.select("Language_ID", "Parameter_ID", F.col("Value").alias("form_value"))
        rows = languages.join(f, languages["ID"] == f["Language_ID"]).join(p, F.col("Parameter_ID") == F.col("p_id")).drop("Language_ID", "Parameter_ID", "p_id")
    return search(rows, name, form or None, parameter or None)


def datasets_with(index: DataFrame, glosses: list[str]) -> DataFrame:
    """(dataset_name): datasets that the gloss index has one of the glosses for; a broadcast of these prunes a partitioned scan."""
    return index.filter(F.col("Concepticon_Gloss").isin(glosses)).select("dataset_name").distinct()


def located(df: DataFrame) -> DataFrame:
    """Rows with valid coordinates, which become doubles."""
    ok = df.filter(valid_coordinates(F.col("Latitude"), F.col("Longitude")))
    return ok.withColumns({c: F.col(c).cast("double") for c in ("Latitude", "Longitude")})


def full_data(languages: DataFrame, forms: DataFrame, parameters: DataFrame, glosses: list[str]) -> DataFrame:
    """All located forms of the glosses, over all datasets: the map's narrow columns."""
    rows = located(star(languages, forms, parameters, glosses))
    return rows.select("ID", "Glottocode", "Latitude", "Longitude", "form_value", "parameter_name", "dataset_name")


def export(languages: DataFrame, forms: DataFrame, parameters: DataFrame, glosses: list[str]) -> DataFrame:
    """full_data() with the languages' names."""
    rows = located(star(languages, forms, parameters, glosses))
    return rows.select("ID", "Name", "Glottocode", "Latitude", "Longitude", "form_value", "parameter_name", "dataset_name")


def gloss_index(languages: DataFrame, forms: DataFrame, parameters: DataFrame) -> DataFrame:
    """Distinct (dataset_name, Concepticon_Gloss)."""
    return star(languages, forms, parameters).filter("parameter_name IS NOT NULL").select("dataset_name", F.col("parameter_name").alias("Concepticon_Gloss")).distinct()


def catalog(languages: DataFrame) -> DataFrame:
    """Located languages by dataset; datasets without one don't appear."""
    return located(languages).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))


def catalog_by_gloss(languages: DataFrame, forms: DataFrame, parameters: DataFrame, glosses: list[str]) -> DataFrame:
    return located(star(languages, forms, parameters, glosses)).groupBy("dataset_name").agg(F.count_distinct("ID").alias("n"))


def combined_total(counts: DataFrame) -> DataFrame:
    """The combined dataset's count: the sum of the datasets' own counts."""
    return counts.agg(F.lit("Combined").alias("dataset_name"), F.sum("n").alias("n"))


def search(rows: DataFrame, name: str | None = None, form: str | None = None, parameter: str | None = None, also: str | None = None) -> DataFrame:
    """Late filters: name (or the column `also`), form value and parameter name; null fits nothing."""
    if name is not None:
        hit = like_any_case(F.col("Name"), name)
        rows = rows.filter(hit | like_any_case(F.col(also), name) if also else hit)
    for column, term in (("form_value", form), ("parameter_name", parameter)):
        rows = rows.filter(like_any_case(F.col(column), term)) if term is not None else rows
    return rows


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a stated order; limits are checked before anything runs."""
    if not 1 <= limit <= 5000 or offset < 0:
        raise ValueError("limit must be 1 to 5000 and offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def box(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """South, north, west, east of a box around a point; a degree counts as 111 km."""
    dlat = radius_km / 111.0
    c = math.cos(math.radians(lat))
    dlon = radius_km / (111.0 * c) if c else dlat
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def in_box(rows: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    s, n, w, e = box(lat, lon, radius_km)
    return rows.filter(F.col("Latitude").try_cast("double").between(s, n) & F.col("Longitude").try_cast("double").between(w, e))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns as null."""
    odd = [float("inf"), float("-inf")]
    return df.withColumns({c: F.when(~(F.isnan(c) | F.col(c).isin(odd)), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def schema_kinds(df: DataFrame) -> DataFrame:
    """(name, kind, raw_type): numerical if the type's name holds a number type's name, else categorical."""
    rows = [(f.name, "numerical" if any(x in f.dataType.simpleString() for x in ("int", "float", "double", "decimal")) else "categorical", f.dataType.simpleString()) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, kind string, raw_type string")


def tile_bounds(tiles: DataFrame) -> DataFrame:
    """(z, x, y) -> west, south, east, north of slippy tiles."""
    n = F.pow(F.lit(2.0), F.col("z"))
    lat = lambda y: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / n))))
    lon = lambda x: x / n * 360.0 - 180.0
    return tiles.select("z", "x", "y", lon(F.col("x")).alias("west"), lat(F.col("y") + 1).alias("south"), lon(F.col("x") + 1).alias("east"), lat(F.col("y")).alias("north"))


def in_tile(rows: DataFrame, west: float, south: float, east: float, north: float, extent: int = 4096) -> DataFrame:
    """Points inside a tile, edges included, with their place on its grid (Mercator, y downwards)."""
    y = lambda c: F.log(F.tan(F.radians(45.0 + c / 2.0)))
    lat, lon = F.col("Latitude").try_cast("double"), F.col("Longitude").try_cast("double")
    inside = rows.filter(lat.between(south, north) & lon.between(west, east))
    top, low = y(F.lit(north)), y(F.lit(south))
    return inside.withColumns({"gx": F.floor((lon - west) / (east - west) * extent).cast("int"), "gy": F.floor((top - y(lat)) / (top - low) * extent).cast("int")})


def binary_matrix(rows: DataFrame, meta: list[str], concept: str, form: str, concepts: list[str]) -> DataFrame:
    """One row for each combination of meta values, 0 or 1 for each concept. Blank forms and null meta values are left out."""
    fine = rows.filter(F.regexp_replace(F.coalesce(F.col(form), F.lit("")), r"(?U)^\s+|\s+$", "") != "").dropna(subset=[*meta, concept])
    return fine.groupBy(*meta).pivot(concept, concepts).agg(F.max(F.lit(1))).fillna(0, concepts)


def coverage(rows: DataFrame, language: str, concept: str) -> DataFrame:
    """Mean share of concepts that a language has, in per cent."""
    pairs = rows.select(language, concept).dropna().distinct()
    return pairs.agg(F.round(F.count(F.lit(1)) * 100.0 / (F.count_distinct(language) * F.count_distinct(concept)), 1).alias("coverage"))


def last_turns(sessions: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return sessions.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")

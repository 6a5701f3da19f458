"""The engine as one object: what a service offers over a set of tables, as methods that give DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lexicon import Lexicon
from .functions.text import like_any_case
from .operators import documents as D
from .operators import evidence as E
from .operators import indexing as I
from .operators import lexical as X
from .operators import repository as R
from .operators import search as S
from .operators import store
from .operators import tiles as V
from .sources import extraction
from .tools import State, turn

#: Kinds of data, of which the first has a star of tables and the others one flat table each.
DATA_TYPES = ("spoken_language", "sign_language", "archaeology", "genetics")


@dataclass
class Engine:
    """Tables by name: languages, forms, parameters; a flat table under each other kind of data; and the repository's."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    model: str = ""
    version: str = ""
    embed: Callable | None = None
    lexicon: Lexicon = field(default_factory=Lexicon)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    # Lexical data

    def _star(self, glosses: Sequence[str] | None = None) -> DataFrame:
        return X.star(self["languages"], self["forms"], self["parameters"], list(glosses) if glosses else None)

    def _rows(self, data_type: str, dataset: str, glosses: Sequence[str] | None) -> DataFrame:
        if data_type not in DATA_TYPES:
            raise ValueError(f"data_type must be one of {', '.join(DATA_TYPES)}")
        if data_type != DATA_TYPES[0]:
            return self[data_type]
        rows = self._star(glosses)
        return rows if dataset.startswith("Combined") else rows.filter(F.col("dataset_name") == dataset)

    def catalog(self, glosses: Sequence[str] | None = None) -> DataFrame:
        """(dataset_name, n), with the combined dataset's total."""
        counts = X.catalog_by_gloss(self["languages"], self["forms"], self["parameters"], list(glosses)) if glosses else X.catalog(self["languages"])
        return X.combined_total(counts).union(counts)

    def glosses(self, datasets: Sequence[str] | None = None) -> DataFrame:
        rows = X.gloss_index(self["languages"], self["forms"], self["parameters"])
        rows = rows.filter(F.col("dataset_name").isin(list(datasets))) if datasets else rows
        return rows.select("Concepticon_Gloss").distinct().orderBy("Concepticon_Gloss")

    def schema(self, data_type: str, dataset: str = "Combined") -> DataFrame:
        return X.schema_kinds(self._rows(data_type, dataset, None))

    def data(self, data_type: str, dataset: str = "Combined", search: str | None = None, glosses: Sequence[str] | None = None, form_filter: str | None = None, parameter_filter: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """(a page, the total of all pages)."""
        also = "Description" if data_type != DATA_TYPES[0] else "dataset_name" if dataset.startswith("Combined") else None
        rows = X.json_safe(X.search(self._rows(data_type, dataset, glosses), search, form_filter, parameter_filter, also))
        order = [c for c in ("ID", "parameter_name", "form_value") if c in rows.columns]
        return X.page(rows, order, limit, offset), rows.agg(F.count(F.lit(1)).alias("total"))

    def full_data(self, data_type: str, dataset: str = "Combined", glosses: Sequence[str] | None = None) -> DataFrame:
        rows = X.located(self._rows(data_type, dataset, glosses))
        return rows.select(*[c for c in ("ID", "Glottocode", "Latitude", "Longitude", "form_value", "parameter_name", "dataset_name") if c in rows.columns])

    def tile(self, data_type: str, dataset: str, z: int, x: int, y: int, form_filter: str | None = None, parameter_filter: str | None = None, search: str | None = None) -> DataFrame:
        """(tile): forms and concepts meet the languages only if one of them is asked for."""
        if data_type == DATA_TYPES[0]:
            rows = X.tile_rows(self["languages"], self["forms"], self["parameters"], form_filter, parameter_filter, search)
            rows = rows if dataset.startswith("Combined") else rows.filter(F.col("dataset_name") == dataset)
        else:
            rows = X.search(self[data_type], search, also="Description")
        b = X.tile_bounds(self.spark.createDataFrame([(z, x, y)], "z int, x int, y int")).first()
        return V.one_tile(rows.withColumn("dataset", F.lit(dataset)), (b.west, b.south, b.east, b.north), dataset)

    def concepts(self, query: str) -> DataFrame:
        return self["parameters"].filter(like_any_case(F.col("Concepticon_Gloss"), query)).select("Concepticon_Gloss").distinct().orderBy("Concepticon_Gloss")

    def chat(self, state: State, message: str, llm: Callable[[list[dict]], str], upload: str | None = None):
        return turn(self.spark, state, message, llm, self.tables, upload)

    # Materials

    def constants(self) -> DataFrame:
        return R.constants(self.spark)

    def materials(self, **filters) -> tuple[DataFrame, DataFrame]:
        return R.list_materials(self["materials"], self["files"], self["observations"], **filters)

    def material(self, material_id) -> DataFrame:
        found = store.existing(self["materials"], "id", material_id, "Material")
        return R.with_file_count(found, self["files"].filter(F.col("material_id") == material_id))

    def create_material(self, values: Mapping, now: str) -> None:
        self.tables["materials"] = store.insert(self["materials"], [store.validated("material", values)], {"status": "uploaded", "created_at": now, "updated_at": now})

    def update_material(self, material_id, changes: Mapping, now: str) -> None:
        store.existing(self["materials"], "id", material_id, "Material")
        self.tables["materials"] = store.update(self["materials"], "id", material_id, store.validated("material", changes), now)

    def delete_material(self, material_id) -> None:
        store.existing(self["materials"], "id", material_id, "Material")
        self.tables |= store.delete_material(self.tables, material_id)

    def collections(self) -> DataFrame:
        return R.collection_counts(self["materials"])

    def files(self, material_id) -> DataFrame:
        return store.without_internal(store.listing(self["files"].filter(F.col("material_id") == material_id), "files"))

    def add_files(self, files: DataFrame) -> None:
        """files: as the table, with their size; those that may not be stored are left out."""
        self.tables["files"] = self["files"].unionByName(store.uploads(files), allowMissingColumns=True)

    # Text

    def extract(self, material_id, contents: DataFrame, most: int = 1000, force: bool = False) -> tuple[DataFrame, DataFrame]:
        """(segments, warnings) of a material's files. contents: id, material_id, original_filename, content, uploaded_at. A material that has segments is an error without `force`."""
        if not force and not self["segments"].filter(F.col("material_id") == material_id).isEmpty():
            raise ValueError("This material already has extracted text. Use force to extract it again.")
        own = contents.filter(F.col("material_id") == material_id)
        segments, warnings = extraction.extract(own)
        return store.capped(segments.withColumn("chunk", F.struct("page_index", "page_ref")), own.select("id", "uploaded_at"), most).drop("chunk"), warnings

    def extract_ready(self, contents: DataFrame, limit: int = 25) -> tuple[DataFrame, DataFrame]:
        """(segments, warnings) of the next materials that are ready, all in one job; a broken file is a warning, not an error."""
        queue = R.ready_queue(self["materials"], limit).select(F.col("id").alias("q"))
        return extraction.extract(contents.join(F.broadcast(queue), F.col("material_id") == F.col("q"), "left_semi"))

    def extraction_status(self) -> DataFrame:
        return R.extraction_status(self["materials"], self["runs"], self["segments"])

    def auto_keywords(self, stop: list[str], limit: int = 12) -> DataFrame:
        return D.material_keywords(self["segments"], stop, limit)

    def search(self, query: str, material_id=None, limit: int = 50) -> DataFrame:
        return S.full_text(self["segments"], self["materials"], query, material_id, limit)

    def report(self, query: str, window: int = 1, most: int = 200, material_id=None) -> DataFrame:
        return E.context_report(self["segments"], self["materials"], query, window, most, material_id, self.lexicon)

    # Search by meaning; without a model of the caller every answer is empty, and none is an error

    def index_status(self) -> DataFrame:
        return R.index_status(self["segments"], self["segment_embeddings"], self["images"], self["image_embeddings"], self.model, self.version)

    def index_segments(self, **options) -> None:
        self.tables["segment_embeddings"] = I.index_segments(self["segments"], self["segment_embeddings"], self.model, self.embed, **options)

    def index_images(self, **options) -> DataFrame:
        images, vectors, counters = I.index_images(self["images"], self["image_embeddings"], self["segments"], self["observations"], self.model, self.version, self.embed, **options)
        self.tables |= {"images": images, "image_embeddings": vectors}
        return counters

    def _vector(self, text: str) -> list[float] | None:
        if self.embed is None:
            return None
        v = [float(x) for x in self.embed([text[: I.TEXT_LIMIT]])[0]]
        length = sum(x * x for x in v) ** 0.5
        return [x / length for x in v] if length else v

    def semantic_search(self, query: str, material_id=None, limit: int = 12) -> DataFrame:
        v = self._vector(query)
        found = S.semantic(self["segment_embeddings"], self["segments"], self["materials"], v or [0.0], self.model, material_id, limit)
        return found if v else found.limit(0)

    def image_search(self, query: str, material_id=None, limit: int = 12) -> DataFrame:
        v = self._vector(query)
        found = S.image_search(self["image_embeddings"], self["images"], self["materials"], self["observations"], query, v or [0.0], self.model, self.version, material_id, limit)
        return found if v else found.limit(0)

    def multimodal_search(self, query: str, **options) -> DataFrame:
        return S.multimodal(self.semantic_search(query, **options), self.image_search(query, **options))

    def evidence_report(self, query: str, **options) -> DataFrame:
        return S.evidence_report(self.semantic_search(query, **options), self.image_search(query, **options), query, self.lexicon)

    def ask(self, question: str, answer: Callable[[str, str], str], limit: int = 8) -> str:
        return S.ask(self.semantic_search(question, limit=limit), question, answer)

    # Observations

    def observations(self, material_id, kind: str | None = None, limit: int = 100) -> DataFrame:
        rows = self["observations"].filter(F.col("material_id") == material_id)
        rows = rows if kind is None else rows.filter(F.col("observation_type") == kind)
        return store.listing(rows, "observations", limit)

    def create_observation(self, values: Mapping, now: str) -> None:
        """A new observation, its place and quote from its segment and image; the image's embedding goes, as it is out of date."""
        store.existing(self["materials"], "id", values.get("material_id"), "Material")
        empty = self["observations"].limit(0)
        new = store.insert(empty, [store.validated("observation", values)], {"created_at": now, "updated_at": now} if "created_at" in empty.columns else {"updated_at": now})
        for column, parents in (("source_segment_id", "segments"), ("source_image_id", "images")):
            store.check_owned(new, self[parents], column)
        self.tables["observations"] = self["observations"].unionByName(R.observation_defaults(new, self["segments"], self["images"]))
        self.tables["image_embeddings"] = store.invalidate_images(self["image_embeddings"], store.affected_images(new))

    def update_observation(self, observation_id, changes: Mapping, now: str) -> None:
        old = store.existing(self["observations"], "id", observation_id, "Observation")
        new = store.update(old, "id", observation_id, changes, now)
        for column, parents in (("source_segment_id", "segments"), ("source_image_id", "images")):
            store.check_owned(new, self[parents], column)
        self.tables["observations"] = store.update(self["observations"], "id", observation_id, changes, now)
        self.tables["image_embeddings"] = store.invalidate_images(self["image_embeddings"], store.affected_images(old, new))

    def delete_observation(self, observation_id) -> None:
        old = store.existing(self["observations"], "id", observation_id, "Observation")
        self.tables["observations"] = self["observations"].filter(F.col("id") != observation_id)
        self.tables["image_embeddings"] = store.invalidate_images(self["image_embeddings"], store.affected_images(old))

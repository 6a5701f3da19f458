"""Tables as csv text: read, described, repaired, written; and datasets' files checked, migrated and indexed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Files and columns of a word-list dataset, columns of a repaired table, and what names they are known by.
WORDLIST = {"languages": ("ID", "Name", "Latitude", "Longitude"), "forms": ("ID", "Language_ID", "Parameter_ID", "Value"), "parameters": ("ID", "Name", "Concepticon_Gloss")}
NEEDED = ("Concept", "Form", "Latitude", "Longitude")
NAMES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("Form", ("form",), ""), ("Concept", ("concept", "gloss", "parameter", "param"), ""), ("Glottocode", ("glottocode", "glotto"), ""),
    ("LangID", ("langid",), ""), ("Latitude", ("lat",), "y"), ("Longitude", ("lon", "lng", "long"), "x"),
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A csv file with a header; types as its values have them."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def parse_csv(spark: SparkSession, text: str) -> DataFrame:
    """A table that is held as csv text."""
    import io

    import pandas as pd

    if not (text or "").strip():
        raise ValueError("Empty CSV data")
    table = pa.Table.from_pandas(pd.read_csv(io.StringIO(text.strip())), preserve_index=False)
    return spark.createDataFrame(table)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): the rows as csv text, one a row, without a header; made by the executors."""
    return df.select(F.to_csv(F.struct("*")).alias("line"))


def csv_text(df: DataFrame) -> str:
    """The whole table as csv text with a header: for tables that fit the driver, as tools hand them on."""
    return df.toPandas().to_csv(index=False)


def csv_row_count(text: Column) -> Column:
    """Line ends in csv text."""
    return F.regexp_count(text, F.lit("\n"))


def arrow_stream(df: DataFrame) -> bytes:
    """The rows as one Arrow IPC stream; no rows give a stream of the schema alone."""
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def coordinate_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """The columns named latitude and longitude, in any case."""
    find = lambda name: next((c for c in columns if c.lower() == name), None)
    return find("latitude"), find("longitude")


def standard_names(columns: Sequence[str]) -> dict[str, str]:
    """What columns are renamed to: by parts of their names, each standard name once, in the order of NAMES."""
    out: dict[str, str] = {}
    for c in columns:
        low = c.strip().lower()
        for name, parts, exact in NAMES:
            if name not in out.values() and (any(p in low for p in parts) or exact and low == exact):
                out[c] = name
                break
    return out


def missing_columns(columns: Sequence[str]) -> list[str]:
    out = [c for c in NEEDED if c not in columns]
    return out if {"Glottocode", "LangID"} & set(columns) else [*out, "Glottocode or LangID"]


def normalised(df: DataFrame) -> DataFrame:
    """df under standard names, of columns that get one name the first; an error names what is missing."""
    names = standard_names(df.columns)
    taken: dict[str, str] = {}
    for c in df.columns:
        taken.setdefault(names.get(c, c.strip()), c)
    if missing := missing_columns(list(taken)):
        raise ValueError(f"Normalization failed. Missing required columns: {', '.join(missing)}.")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in taken.items()])


def preview(df: DataFrame, n: int = 5) -> tuple[list[str], int, list[dict]]:
    """(columns, number of rows, the first n rows)."""
    return df.columns, df.count(), [r.asDict() for r in df.limit(n).collect()]


def keep_first(names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(names))


def readable(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Those of the named Parquet paths that are there."""
    out = {}
    for name, path in paths.items():
        try:
            out[name] = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return out


def wordlist_faults(tables: Mapping[str, DataFrame]) -> list[str]:
    """What a word-list dataset lacks: tables, and columns of those it has."""
    out = [f"missing table: {t}" for t in WORDLIST if t not in tables]
    return out + [f"{t}: missing column {c}" for t, cs in WORDLIST.items() if t in tables for c in cs if c not in tables[t].columns]


def migrate(spark: SparkSession, sources: Mapping[str, str], folder: str) -> list[str]:
    """Writes each csv source (name -> path) as Parquet under `folder`; those already there stay. Gives the names written.

    A write counts when its success mark is there, so one cut off is done again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    written = []
    for name, path in sources.items():
        at = f"{folder.rstrip('/')}/{name}.parquet"
        done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            read_csv(spark, path).write.mode("overwrite").parquet(at)
            written.append(name)
    return written


def write_gloss_index(index: DataFrame, folder: str, kind: str = "parquet") -> None:
    """The index (dataset_name, Concepticon_Gloss) and its distinct glosses, sorted, as two tables."""
    pairs = index.dropna().filter("Concepticon_Gloss <> ''").distinct()
    for name, df in (("gloss_index", pairs.orderBy("dataset_name", "Concepticon_Gloss")), ("glosses", pairs.select("Concepticon_Gloss").distinct().orderBy("Concepticon_Gloss"))):
        df.write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {})).save(f"{folder.rstrip('/')}/{name}")


def synthetic(spark: SparkSession, languages: int = 50, parameters: int = 10, flat: int = 100, seed: int = 1) -> dict[str, DataFrame]:
    """A star of made-up languages, forms and parameters, and a flat table; the same for the same numbers."""
    hashed = lambda c, salt, n: F.pmod(F.xxhash64(F.col(c), F.lit(salt + seed)), F.lit(n))
    place = lambda c: {"Latitude": hashed(c, 11, 12000) / 100 - 60, "Longitude": hashed(c, 13, 36000) / 100 - 180}
    l = spark.range(1, languages + 1).withColumnRenamed("id", "ID").withColumns({"Name": F.concat(F.lit("Language "), "ID"), "Glottocode": F.format_string("lang%04d", "ID"), **place("ID")})
    p = spark.range(1, parameters + 1).withColumnRenamed("id", "ID").withColumns({"Name": F.concat(F.lit("concept "), "ID"), "Concepticon_Gloss": F.concat(F.lit("GLOSS "), "ID")})
    pairs = l.select(F.col("ID").alias("Language_ID"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(parameters).cast("long"))).alias("Parameter_ID"))
    f = pairs.select(((F.col("Language_ID") - 1) * parameters + F.col("Parameter_ID")).alias("ID"), "Language_ID", "Parameter_ID", F.concat(F.lit("form"), hashed("Language_ID", 17, 97), F.lit("-"), "Parameter_ID").alias("Value"))
    d = spark.range(1, flat + 1).withColumnRenamed("id", "ID").withColumns({"Name": F.concat(F.lit("site "), "ID"), "Description": F.concat(F.lit("made up "), hashed("ID", 19, 9)), **place("ID")})
    return {"languages": l, "parameters": p, "forms": f, "flat": d}

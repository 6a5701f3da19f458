"""What the operators share: word pattern, shared storage, and rows picked by a verdict."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space and words as the operators' contracts define them (ASCII space and 0x09 to 0x0D).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the Python workers through Spark's file server, once for each application."""
    if _shipped.get("to") == spark.sparkContext.applicationId:
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    at = pathlib.Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped["to"] = spark.sparkContext.applicationId


_shipped: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session takes a temporary one; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/glossalake-shared"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage, survives lost executors, evaluates once.

    The files go when the application's JVM ends.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    path = f"{root}/{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as (k_id, k_text, row): a key of id and text digest, and the whole row as a struct, so no name can clash."""
    return docs.select(F.col(id_col).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_text"), F.struct("*").alias("row"))


def numbered(keyed: DataFrame, *first: Column) -> DataFrame:
    """Numbers the rows of each (k_id, k_text), so repeated rows stay apart; k_no starts at 1."""
    return keyed.withColumn("k_no", F.row_number().over(Window.partitionBy("k_id", "k_text").orderBy(*(first or [F.lit(0)]))))


def pick(docs: DataFrame, verdicts: DataFrame, copies: str | None = None) -> DataFrame:
    """The rows of docs that verdicts (k_id, k_text[, copies]) keeps, each as often as `copies` says, once without it.

    Repeated rows are paired off one by one. Both sides are dealt by the same key, so the text moves once.
    """
    right = numbered(verdicts.select("k_id", "k_text", *([F.col(copies).alias("k_copies")] if copies else [])))
    left = numbered(row_key(docs))
    on = left["k_id"].eqNullSafe(right["k_id"]) & (left["k_text"] == right["k_text"]) & (left["k_no"] == right["k_no"])
    if not copies:
        return left.join(right, on, "left_semi").select("row.*")
    both = left.join(right.filter("k_copies > 0"), on).select("row", "k_copies")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("k_copies").cast("int")))).select("row.*")

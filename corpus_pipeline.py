"""The corpus pipeline: toxicity, exact copies, near copies, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossalake.llm.common import materialise, table
from glossalake.llm.encoding import encode_documents
from glossalake.llm.exact_dedup import drop_copies
from glossalake.llm.mixing import mix
from glossalake.llm.simhash import drop_near_copies
from glossalake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, the document with the smallest id."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the fair queue takes it: not at all, once or twice."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document taken."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Fingerprints, the learned grammar and the segmentation have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again before the next. Null texts and ids pass through; empty documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs

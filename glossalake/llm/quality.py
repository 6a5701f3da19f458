"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, table
from .prefix import global_prefix

BUCKETS = 10_000
#: The target model is fitted on about so many labelled documents of quality 1, chosen by a hash of the id: 160 kB of ids.
MAX_TARGET = 20_000
SEED = 20
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_CACHE = 400_000


class Hasher:
    """Buckets of a text's words and word pairs; lower case for A-Z."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh32_intdigest

        known = self.known
        words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
        if len(known) > _CACHE:
            known.clear()
        one = []
        for w in words:
            h = known.get(w)
            if h is None:
                known[w] = h = xxh32_intdigest(w, SEED)
            one.append(h)
        one = np.array(one, np.uint64)
        pair = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
        pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
        return (np.concatenate([one, pair]) % np.uint64(self.buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents, and over those whose id is in target (t_id). Each task sends one row a bucket."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, sums = Hasher(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(hashed(text), minlength=buckets)
                sums[0] += n
                if mine:
                    sums[1] += n
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "n_raw", "n_target"])

    # target is at most MAX_TARGET ids or so: its size is bounded by a parameter.
    flagged = docs.join(F.broadcast(target), F.col("doc_id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("mine"))
    sums = flagged.mapInArrow(count, "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw"), F.sum("n_target"))
    out = np.zeros((2, buckets))
    for b, raw, mine in sums.collect():  # one row a bucket
        out[:, b] = raw, mine
    return out[0], out[1]


def importance(docs: DataFrame, labels: DataFrame, keep: float | None = None, max_target: int = MAX_TARGET, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, n_grams, log_ratio, gumbel_key, kept.

    log_ratio is the log of target model over raw model, summed over the hashed words and word pairs of the whole
    text. The raw model counts all documents, the target model labelled ones of quality 1; both are smoothed by one count
    a bucket. Gumbel noise drawn from a hash of id and seed is added, and the k largest keys are kept: a sample without
    replacement by importance. k is `keep` times the rows, rounded; without it, the share of quality 1 among labels.
    Null and empty texts have ratio 0; very long ones are counted and scored whole. Rows of one id draw the same noise, so rows repeated in full
    tie, and ties go by id, then number of n-grams. Without labels both models are flat
    and all rows are kept. An empty table gives no rows. Other columns are not read.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    share = good / n if n else 1.0
    cut = int(min(1.0, max_target / max(1, good)) * (1 << 20))
    target = known.filter("quality = 1").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut).select(F.col("doc_id").alias("t_id"))
    docs = docs.select("doc_id", "text")
    raw, mine = ngram_counts(docs, target, buckets)
    ratio = np.log((mine + 1) / (mine.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)) if mine.any() else np.zeros(buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(buckets)
        for batch in batches:
            grams = [hashed(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in grams], pa.int64()), pa.array([float(ratio[g].sum()) for g in grams], pa.float64())], ["doc_id", "n_grams", "log_ratio"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 11).cast("double") + 0.5) / float(1 << 53)
    scored = docs.mapInArrow(score, f"doc_id {kind}, n_grams long, log_ratio double").withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(u)))
    scored = materialise(scored.withColumn("down", -F.col("gumbel_key")).withColumn("one", F.lit(1).cast("long")))
    k = round(scored.count() * (share if keep is None else keep))
    ranked = global_prefix(scored, ["down", "doc_id", "n_grams"], {"rank": "one"})
    return ranked.select("doc_id", "n_grams", "log_ratio", "gumbel_key", (F.col("rank") < k).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The ids that stay."""
    return importance(docs, labels, **options).filter("kept").select("doc_id")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

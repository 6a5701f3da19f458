"""SimHash near-deduplication with deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialise, pick, ship, table
from .components import connected_components

_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text: bit set if over half of the shingles' XXH64 (seed 42) have it. Whole text, bounded memory."""
    from xxhash import xxh64_intdigest

    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1]
    ends = ends[width - 1 :]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)]
        votes += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series(np.array([fingerprint(x) for x in part], np.uint64).view(np.int64))


def near_links(prints: DataFrame, hot: int = 512) -> DataFrame:
    """(a, b): all pairs a < b of the column fp, distinct longs, that differ in 1 to 3 bits.

    Cut into two 32-bit halves, a pair within 3 bits has a half with at most one differing bit. Each fingerprint is
    indexed under 32 variants of either half, each with one bit cleared as a wildcard. A pair whose half
    differs in bit i meets under variant i; one whose half is equal is taken under variant 0 only. The distance is
    part of the join's condition, so only links leave it. A variant that more than `hot` fingerprints share
    is dealt further by the other half's four bytes, of which one at least is equal: exact, and no bucket is capped.
    """
    rows = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(32))).alias("half")).select("fp", "half", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    # Variant, wildcard and half in one long: 32 + 6 + 1 bits.
    tag = F.expr("(((shiftrightunsigned(fp, half) & 4294967295) & ~shiftleft(1L, bit)) * 64 + bit) * 2 + half div 32")
    keyed = rows.select("fp", tag.alias("tag"))
    # Written, as its size then decides between broadcast and shuffle before the index moves.
    crowded = materialise(keyed.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select(F.col("tag").alias("t")))

    def meet(side: DataFrame, keys: list[str]) -> DataFrame:
        left, right = (side.select(*[F.col(c).alias(f"{p}_{c}") for c in ["fp", *keys]]) for p in "ab")
        on = F.col("a_fp") < F.col("b_fp")
        for k in keys:
            on &= F.col(f"a_{k}") == F.col(f"b_{k}")
        near = F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= 3
        once = F.expr("CASE (shiftrightunsigned(a_fp ^ b_fp, CAST(a_tag % 2 * 32 AS INT)) & 4294967295) WHEN 0 THEN a_tag div 2 % 64 = 0 ELSE true END")
        # Spark takes a table for no larger by explode(), and would send 64 rows a fingerprint through the driver to every task.
        return left.join(right.hint("merge"), on & near & once).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))

    plain = meet(keyed.join(crowded, F.col("tag") == F.col("t"), "left_anti"), ["tag"])
    hot_rows = keyed.join(crowded, F.col("tag") == F.col("t"), "left_semi").withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(3))))
    dealt = hot_rows.withColumn("value", F.expr("shiftrightunsigned(fp, CAST(32 - tag % 2 * 32 + byte * 8 AS INT)) & 255"))
    return plain.union(meet(dealt, ["tag", "byte", "value"])).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, k_text, fingerprint (16 hex digits), component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id reachable. Documents with
    equal fingerprints are one node, so groups of copies cost one index entry. Null and empty texts and texts of
    white space have fingerprint 0 and link like any other. Null ids are never the smallest; a component of null ids
    only has a null component. An empty table gives no rows. Other columns are not read.
    """
    return _labelled(docs, id_col, text_col).drop("component")


def _labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_groups() with the component's smallest fingerprint, which names it whatever the ids."""
    ship(docs.sparkSession)
    marked = materialise(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k_text"), _fingerprints(F.col(text_col)).alias("fp")))
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = connected_components(near_links(nodes.select("fp")))
    of = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labelled = of.join(least, "component").select(F.col("fp").alias("n_fp"), "component_id", "component")
    return marked.join(labelled, F.col("fp") == F.col("n_fp")).select("doc_id", "k_text", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then text digest; a null id comes last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k_text")).alias("first")
    kept = _labelled(docs).groupBy("component").agg(first)
    return pick(docs, kept.select(F.col("first.doc_id").alias("k_id"), F.col("first.k_text").alias("k_text")))


def op9_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("k_text")

"""Incremental upkeep as Structured Streaming queries; each batch can run again without changing the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from ..operators.indexing import Embed, embedded, token_table

#: Seconds that a session lives after its last write; fixed value.
TTL = 21_600


def _by_batch(folder: str, name: str, rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writes what `rows` makes of a batch to a folder of the batch's own: a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows(batch).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/batch={number}")

    return write


def embedding_stream(segments: DataFrame, folder: str, model: str, embed: Embed) -> DataStreamWriter:
    """Embeds segments as they come: segments (id, material_id, content_text), a stream; one row an id and batch."""

    def rows(batch: DataFrame) -> DataFrame:
        new = batch.dropDuplicates(["id"]).select(F.col("id").alias("segment_id"), "material_id", F.lit(model).alias("model"), "content_text")
        return embedded(new, "content_text", embed).drop("content_text")

    return segments.writeStream.foreachBatch(_by_batch(folder, "segment_embeddings", rows))


def token_stream(segments: DataFrame, folder: str) -> DataStreamWriter:
    """Adds the tokens of segments as they come to an inverted index."""
    return segments.writeStream.foreachBatch(_by_batch(folder, "tokens", token_table))


def latest(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """What a stream's folder holds, of each key the rows of the last batch that had it."""
    rows = spark.read.option("basePath", f"{folder.rstrip('/')}/{name}").parquet(f"{folder.rstrip('/')}/{name}/batch=*")
    return rows.withColumn("last", F.max("batch").over(Window.partitionBy(key))).filter("batch = last").drop("batch", "last")


def live_sessions(events: DataFrame, now: DataFrame, ttl: int = TTL) -> DataFrame:
    """(session_id, state, saved_at): the last state of each session, unless it is `ttl` seconds old. events: session_id, state, saved_at; now: one row, the time."""
    last = events.groupBy("session_id").agg(F.max_by(F.struct("state", "saved_at"), F.struct("saved_at", "state")).alias("l")).select("session_id", "l.*")
    time = now.select(F.col(now.columns[0]).cast("timestamp").alias("t_now"))
    live = last.join(F.broadcast(time)).filter(F.col("saved_at").cast("timestamp") + F.make_dt_interval(secs=F.lit(ttl)) > F.col("t_now"))  # one row
    return live.drop("t_now")


def session_stream(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """(session, turns, first, last) of sessions that `ttl` seconds without a turn end; a stream of (session_id, saved_at) with a watermark of that length."""
    seconds = f"{ttl} seconds"
    return events.withWatermark("saved_at", seconds).groupBy("session_id", F.session_window("saved_at", seconds).alias("session")).agg(F.count(F.lit(1)).alias("turns"), F.min("saved_at").alias("first"), F.max("saved_at").alias("last"))


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, at): where each job stands, by its last event; an end is not undone by an event of the same time."""
    rank = F.array_position(F.array(*map(F.lit, ("queued", "running", "error", "done"))), F.col("status"))
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("at", rank.alias("rank"))).alias("status"), F.max("at").alias("at"))

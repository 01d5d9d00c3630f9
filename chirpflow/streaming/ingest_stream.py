"""Structured Streaming ingest of embedded-post JSON lines.

The reference reads a JSONL file line by line and flushes bulk requests of 100
documents. Here a folder of JSON-lines files is a file stream: lines are parsed with the
fixed schema (bad lines kept as corrupt records), tagged, and freed of posts that an
earlier batch of the stream already delivered: the ids of the last ``keep`` days (by the
files' modification time) live in the stream's state store, so a file that arrives twice
adds nothing. ``foreachBatch`` stores accepted rows and rejects by one commit under the
batch's number: a batch that runs again after a failure is not written again. The
reject-rate guard applies per micro-batch, as it did per bulk request, and fails the
batch before anything of it is written. ``availableNow`` processes what is there and
stops. For many ids set the session's state store to RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.operators.ingest import (
    CORRUPT,
    JSON_OPTIONS,
    MAX_REJECT_RATE,
    VECTOR_DIM,
    check_reject_rate,
    compact_posts,
    reject_reason,
    store,
)
from chirpflow.schemas import POST_COLUMNS, POSTS_JSONL

#: How long the ids of delivered posts are remembered.
KEEP = "30 days"


def tagged_once(lines: DataFrame, dim: int, keep: str = KEEP) -> DataFrame:
    """Parsed lines with ``reject_reason``, each post and each rejected line once within ``keep`` of its
    first delivery. A post is its id, or without an id its whole content; a rejected line never stands
    in for a good one of the same id."""
    tagged = lines.withColumn("reject_reason", reject_reason(dim))
    content = F.sha2(F.to_json(F.struct(*POST_COLUMNS, "full_text_vector", CORRUPT)), 256)
    good = F.coalesce(F.concat(F.lit("id "), F.col("tweet_id")), content)
    key = F.when(F.col("reject_reason").isNull(), good).otherwise(F.concat(F.lit("reject "), content))
    return tagged.withColumn("_key", key).withWatermark("_delivered", keep).dropDuplicatesWithinWatermark(["_key"])


def _batch_writer(table_path: str, quarantine_path: str, max_reject_rate: float, run: str = "run", compact_every: int = 0):
    """foreachBatch body over tagged rows. foreachBatch is at-least-once; the manifest makes it exactly once
    (``run`` names the stream: another stream into the same table counts its batches from 0 as well)."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        tagged = batch.drop("_key", "_delivered").persist()
        try:
            c = tagged.agg(F.count(F.lit(1)).alias("n"), F.count("reject_reason").alias("bad")).first()
            if not c["n"]:
                return
            check_reject_rate(c["n"], c["bad"], max_reject_rate)
            counts = {"total": c["n"], "accepted": c["n"] - c["bad"], "rejected": c["bad"]}
            store(tagged, table_path, quarantine_path, f"{run}-{epoch_id}", counts)
        finally:
            tagged.unpersist()
        if compact_every and epoch_id % compact_every == compact_every - 1:
            compact_posts(batch.sparkSession, table_path)

    return write


def ingest_stream(
    spark: SparkSession,
    in_dir: str,
    table_path: str,
    quarantine_path: str,
    checkpoint: str,
    dim: int = VECTOR_DIM,
    max_reject_rate: float = MAX_REJECT_RATE,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    keep: str = KEEP,
    compact_every: int = 0,
):
    """Start the ingest stream; returns the StreamingQuery (call awaitTermination).

    ``compact_every``: after so many batches the months are rewritten into few files (0: never)."""
    reader = spark.readStream.schema(POSTS_JSONL).options(**JSON_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.json(in_dir).select("*", F.col("_metadata.file_modification_time").alias("_delivered"))
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = (
        tagged_once(lines, dim, keep)
        .writeStream.foreachBatch(_batch_writer(table_path, quarantine_path, max_reject_rate, run, compact_every))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()

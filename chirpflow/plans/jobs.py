"""End-to-end jobs: embed a posts CSV, ingest embedded posts, search them.

These are the reference's command sequence (embed -> ingest -> search) as Spark
jobs over files; each step is a lazy DataFrame plan written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chirpflow.functions.text import is_blank
from chirpflow.operators import clean, embed, ingest, manifest, search
from chirpflow.sources import posts as posts_src


def embed_posts_job(
    spark: SparkSession,
    csv_path: str,
    out_path: str,
    encoder: embed.EncoderFactory | None = None,
    fmt: str = "json",
    max_chars: int | None = None,
) -> dict:
    """Posts CSV -> non-blank texts (whole, or cut to ``max_chars``) -> vectors -> JSON lines (or Parquet).

    Row counters (rows read, rows with text) are observed on the write itself.
    """
    encoder = encoder or embed.sentence_transformer_encoder()
    raw = posts_src.read_posts_csv(spark, csv_path)
    obs_in = Observation("read")
    raw = raw.observe(obs_in, F.count(F.lit(1)).alias("total_rows"), F.count_if(is_blank("full_text")).alias("blank"))
    embedded = embed.embed(clean.clean_posts(raw, max_chars=max_chars), encoder)
    obs_out = Observation("written")
    embedded = embedded.observe(obs_out, F.count(F.lit(1)).alias("processed_rows"))
    if fmt == "json":
        posts_src.write_posts_jsonl(embedded, out_path)
    else:
        posts_src.write_parquet(embedded, out_path)
    return {**obs_in.get, **obs_out.get}


def resumable_embed_job(
    spark: SparkSession,
    csv_path: str,
    out_path: str,
    encoder: embed.EncoderFactory | None = None,
    waves: int = 16,
    max_chars: int | None = None,
) -> dict:
    """``embed_posts_job`` in waves, each committed when it is written: a job that is killed and started
    again encodes only what no committed wave holds.

    The cleaned posts are staged once (by the hash of their content into ``waves`` parts; the staging
    itself is a commit), then every open part is embedded by one Spark job. Inside a task texts come in
    order of length, so that a batch of the encoder holds texts of similar length.
    ``read_embedded`` reads what is committed. -> {'total_rows', 'processed_rows', 'waves_run'}
    """
    encoder = encoder or embed.sentence_transformer_encoder()
    stage, done = f"{out_path}/_staged", f"{out_path}/vectors"
    staged = manifest.entry(spark, stage, "staged")
    if staged is None:
        part = manifest.new_part("staged")
        seen, kept = Observation("read"), Observation("kept")
        raw = posts_src.read_posts_csv(spark, csv_path).observe(seen, F.count(F.lit(1)).alias("n"))
        posts = clean.clean_posts(raw, max_chars=max_chars).observe(kept, F.count(F.lit(1)).alias("n"))
        wave = F.pmod(F.xxhash64(*posts.columns), F.lit(waves)).cast("int")
        posts.withColumn("wave", wave).write.partitionBy("wave").parquet(f"{stage}/{part}")
        counts = {"total": seen.get["n"], "accepted": kept.get["n"], "stored": waves}
        staged = manifest.commit(spark, stage, {"batch_id": "staged", "part": part, "mode": "append", **counts})
    posts = spark.read.parquet(f"{stage}/{staged['part']}")
    finished = {r["batch_id"] for r in manifest.versions(spark, done)}
    run = 0
    for w in range(staged["stored"]):
        if f"wave-{w}" in finished:
            continue
        part, seen = manifest.new_part(f"wave-{w}"), Observation("written")
        rows = posts.where(F.col("wave") == w).drop("wave").hint("rebalance").sortWithinPartitions(F.length("full_text"))
        embedded = embed.embed(rows, encoder).observe(seen, F.count(F.lit(1)).alias("n"))
        posts_src.write_posts_jsonl(embedded, f"{done}/{part}")
        manifest.commit(spark, done, {"batch_id": f"wave-{w}", "part": part, "mode": "append", "stored": seen.get["n"]})
        run += 1
    stored = sum(r["stored"] for r in manifest.versions(spark, done))
    return {"total_rows": staged["total"], "processed_rows": stored, "waves_run": run}


def read_embedded(spark: SparkSession, out_path: str) -> DataFrame:
    """The committed JSON lines of ``resumable_embed_job``."""
    done = f"{out_path}/vectors"
    return ingest.read_posts_jsonl(spark, [f"{done}/{p}" for p in manifest.visible_parts(spark, done)])


def ingest_job(
    spark: SparkSession,
    jsonl_path: str,
    table_path: str,
    quarantine_path: str,
    dim: int = ingest.VECTOR_DIM,
    mode: str = "append",
    batch_id: str | None = None,
) -> dict:
    """Embedded-posts JSON lines -> validated posts table + quarantine (see ``ingest.ingest``)."""
    lines = ingest.read_posts_jsonl(spark, jsonl_path)
    return ingest.ingest(lines, table_path, quarantine_path, dim=dim, mode=mode, batch_id=batch_id)


def search_job(
    spark: SparkSession,
    table_path: str,
    queries: DataFrame,
    mode: str = "knn",
    size=search.DEFAULT_SIZE,
    k=search.DEFAULT_K,
    encoder: embed.EncoderFactory | None = None,
) -> DataFrame:
    """Search the posts table with a table of queries; result rows per query."""
    corpus = ingest.read_posts_table(spark, table_path)
    return search.search(corpus, queries, mode=mode, size=size, k=k, encoder=encoder)

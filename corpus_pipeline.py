"""A corpus pipeline: five of the training-data operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents: toxic documents go; one document of each near-duplicate group stays;
repeated passages are cut out of the texts (``n_chars`` follows); the sources are mixed
to their target weights (a document appears as often as the mix takes it); the last
stage tokenizes. A row is told from others by doc_id and text, never by doc_id alone:
rows without one and rows that share one are documents like others. Empty tables pass
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.bpe import token_digests
from chirpflow.llm.jaccard_join import one_per_group
from chirpflow.llm.mixing import mixed_documents
from chirpflow.llm.substring_dedup import cut_documents
from chirpflow.llm.toxicity import clean_documents, fit_from_tables
from chirpflow.session import read_table, scratch_path, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold (their label, if any, is never looked at)."""
    ship_package(spark)
    model = fit_from_tables(docs, read_table(spark, sf_dir, "labels"))
    return clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group (see ``one_per_group``)."""
    ship_package(spark)
    return one_per_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under windows that a smaller document has too; a null text stays null."""
    ship_package(spark)
    return cut_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship_package(spark)
    return mixed_documents(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row per mixed document."""
    ship_package(spark)
    return token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The tokenizer's merges and the learned lexicon have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

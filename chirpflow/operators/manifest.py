"""Commits of a table made of parts: what readers see is what the manifest names.

Writers put their rows into folders of a new part and then add one entry to the manifest
(``<table>/_manifest``, a folder that Spark's file listing passes over). An entry is a
one-row Parquet folder ``v<number>``: Spark's output committer makes it appear as a
whole, and writing a number that exists fails, so two writers never share a version. An
entry may replace earlier parts (overwrite, compaction).
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "version long, batch_id string, part string, mode string, replaces array<string>, "
    "total long, accepted long, rejected long, stored long"
)
_COUNTS = ("total", "accepted", "rejected", "stored")


def new_part(name: str) -> str:
    """A part name that no other attempt has."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def _folder(path: str) -> str:
    return os.path.join(path, "_manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, in whatever store Spark reads it from."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def table(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the manifest (none while the table has no commit)."""
    if not _exists(spark, _folder(path)):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(_folder(path))


def versions(spark: SparkSession, path: str) -> list:
    """The entries in order of their version (one row a commit)."""
    return table(spark, path).orderBy("version").collect()


def committed_parts(spark: SparkSession, path: str) -> list[str]:
    return [r["part"] for r in versions(spark, path)]


def visible_parts(spark: SparkSession, path: str) -> list[str]:
    """Committed parts that no later entry replaces."""
    entries = versions(spark, path)
    gone = {p for r in entries for p in r["replaces"] or ()}
    return [r["part"] for r in entries if r["part"] not in gone]


def entry(spark: SparkSession, path: str, batch_id: str) -> dict | None:
    """The committed entry of a batch, or None."""
    rows = table(spark, path).where(F.col("batch_id") == batch_id).limit(1).collect()
    return rows[0].asDict() if rows else None


def commit(spark: SparkSession, path: str, new: dict) -> dict:
    """Add an entry under the next free version and return it; an entry of the same batch that another
    writer committed meanwhile wins (its part stays the visible one)."""
    if (done := entry(spark, path, new["batch_id"])) is not None:
        return done
    known = versions(spark, path)
    version = known[-1]["version"] + 1 if known else 1
    while True:
        row = {"version": version, "replaces": [], **dict.fromkeys(_COUNTS, 0), **new}
        values = [row[name.split()[0]] for name in SCHEMA.split(", ")]
        try:
            one = spark.createDataFrame([tuple(values)], SCHEMA).coalesce(1)
            one.write.mode("error").parquet(os.path.join(_folder(path), f"v{version:09d}"))
            return row
        except AnalysisException as e:  # taken by another writer, or left half-written by one that died
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            version += 1

"""Ingest of embedded posts: tolerant JSON-lines parse, typed validation with a
quarantine, a reject-rate guard, and the write into a fixed-schema table. Table rows
and rejects of a batch become visible by one commit (``operators.manifest``).

Validation never drops data silently: every input line ends up either in the
accepted table or in the quarantine with a ``reject_reason``. Counts come from
``DataFrame.observe`` on the staging write, so the guard costs no extra pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chirpflow.functions.times import iso_utc, parse_timestamp
from chirpflow.operators import manifest
from chirpflow.schemas import POSTS, POSTS_JSONL
from chirpflow.session import written

# --- Fixed values: ingest defaults of the reference ---
VECTOR_DIM = 384
MAX_REJECT_RATE = 0.5     # fail when more than half of the documents are rejected
# --- end of fixed values ---

CORRUPT = "_corrupt_record"

# The one option set of every JSON-lines parser (file, column, stream).
JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
REASONS = ("malformed", "bad_retweet_count", "bad_favorite_count", "bad_vector")


def parse_json_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse a column of JSON text (PERMISSIVE): bad lines keep their text in ``_corrupt_record``.

    Blank lines are skipped. Numeric fields are parsed as strings so a wrong
    type is a typed reject later, not a corrupt line.
    """
    keep = [c for c in lines.columns if c != value_col]
    parsed = lines.where(F.trim(F.col(value_col)) != "").select(
        *keep,
        F.from_json(F.col(value_col), POSTS_JSONL, JSON_OPTIONS).alias("j"),
    )
    # Row counters of the parse (records, corrupt). The observation node also
    # keeps validation filters above the parse: without it Catalyst inlines
    # from_json into every pushed-down predicate and parses each line once per
    # checked field.
    return parsed.select(*keep, "j.*").observe(
        "json_lines", F.count(F.lit(1)).alias("records"), F.count(F.col(CORRUPT)).alias("corrupt")
    )


def read_posts_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines file(s) -> records + ``_corrupt_record`` (splittable, parallel by block)."""
    return (
        spark.read.schema(POSTS_JSONL)
        .options(**JSON_OPTIONS)
        .json(path)
    )


def reject_reason(dim: int = VECTOR_DIM):
    """Column: why a parsed record is rejected (null when it is accepted).

    First failing check of malformed / bad_retweet_count / bad_favorite_count /
    bad_vector (missing, not finite numbers, or not ``dim`` long).
    """
    rt, fav = F.col("retweet_count"), F.col("favorite_count")
    vec = F.transform("full_text_vector", lambda x: x.try_cast("float"))
    bad_vec = (
        F.col("full_text_vector").isNull()
        | (F.size("full_text_vector") != dim)
        | F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return (
        F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed"))
        .when(rt.isNotNull() & rt.try_cast("int").isNull(), F.lit("bad_retweet_count"))
        .when(fav.isNotNull() & fav.try_cast("int").isNull(), F.lit("bad_favorite_count"))
        .when(bad_vec, F.lit("bad_vector"))
    )


def typed_accepted(tagged: DataFrame) -> DataFrame:
    """Accepted rows in the typed posts layout; ``created_at`` stays null when
    unparsable (the row is kept)."""
    raw = ("created_at", "retweet_count", "favorite_count", "full_text_vector", CORRUPT, "reject_reason")
    return tagged.where(F.col("reject_reason").isNull()).select(
        *[c for c in tagged.columns if c not in raw],
        parse_timestamp("created_at").alias("created_at"),
        F.col("retweet_count").try_cast("int").alias("retweet_count"),
        F.col("favorite_count").try_cast("int").alias("favorite_count"),
        F.transform("full_text_vector", lambda x: x.try_cast("float")).alias("full_text_vector"),
    )


def validate_posts(parsed: DataFrame, dim: int = VECTOR_DIM) -> tuple[DataFrame, DataFrame]:
    """Split parsed records into (accepted, rejected).

    accepted: the typed posts schema (see ``typed_accepted``); rejected: the
    raw fields plus ``reject_reason``.
    """
    tagged = parsed.withColumn("reject_reason", reject_reason(dim))
    return typed_accepted(tagged), tagged.where(F.col("reject_reason").isNotNull())


def reject_counts(rejected: DataFrame) -> DataFrame:
    """Rejects per reason -> (reject_reason, n)."""
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def check_reject_rate(n_total: int, n_rejected: int, max_rate: float = MAX_REJECT_RATE) -> None:
    """Fail when more than ``max_rate`` of the documents were rejected (exactly half passes)."""
    if n_total and n_rejected > max_rate * n_total:
        raise RuntimeError(f"too many rejects: {n_rejected} of {n_total} documents")


def created_at_iso(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Replace a timestamp column by its ISO-8601 UTC text ('...T..:..:...SSSZ')."""
    return df.withColumn(col, iso_utc(col))


STORED_POSTS = StructType([*POSTS.fields, StructField("month", StringType()), StructField("part", StringType())])


def read_posts_table(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of the posts table (with its partition column ``month``), also while it holds none."""
    rows = spark.read.schema(STORED_POSTS).parquet(path)
    return rows.where(F.col("part").isin(manifest.visible_parts(spark, path))).drop("part")


def read_quarantine(spark: SparkSession, table_path: str, path: str) -> DataFrame:
    """The committed rejects: raw fields and ``reject_reason``."""
    schema = StructType([*POSTS_JSONL.fields, StructField("reject_reason", StringType()), StructField("part", StringType())])
    if not manifest.versions(spark, table_path):
        return spark.createDataFrame([], schema).drop("part")
    rows = spark.read.schema(schema).parquet(path)
    return rows.where(F.col("part").isin(manifest.committed_parts(spark, table_path))).drop("part")


def create_posts_table(spark: SparkSession, path: str) -> bool:
    """Create an empty posts table with the fixed schema unless one exists; True if created."""
    if manifest.versions(spark, path):
        return False
    part = manifest.new_part("create")
    _write_part(spark.createDataFrame([], POSTS), path, part)
    manifest.commit(spark, path, {"batch_id": "create", "part": part, "mode": "create"})
    return True


def _row_key() -> Column:
    """What makes a post one post: its id, or for rows without an id their whole content."""
    return F.coalesce("tweet_id", F.sha2(F.to_json(F.struct(*POSTS.fieldNames())), 256))


def _new_posts(df: DataFrame, path: str) -> DataFrame:
    """One row per post of the batch (the latest date wins, then the content hash), without those of the table."""
    last = Window.partitionBy("_key").orderBy(F.desc_nulls_last("created_at"), F.xxhash64(*POSTS.fieldNames()))
    out = df.withColumn("_key", _row_key()).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    if manifest.versions(df.sparkSession, path):
        out = out.join(read_posts_table(df.sparkSession, path).select(_row_key().alias("_key")), "_key", "left_anti")
    return out.drop("_key")


def _write_part(df: DataFrame, path: str, part: str) -> int:
    """Write rows into the folders of one part of the table; the number of rows."""
    seen = Observation()
    # few files: a month's rows come together, and a large month is split again by its size
    out = df.select(*POSTS.fieldNames()).withColumn("month", F.date_format("created_at", "yyyy-MM")).hint("rebalance", "month")
    # sorted by id inside each file: Parquet row-group statistics on tweet_id then
    # let id lookups (search result rows) skip almost every row group
    out = out.sortWithinPartitions("month", "tweet_id").withColumn("part", F.lit(part))
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("month", "part").parquet(path)
    return seen.get["n"]


def _write_rejects(rejected: DataFrame, path: str, part: str) -> int:
    seen = Observation()
    # few files, however many tasks hold the rejects
    out = rejected.hint("rebalance").withColumn("part", F.lit(part)).observe(seen, F.count(F.lit(1)).alias("n"))
    out.write.mode("append").partitionBy("part").parquet(path)
    return seen.get["n"]


def store(
    tagged: DataFrame,
    table_path: str,
    quarantine_path: str,
    batch_id: str,
    counts: dict,
    mode: str = "append",
) -> dict:
    """Write tagged records (``reject_reason`` null: accepted) into the table and the quarantine and make
    both visible by one commit.

    The rows of an attempt lie in folders of its own (``part``) that no reader looks at
    before the manifest names them. A job that dies after any of its writes leaves the
    table as it was; its retry writes another part, and a ``batch_id`` that is already
    committed is not written again. mode: 'append', 'overwrite' (the rows replace all
    earlier ones), or 'dedup' (one row of each tweet_id that is not yet in the table).
    Returns the committed entry of the manifest.
    """
    if mode not in ("append", "overwrite", "dedup"):
        raise ValueError("mode must be append, overwrite or dedup")
    spark = tagged.sparkSession
    if (done := manifest.entry(spark, table_path, batch_id)) is not None:
        return done
    part = manifest.new_part(batch_id)
    accepted = typed_accepted(tagged)
    replaced = manifest.visible_parts(spark, table_path) if mode == "overwrite" else []
    stored = _write_part(_new_posts(accepted, table_path) if mode == "dedup" else accepted, table_path, part)
    raw = [c for c in POSTS_JSONL.fieldNames() if c in tagged.columns]
    rejects = tagged.where(F.col("reject_reason").isNotNull()).select(*raw, "reject_reason")
    _write_rejects(rejects, quarantine_path, part)
    entry = {"batch_id": batch_id, "part": part, "mode": mode, "replaces": replaced, "stored": stored, **counts}
    return manifest.commit(spark, table_path, entry)


def ingest(
    parsed: DataFrame,
    table_path: str,
    quarantine_path: str,
    dim: int = VECTOR_DIM,
    max_reject_rate: float = MAX_REJECT_RATE,
    mode: str = "append",
    batch_id: str | None = None,
) -> dict:
    """Validate, apply the reject guard, then store table rows and rejects by one commit (see ``store``).

    The records are parsed and tagged once, into a staging table of the shared
    folder whose write observes the counts; the guard fails before the posts
    table or the quarantine is touched. With a ``batch_id`` a retry of a batch
    doubles nothing, whatever the first attempt had written.
    Returns {'total', 'accepted', 'rejected', 'written'}; ``written`` is the
    table's row count after the commit.
    """
    spark = parsed.sparkSession
    done = manifest.entry(spark, table_path, batch_id) if batch_id is not None else None
    if done is None:
        obs = Observation("ingest")
        tagged = written(
            parsed.withColumn("reject_reason", reject_reason(dim)).observe(
                obs, F.count(F.lit(1)).alias("n"), F.count("reject_reason").alias("bad")
            ),
            "ingest",
        )
        n, bad = obs.get["n"], obs.get["bad"]
        check_reject_rate(n, bad, max_reject_rate)
        counts = {"total": n, "accepted": n - bad, "rejected": bad}
        done = store(tagged, table_path, quarantine_path, batch_id or manifest.new_part("batch"), counts, mode)
    return {**{c: done[c] for c in ("total", "accepted", "rejected")}, "written": read_posts_table(spark, table_path).count()}


def compact_posts(spark: SparkSession, path: str, max_files: int = 1) -> int:
    """Rewrite every month that lies in more than ``max_files`` files into few, by one commit; the number of months.

    Readers see the old parts until the commit and the new part after it. The old files
    stay for readers that began before (remove them with the storage's own means)."""
    parts = manifest.visible_parts(spark, path)
    rows = spark.read.schema(STORED_POSTS).parquet(path).where(F.col("part").isin(parts))
    files = rows.select("month", F.col("_metadata.file_path").alias("file")).distinct().groupBy("month").count()
    many = [r["month"] for r in files.where(F.col("count") > max_files).collect()]  # a row a month
    if not many:
        return 0
    # parts are replaced as a whole, so the other months of theirs move along
    part = manifest.new_part("compact")
    stored = _write_part(rows, path, part)
    manifest.commit(spark, path, {"batch_id": part, "part": part, "mode": "compact", "replaces": parts, "stored": stored})
    return len(many)


def ingest_counters(spark: SparkSession, path: str) -> DataFrame:
    """Row counters of every committed batch -> (version, batch_id, mode, total, accepted, rejected, stored)."""
    return manifest.table(spark, path).select("version", "batch_id", "mode", "total", "accepted", "rejected", "stored").orderBy("version")

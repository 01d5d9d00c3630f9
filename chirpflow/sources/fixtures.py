"""Shape the driver's tables into the post tables the reference reads.

The reference reads a posts CSV, per-account archive JSON and an embedded-posts
JSONL file; none ships with it. These builders derive equivalent tables from the
generated parquet tables with plain Spark joins and projections, over whole
tables, so every registered query's work grows with the data:

    posts            documents ⋈ orders            -> canonical posts
    archive_tweets   conversations ⋈ orders        -> archive tweets (threads)
    vector_corpus    posts ⋈ embeddings            -> posts with a vector
    ingest_lines     events                        -> JSON lines incl. bad ones
    dirty_posts      posts with blank / NA / null text injected

The SQL oracles build the same shapes independently (see ``plans.oracles``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.schemas import POST_COLUMNS
from chirpflow.session import read_table

ARCHIVE_TS_FORMAT = "EEE MMM dd HH:mm:ss '+0000' yyyy"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` on a unique key into ``spark.sql.shuffle.partitions`` parts.

    The driver writes each table as one Parquet row group, which Spark scans in
    a single task; this spreads the text work over every core. The key is
    unique, so the parts are even however skewed other columns are; when it is
    also the key of the next join (documents on doc_id) the sort-merge join at
    scale reuses this exchange instead of planning its own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical posts: tweet_id, account_id, created_at, full_text, counts, username, lang."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return d.join(o, d.doc_id == o.o_orderkey).select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("text").alias("full_text"),
        (F.col("n_chars") % 100).cast("int").alias("retweet_count"),
        (F.col("n_chars") % 37).cast("int").alias("favorite_count"),
        F.lit(None).cast("string").alias("reply_to_tweet_id"),
        F.lit(None).cast("string").alias("reply_to_user_id"),
        F.lit(None).cast("string").alias("reply_to_username"),
        F.col("source").alias("username"),
        "lang",
    )


def dirty_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with null, blank and 'NA' texts injected (by id) to exercise cleaning."""
    p = posts(spark, sf_dir)
    k = F.col("tweet_id").cast("long")
    text = (
        F.when(k % 17 == 0, F.lit(None).cast("string"))
        .when(k % 19 == 0, F.lit("  "))
        .when(k % 23 == 0, F.lit("NA"))
        .otherwise(F.col("full_text"))
    )
    return p.withColumn("full_text", text)


def csv_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty_posts`` as the strings of a posts CSV; every 29th date and every 31st count is no such value."""
    k = F.col("tweet_id").cast("long")
    stamp = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    return dirty_posts(spark, sf_dir).withColumns({
        "created_at": F.when(k % 29 == 0, F.lit("not a date")).otherwise(stamp),
        "retweet_count": F.when(k % 31 == 0, F.lit("many")).otherwise(F.col("retweet_count").cast("string")),
    }).select(*[F.col(c).cast("string").alias(c) for c in POST_COLUMNS])


ARCHIVE_PART = 100           # positions of one archive document: large accounts come in parts


def archive_documents(spark: SparkSession, sf_dir: str, part: int | None = ARCHIVE_PART) -> DataFrame:
    """``archive_tweets`` nested as archive documents (account, tweets), at most ``part`` positions in one
    (None: one document an account)."""
    entry = F.struct("pos", F.struct(
        "retweeted",
        F.struct("id", "full_text", "created_at", "in_reply_to_user_id", "in_reply_to_status_id").alias("tweet"),
    ).alias("entry"))
    parts = (
        archive_tweets(spark, sf_dir)
        .groupBy("account_id", (F.floor(F.col("pos") / part) if part else F.lit(0)).alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    )
    account = F.struct(F.col("account_id").alias("accountId"))
    return parts.select(
        F.array(F.struct(account.alias("account"))).alias("account"),
        F.transform("rows", lambda r: r["entry"]).alias("tweets"),
    )


def looping_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``archive_tweets`` with reply cycles (turn 0 answers turn 2 where the account ends in 5) and
    self-replies without a parent (turn 5 where it ends in 9)."""
    conv, turn = F.col("account_id").cast("long"), F.col("id").cast("long") % 100
    loop, orphan = (conv % 10 == 5) & (turn == 0), (conv % 10 == 9) & (turn == 5)
    return archive_tweets(spark, sf_dir).withColumns({
        "in_reply_to_status_id": F.when(loop, (conv * 100 + 2).cast("string")).when(~orphan, F.col("in_reply_to_status_id")),
        "in_reply_to_user_id": F.when(loop, F.col("account_id")).otherwise(F.col("in_reply_to_user_id")),
    })


def archive_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened account archives: one row per tweet entry, in archive order.

    conv_id is the account, turn the position. Turns 0, 3, 6 start threads; the
    others reply to the previous turn. Turn 1 of an even conversation replies to
    a tweet missing from the archive; turn 4 replies to another user (no thread
    edge); system turns are retweets. The first assistant turn appears a second
    time at the end of the archive, edited (same id: last one wins). Dates are in
    archive form; conversation ids ending in 3 have no root date and ending in 7
    a short one.
    """
    # spread on the unique (conv_id, turn): one account may hold a third of all tweets
    c = spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    base = c.join(o, c.conv_id == o.o_orderkey, "left")
    edited = base.where((F.col("role") == "assistant") & (F.col("turn") == 1)).select(
        "conv_id", "turn", "role", F.concat("text", F.lit(" (edited)")).alias("text"),
        "o_orderkey", "o_orderdate", (F.col("turn") + 100).alias("pos"),
    )
    rows = base.withColumn("pos", F.col("turn")).unionByName(edited)
    conv, turn = F.col("conv_id"), F.col("turn")
    parent = F.when(
        turn % 3 != 0,
        F.when((turn == 1) & (conv % 2 == 0), conv * 100 + 99).otherwise(conv * 100 + turn - 1),
    )
    stamp = F.date_format(F.col("o_orderdate") + F.make_interval(days=turn.cast("int")), ARCHIVE_TS_FORMAT)
    created = (
        F.when(conv % 10 == 3, F.lit(""))
        .when(conv % 10 == 7, F.date_format(F.col("o_orderdate"), "MMM yyyy"))
        .otherwise(stamp)
    )
    return rows.select(
        conv.cast("string").alias("account_id"),
        F.col("pos").cast("long").alias("pos"),
        (F.col("role") == "system").alias("retweeted"),
        (conv * 100 + turn).cast("string").alias("id"),
        F.col("text").alias("full_text"),
        created.alias("created_at"),
        F.when(parent.isNotNull(), F.when(turn == 4, F.lit("other")).otherwise(conv.cast("string")))
        .alias("in_reply_to_user_id"),
        parent.cast("string").alias("in_reply_to_status_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as (vec_id, embedding, label)."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that have both text and a vector (the pairing is arbitrary: mechanics only)."""
    p = posts(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return p.join(e, p.tweet_id.cast("long") == e.vec_id).select(
        *[p[c] for c in p.columns], F.col("embedding").alias("full_text_vector")
    )


def ingest_lines(spark: SparkSession, sf_dir: str, dim: int = 3) -> DataFrame:
    """JSON lines of posts built from events: (line_id, value).

    Every 11th line is cut short (malformed), every 7th carries an unparsable
    date, every 13th a non-numeric retweet_count and every 17th a vector one
    element short of ``dim``.
    """
    e = spread(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), "event_id")
    k = F.col("event_id")
    created = F.when(k % 7 == 0, F.lit("not a date")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30"))
    )
    rt = F.when(k % 13 == 0, F.lit('"many"')).otherwise(F.floor("value").cast("long").cast("string"))
    elems = [F.col("user_id").cast("string"), (k % 5).cast("string")] + [F.lit("1")] * (dim - 2)
    vec_full = F.concat_ws(",", *elems)
    vec_short = F.concat_ws(",", *elems[: dim - 1])
    vec = F.when(k % 17 == 0, vec_short).otherwise(vec_full)
    doc = F.concat(
        F.lit('{"tweet_id":"'), k.cast("string"),
        F.lit('","account_id":"'), F.col("user_id").cast("string"),
        F.lit('","created_at":"'), created,
        F.lit('","full_text":"'), F.col("event_type"), F.lit(" event"),
        F.lit('","retweet_count":'), rt,
        F.lit(',"favorite_count":'), (k % 50).cast("string"),
        F.lit(',"username":"user'), F.col("user_id").cast("string"),
        F.lit('","full_text_vector":['), vec,
        F.when(k % 11 == 0, F.lit("]")).otherwise(F.lit("]}")),  # cut short: no closing brace
    )
    return e.select(k.alias("line_id"), doc.alias("value"))


# --- Fixed values: files of a delivery to the ingest stream ---
LINES_PER_FILE = 500_000
LEAST_FILES = 16             # a small delivery still comes in several micro-batches
# --- end of fixed values ---


def write_ingest_lines(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Add the values of ``ingest_lines`` to a folder as text files whose number follows the lines, not the
    session's shuffle partitions: a micro-batch takes a few files and costs a commit of every state partition."""
    rows = read_table(spark, sf_dir, "events").count()
    n = max(LEAST_FILES, -(-rows // LINES_PER_FILE))
    values = ingest_lines(spark, sf_dir).select("value").coalesce(n)
    values.write.mode("append").option("maxRecordsPerFile", LINES_PER_FILE).text(path)


def text_queries(spark: SparkSession) -> DataFrame:
    """Search requests: a common phrase, a single word, and a text nothing matches.

    Queries are parameters; the corpus they run against is a whole table.
    """
    return literal_table(spark, [(1, "the and of"), (2, "in"), (3, "zzzz")], "query_id int, query_text string")


# --- Fixed values: stopword list used by the thread word counts ---
STOPWORDS = ["the", "and", "of", "in", "to", "a", "is", "on", "that", "don't"]
# --- end of fixed values ---


def stopwords(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(w,) for w in STOPWORDS], "word string")


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small literal table built in the JVM (a local relation, no Python worker)."""
    names = [f.strip().split()[0] for f in ddl.split(",")]
    schema = spark.createDataFrame([], ddl).schema

    def lit(v):
        return "NULL" if v is None else ("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else repr(v))

    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def centroid_queries(vecs: DataFrame, by: str | None = "label", vec_col: str = "embedding") -> DataFrame:
    """Query vectors derived from the corpus: the mean vector per ``by`` value
    (or of the whole corpus when ``by`` is None) -> (query_id, query_vector).

    Element-wise means via posexplode + a hash aggregate (partial aggregation
    keeps the shuffle at groups x dim rows per task).
    """
    key = F.col(by) if by else F.lit(0)
    cells = (
        vecs.select(key.alias("query_id"), F.posexplode(vec_col).alias("i", "v"))
        .groupBy("query_id", "i")
        .agg(F.avg("v").alias("m"))
    )
    return cells.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("query_vector")
    )

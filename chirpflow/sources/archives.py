"""Per-account archive JSON (one nested document per account) -> flat tweet rows.

``read_archives`` parses whole documents, one per task. ``read_large_archives`` is for
documents that no task can hold: the file is cut at every comma, by as many tasks as it
has blocks, and the commas that separate array entries are found by prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirpflow.operators.joins import small_side_join
from chirpflow.schemas import ARCHIVE
from chirpflow.session import written


def flatten_archives(raw: DataFrame, retweeted_path: str = "wrapper") -> DataFrame:
    """Archive documents -> (account_id, pos, id, full_text, created_at,
    in_reply_to_user_id, in_reply_to_status_id), retweets excluded.

    ``pos`` is the entry's index in the account's tweet list (thread order).
    The retweet flag is read on the wrapper entry (``retweeted_path='wrapper'``,
    as the reference does) or inside the tweet (``'inner'``). ``get`` keeps an
    empty account list from failing under ANSI mode.
    """
    if retweeted_path not in ("wrapper", "inner"):
        raise ValueError("retweeted_path must be 'wrapper' or 'inner'")
    acc = F.get(F.col("account"), 0)["account"]["accountId"]
    entries = raw.select(
        acc.alias("account_id"),
        F.posexplode(F.coalesce(F.col("tweets"), F.array())).alias("pos", "entry"),
    )
    return _flat(entries, retweeted_path)


def _flat(entries: DataFrame, retweeted_path: str) -> DataFrame:
    """(account_id, pos, entry) -> the columns of a tweet, retweets excluded."""
    flag = F.col("entry.retweeted") if retweeted_path == "wrapper" else F.col("entry.tweet.retweeted")
    t = F.col("entry.tweet")
    return entries.where(~F.coalesce(flag, F.lit(False))).select(
        "account_id",
        F.col("pos").cast("long").alias("pos"),
        t["id"].alias("id"),
        t["full_text"].alias("full_text"),
        t["created_at"].alias("created_at"),
        t["in_reply_to_user_id"].alias("in_reply_to_user_id"),
        t["in_reply_to_status_id"].alias("in_reply_to_status_id"),
    )


def read_archives(spark: SparkSession, path: str, retweeted_path: str = "wrapper", multiline: bool = True) -> DataFrame:
    """Read a folder of archive files: one account per file (many files read in parallel),
    or with ``multiline=False`` one account per line (files can be split)."""
    raw = spark.read.option("multiLine", multiline).schema(ARCHIVE).json(path)
    return flatten_archives(raw, retweeted_path)


def _balance(text: Column) -> Column:
    """Opening minus closing brackets of a text without strings."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _comma_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between any two commas of the files, with what it does to a JSON reader's state.

    -> (file, block, at, value, quotes, out_delta, in_delta): place of the file's block, order inside it,
    number of quotes that open or close a string, change of nesting depth if the piece begins outside or
    inside a string. No escape sequence contains a comma, so none is cut."""
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    split = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    state = pieces.select("*", split.alias("_s")).select(
        "file", "block", "at", "value", (F.size("_s") - 1).alias("quotes"),
        _balance(F.array_join(F.filter("_s", lambda _, i: i % 2 == 0), "")).alias("out_delta"),
        _balance(F.array_join(F.filter("_s", lambda _, i: i % 2 == 1), "")).alias("in_delta"),
    )
    return written(state, "archive-pieces")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """Top-level members of every document cut at the commas of their arrays.

    -> (file, member, entry, text): number of the member in its document, number of the entry in the
    document (consecutive inside a member), and the entry's text with the brackets around the array."""
    pieces = _comma_pieces(spark, path)
    here = Window.partitionBy("file", "block").orderBy("at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(c, w) -> Column:
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    def delta(parity: Column) -> Column:
        return F.when(parity % 2 == 0, F.col("out_delta")).otherwise(F.col("in_delta"))

    # depth changes for either state at the block's start, and what that start is (a row a block)
    local = pieces.withColumn("odd", so_far("quotes", before) % 2)
    local = local.withColumn("d0", delta(F.col("odd"))).withColumn("d1", delta(F.col("odd") + 1))
    blocks = local.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("quotes", "d0", "d1")])
    blocks = blocks.withColumn("start_odd", so_far("quotes", blocks_before) % 2)
    blocks = blocks.withColumn("d", F.when(F.col("start_odd") == 0, F.col("d0")).otherwise(F.col("d1")))
    starts = written(blocks.select("file", "block", "start_odd", so_far("d", blocks_before).alias("start_depth")), "archive-blocks")
    known = small_side_join(local, starts, ["file", "block"])
    known = known.withColumn("d", F.when(F.col("start_odd") == 0, F.col("d0")).otherwise(F.col("d1")))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    outside = (F.col("start_odd") + F.sum("quotes").over(upto)) % 2 == 0
    depth = F.when(outside, F.col("start_depth") + F.sum("d").over(upto))
    cut = known.select("file", "block", "at", "value", depth.alias("depth"))
    cut = cut.select(
        "file", "block", "at", "value",
        (F.col("depth") == 1).cast("int").alias("ends_member"), F.col("depth").isin(1, 2).cast("int").alias("ends_entry"),
    ).fillna(0, ["ends_member", "ends_entry"])
    cut = written(cut, "archive-cuts")
    counts = cut.groupBy("file", "block").agg(F.sum("ends_member").alias("m"), F.sum("ends_entry").alias("e"))
    shifts = counts.select("file", "block", so_far("m", blocks_before).alias("m0"), so_far("e", blocks_before).alias("e0"))
    numbered = small_side_join(cut, written(shifts, "archive-shifts"), ["file", "block"]).select(
        "file", "block", "at", "value",
        (F.col("m0") + so_far("ends_member", before)).alias("member"), (F.col("e0") + so_far("ends_entry", before)).alias("entry"),
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    return numbered.groupBy("file", "member", "entry").agg(F.array_join(F.transform(parts, lambda x: x["value"]), ",").alias("text"))


def read_large_archives(spark: SparkSession, path: str, retweeted_path: str = "wrapper") -> DataFrame:
    """Archive files with one document each -> rows as ``read_archives``, however large a document is.

    A task holds one entry (a tweet) at a time; a document is read by as many tasks as its file has
    blocks. Members may come in any order, with any white space; members other than account and tweets
    are passed over. Of a document that is no sound JSON the entries that are sound are returned.
    """
    if retweeted_path not in ("wrapper", "inner"):
        raise ValueError("retweeted_path must be 'wrapper' or 'inner'")
    entries = written(_entries(spark, path), "archive-entries")
    head = r'(?s)^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*\['
    members = entries.groupBy("file", "member").agg(
        F.min("entry").alias("first"), F.max("entry").alias("last"), F.regexp_extract(F.min_by("text", "entry"), head, 1).alias("name")
    )
    members = written(members.where(F.col("name").isin("account", "tweets")), "archive-members")
    text = F.when(F.col("entry") == F.col("first"), F.regexp_replace("text", head, "")).otherwise(F.col("text"))
    text = F.when(F.col("entry") == F.col("last"), F.regexp_replace(text, r"\]\s*\}?\s*$", "")).otherwise(text)
    named = small_side_join(entries, members, ["file", "member"]).select("file", "name", (F.col("entry") - F.col("first")).alias("pos"), text.alias("text"))
    account, tweet = (ARCHIVE[c].dataType.elementType for c in ("account", "tweets"))
    accounts = named.where("name = 'account' and pos = 0").select("file", F.from_json("text", account)["account"]["accountId"].alias("account_id"))
    rows = named.where((F.col("name") == "tweets") & (F.trim("text") != "")).select("file", "pos", F.from_json("text", tweet).alias("entry"))
    # one row a file: the account's id comes to its tweets
    rows = small_side_join(rows, written(accounts, "archive-accounts"), "file", "left")
    return _flat(rows, retweeted_path)

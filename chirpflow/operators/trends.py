"""Word usage over time: daily series, term counts, monthly top words, spikes.

Every operator stays in long form (one row per key), never a wide matrix.
Tokenizing, counting and filtering happen map-side inside generated code; the
only shuffles are the final hash aggregates (with partial aggregation before the
exchange) and, for top words, a window whose partial ``WindowGroupLimit`` runs
before the shuffle so no month ever ships more than ``top_n`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirpflow.functions.text import tokenize, whole_word_count, with_token_counts
from chirpflow.functions.times import MONTH_FORMAT, month_key
from chirpflow.operators.ranks import numbered


def daily_word_count(
    posts: DataFrame,
    word: str,
    start=None,
    end=None,
    text_col: str = "full_text",
    ts_col: str = "created_at",
) -> DataFrame:
    """Per day, the number of whole-word occurrences of ``word`` -> (day, matches).

    Days that have posts but no match read 0; days without posts are absent.
    ``start`` / ``end`` clip the series, both ends inclusive.
    """
    df = posts.where(F.col(text_col).isNotNull() & F.col(ts_col).isNotNull())
    day = F.to_date(ts_col)
    if start is not None:
        df = df.where(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(day <= F.lit(end).cast("date"))
    return df.groupBy(day.alias("day")).agg(
        F.sum(whole_word_count(text_col, word)).cast("long").alias("matches")
    ).orderBy("day")


def doc_term_counts(
    df: DataFrame,
    id_col: str = "tweet_id",
    text_col: str = "full_text",
    tokenizer: str = "word",
) -> DataFrame:
    """Sparse document-term matrix in long form -> (doc_id, term, tf).

    One matrix row for each input row. The terms are counted inside the row, so
    nothing is shuffled.
    """
    return with_token_counts(df, text_col, tokenizer, [F.col(id_col).alias("doc_id")])


def term_totals(
    df: DataFrame,
    term: str | None = None,
    grain: str = "timestamp",
    text_col: str = "full_text",
    ts_col: str = "created_at",
    tokenizer: str = "word",
) -> DataFrame:
    """Term counts summed per timestamp (or per day), in that order -> (created_at|day, term, n).

    With ``term`` given this is the series of one term: the term filter runs on
    each token array before anything is exploded or shuffled, and every
    timestamp that has posts is kept, with 0 when the term is absent.
    """
    if grain not in ("timestamp", "date"):
        raise ValueError("grain must be 'timestamp' or 'date'")
    key_name = "created_at" if grain == "timestamp" else "day"
    key = (F.col(ts_col) if grain == "timestamp" else F.to_date(ts_col)).alias(key_name)
    base = df.where(F.col(text_col).isNotNull() & F.col(ts_col).isNotNull())
    tokens = tokenize(text_col, tokenizer)
    if term is not None:
        t = term.lower()
        hits = F.size(F.filter(tokens, lambda x: x == F.lit(t)))
        return base.groupBy(key).agg(F.lit(t).alias("term"), F.sum(hits).cast("long").alias("n")).orderBy(key_name)
    return (
        base.select(key, F.explode(tokens).alias("term"))
        .groupBy(key_name, "term")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(key_name, "term")
    )


def vocabulary(df: DataFrame, text_col: str = "full_text", tokenizer: str = "word") -> DataFrame:
    """Sorted distinct terms -> (term). Duplicates are removed per row first."""
    return (
        df.select(F.explode(F.array_distinct(tokenize(text_col, tokenizer))).alias("term"))
        .distinct()
        .orderBy("term")
    )


def monthly_posts(df: DataFrame, ts_col: str = "created_at", fill_gaps: bool = True) -> DataFrame:
    """Posts per calendar month -> (month 'yyyy-MM', n_posts); null dates excluded.

    With ``fill_gaps`` every month between the first and the last is present
    (0 when empty), like a date histogram with min_doc_count 0. The calendar is
    built from a one-row min/max aggregate, so it is bounded by the time span.
    """
    dated = df.where(F.col(ts_col).isNotNull()).select(F.trunc(F.col(ts_col), "month").alias("m"))
    counts = dated.groupBy("m").agg(F.count(F.lit(1)).alias("n_posts"))
    if not fill_gaps:
        return counts.select(F.date_format("m", MONTH_FORMAT).alias("month"), "n_posts").orderBy("month")
    calendar = counts.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m")
    )
    return calendar.join(counts, "m", "left").select(
        F.date_format("m", MONTH_FORMAT).alias("month"),
        F.coalesce("n_posts", F.lit(0)).cast("long").alias("n_posts"),
    ).orderBy("month")


def monthly_doc_counts(
    df: DataFrame,
    text_col: str = "full_text",
    ts_col: str = "created_at",
    tokenizer: str = "standard",
) -> DataFrame:
    """Documents per (month, word) -> (month, word, doc_count).

    Document frequency, not occurrences: tokens are de-duplicated inside each
    row (``array_distinct``) before the explode, so no distinct shuffle is needed.
    """
    return (
        df.where(F.col(ts_col).isNotNull() & F.col(text_col).isNotNull())
        .select(
            month_key(ts_col).alias("month"),
            F.explode(F.array_distinct(tokenize(text_col, tokenizer))).alias("word"),
        )
        .groupBy("month", "word")
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )


def top_words(
    df: DataFrame,
    top_n: int = 1000,
    text_col: str = "full_text",
    ts_col: str = "created_at",
    tokenizer: str = "standard",
) -> DataFrame:
    """Top ``top_n`` words per month by document count -> (month, word, doc_count, rank).

    Months in order, words by rank; ties are broken by word ascending. Up to the
    session's ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default) Spark
    plans a partial WindowGroupLimit below the month shuffle; a larger top_n numbers the
    words of a month without bringing them into one task.
    """
    counts = monthly_doc_counts(df, text_col, ts_col, tokenizer)
    order = [F.desc("doc_count"), F.asc("word")]
    if top_n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(*order)))
    else:
        ranked = numbered(counts, ["month"], order).withColumn("rank", F.col("rank").cast("int"))
    return ranked.where(F.col("rank") <= top_n).orderBy("month", "rank")


def word_spikes(counts: DataFrame, factor: float = 10.0) -> DataFrame:
    """Words whose count grew ``factor``-fold over the previous calendar month.

    Input is ``monthly_doc_counts`` output, complete for every month (cut lists
    would hide words that come from outside last month's list). The
    previous month is the calendar month before: the previous row of the word
    counts only when it is exactly that month, so a word absent last month is
    never compared with an older month. One window partitioned by word; each
    word has at most one row per month, so a partition is bounded by the
    number of months, and the counts are read once (no self-join).
    Months in order, inside a month by word. -> (month, word, prev_count, cur_count, ratio)
    """
    w = Window.partitionBy("word").orderBy("month")
    last_month = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), MONTH_FORMAT)
    prev = F.when(F.lag("month").over(w) == last_month, F.lag("doc_count").over(w)).otherwise(F.lit(0))
    return (
        counts.select("month", "word", F.col("doc_count").alias("cur_count"), prev.alias("prev_count"))
        .where((F.col("prev_count") > 0) & (F.col("cur_count") >= F.col("prev_count") * F.lit(factor)))
        .select(
            "month",
            "word",
            F.col("prev_count").cast("long").alias("prev_count"),
            F.col("cur_count").cast("long").alias("cur_count"),
            F.round(F.col("cur_count") / F.col("prev_count"), 2).alias("ratio"),
        )
        .orderBy("month", "word")
    )

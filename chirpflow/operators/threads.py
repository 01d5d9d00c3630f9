"""Reply threads from account archives: roots, thread text, word counts by date.

Input ``tweets`` is the flattened archive (``sources.archives``): one row per
tweet entry with ``account_id, pos, id, full_text, created_at,
in_reply_to_user_id, in_reply_to_status_id`` (retweets already excluded).
Accounts are independent, so every join key starts with ``account_id``.

Thread roots are found by contracting the reply forest. Tweets that nobody answers
(most of them) are taken off first and come back with one join at the end. The rest
jump: each round replaces a pointer by its pointer's pointer, so a chain of depth d
ends in ceil(log2 d) rounds. A round reads the rows that still climb and, of the
finished ones, only those that some climbing row points at: what a row points at later
is what a climbing row points at now, so a finished row that falls out of this frontier
is never read again. Rounds are written to the shared checkpoint folder, so a lost
executor recomputes one round, not the loop. Hot parents are split off every join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirpflow.functions.text import clean_split
from chirpflow.functions.times import archive_date_key, parse_archive_date_key, parse_archive_timestamp
from chirpflow.operators.joins import small_side_join, split_hot_join
from chirpflow.operators.ranks import numbered
from chirpflow.session import written

KEY = ["account_id", "id"]


def exclude_retweets(tweets: DataFrame, flag: str = "retweeted") -> DataFrame:
    if flag not in tweets.columns:
        return tweets
    return tweets.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def dedup_last(tweets: DataFrame) -> DataFrame:
    """One row per (account_id, id): the entry latest in archive order wins.

    The partial window limit keeps one row of a key per task before anything is shuffled."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("pos"))
    return tweets.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def reply_edges(tweets: DataFrame) -> DataFrame:
    """Self-replies as edges -> (account_id, id, parent_id).

    A reply counts only when it answers the archive's own account. For an id
    listed more than once, its latest self-reply entry decides; a null parent
    there means no edge.
    """
    self_replies = tweets.where(F.col("in_reply_to_user_id") == F.col("account_id"))
    return (
        self_replies.groupBy(*KEY)
        .agg(F.max(F.struct("pos", F.col("in_reply_to_status_id").alias("p"))).alias("last"))
        .select(*KEY, F.col("last.p").alias("parent_id"))
        .where(F.col("parent_id").isNotNull())
    )


def resolve_roots(edges: DataFrame, max_rounds: int | None = None, rounds: list | None = None) -> DataFrame:
    """Forest of (account_id, id, parent_id) -> (account_id, id, root_id, is_cycle).

    Only ids with an edge are returned. A root is the first id on the path that
    has no edge. Ids on or leading into a cycle never reach one: after the round
    bound (ceil(log2(#inner edges)) + 1, enough for any acyclic chain) they are
    returned with ``is_cycle`` true and a null root. ``rounds`` collects the rows
    (climbing, frontier) that each round reads.
    """
    edges = written(edges.select("account_id", "id", "parent_id"), "reply-edges")
    # an edge is inner if somebody answers its tweet; the others wait as leaves
    answered = edges.select(F.col("account_id").alias("p_account"), F.col("parent_id").alias("p_id")).distinct()
    split = written(
        edges.join(answered, (F.col("account_id") == F.col("p_account")) & (F.col("id") == F.col("p_id")), "left")
        .select("account_id", "id", "parent_id", F.col("p_id").isNotNull().alias("inner")),
        "reply-split",
    )
    inner = split.where("inner").drop("inner")
    leaves = split.where("not inner").drop("inner")
    solved = _climb(inner, max_rounds, rounds)
    top = solved.select(F.col("account_id").alias("t_account"), F.col("id").alias("t_id"), "root_id", "is_cycle")
    # a leaf's root is its parent's, or the parent itself where that has no edge
    under = split_hot_join(leaves, top, [("account_id", "t_account"), ("parent_id", "t_id")], "left").select(
        *KEY,
        F.when(F.col("t_id").isNull(), F.col("parent_id")).otherwise(F.col("root_id")).alias("root_id"),
        F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"),
    )
    return solved.unionByName(under)


def _climb(edges: DataFrame, max_rounds: int | None, rounds: list | None) -> DataFrame:
    """Pointer jumping over the inner edges (see the module's head)."""
    heads = edges.select(F.col("account_id").alias("h_account"), F.col("id").alias("h_id"))
    # anc: current ancestor; final: it has no edge (it is the root)
    state = written(
        split_hot_join(edges, heads, [("account_id", "h_account"), ("parent_id", "h_id")], "left").select(
            *KEY, F.col("parent_id").alias("anc"), F.col("h_id").isNull().alias("final")
        ),
        "climb",
    )
    done = [state.where("final")]
    climbing, frontier = state.where("not final"), state.where("final")
    n = climbing.count()
    bound = max_rounds if max_rounds is not None else max(1, math.ceil(math.log2(edges.count() + 1)) + 1)
    for _ in range(bound):
        if not n:
            break
        aims = climbing.select(F.col("account_id").alias("a_account"), F.col("anc").alias("a_id")).distinct()
        frontier = written(
            frontier.join(aims, (F.col("account_id") == F.col("a_account")) & (F.col("id") == F.col("a_id")), "left_semi"), "frontier"
        )
        if rounds is not None:
            rounds.append((n, frontier.count()))
        known = climbing.unionByName(frontier).select(
            F.col("account_id").alias("a2"), F.col("id").alias("id2"), F.col("anc").alias("anc2"), F.col("final").alias("final2")
        )
        # a hot ancestor (many replies under one tweet) is split off and joined map-side
        stepped = written(
            split_hot_join(climbing, known, [("account_id", "a2"), ("anc", "id2")], "inner").select(
                *KEY, F.col("anc2").alias("anc"), F.col("final2").alias("final")
            ),
            "climb",
        )
        new = stepped.where("final")
        done.append(new)
        frontier, climbing = frontier.unionByName(new), stepped.where("not final")
        n = climbing.count()
    out = climbing
    for part in done:
        out = out.unionByName(part)
    return out.select(*KEY, F.when(F.col("final"), F.col("anc")).alias("root_id"), (~F.col("final")).alias("is_cycle"))


def thread_roots(tweets: DataFrame, in_archive: bool = True, max_rounds: int | None = None) -> DataFrame:
    """Root of every archive tweet -> (account_id, id, root_id, is_cycle).

    ``in_archive=True``: climbing stops before a parent missing from the
    archive, so every root is an archive tweet.
    ``in_archive=False``: the climb follows parents even outside the archive,
    so a root may be a missing id.
    Tweets that reply to nothing are their own root.
    """
    ids = tweets.select(*KEY).distinct()
    edges = reply_edges(tweets)
    if in_archive:
        present = ids.select(F.col("account_id").alias("p_account"), F.col("id").alias("p_id"))
        # one present row a key, so the inner join is a semi join; a hot parent is split off
        edges = split_hot_join(edges, present, [("account_id", "p_account"), ("parent_id", "p_id")]).select(*edges.columns)
    roots = resolve_roots(edges, max_rounds)
    return ids.join(roots, KEY, "left").select(
        *KEY,
        F.when(F.col("is_cycle").isNull(), F.col("id")).otherwise(F.col("root_id")).alias("root_id"),
        F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"),
    )


PART_POSTS = 512


def thread_parts(
    tweets: DataFrame,
    roots: DataFrame,
    order_by: str = "pos",
    part_posts: int = PART_POSTS,
) -> DataFrame:
    """Threads cut into parts of ``part_posts`` posts -> (account_id, root_id, part, text, n_posts).

    ``order_by='pos'``: archive order; ``'created_at'``: by date (unparsable and missing
    dates last), archive order among equal dates. Every entry counts, duplicates included.
    The posts of a thread are numbered without bringing a thread into one task, and a
    part is the largest thing that is ever assembled: a hot thread is many rows.
    """
    if order_by not in ("pos", "created_at"):
        raise ValueError("order_by must be pos or created_at")
    mine = roots.where(~F.col("is_cycle")).select(*KEY, "root_id")
    day = parse_archive_timestamp("created_at") if order_by == "created_at" else F.lit(None).cast("timestamp")
    t = tweets.join(mine, KEY).select("account_id", "root_id", "full_text", "pos", "id", day.alias("day"))
    # id and a text hash tell apart rows that share a position (an account in several documents)
    order = [F.asc_nulls_last("day")] if order_by == "created_at" else []
    ranked = numbered(t, ["account_id", "root_id"], [*order, F.asc("pos"), F.asc("id"), F.xxhash64("full_text").asc()], "n")
    posts = F.array_sort(F.collect_list(F.struct("n", "full_text")))
    return (
        ranked.groupBy("account_id", "root_id", F.floor((F.col("n") - 1) / part_posts).cast("long").alias("part"))
        .agg(posts.alias("xs"))
        .select(
            "account_id", "root_id", "part",
            F.array_join(F.transform("xs", lambda x: x["full_text"]), " ").alias("text"), F.size("xs").cast("long").alias("n_posts"),
        )
    )


def thread_text(tweets: DataFrame, roots: DataFrame, order_by: str = "pos", chunk: int = 4096) -> DataFrame:
    """Each thread's texts concatenated -> (account_id, root_id, text, n_posts); order as ``thread_parts``.

    The parts of a thread are joined in order, so the final row holds the whole thread
    text; ``thread_parts`` gives threads that do not fit in a row, and word counting
    never builds them.
    """
    part = thread_parts(tweets, roots, order_by, chunk)
    return part.groupBy("account_id", "root_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " "
        ).alias("text"),
        F.sum("n_posts").cast("long").alias("n_posts"),
    )


def thread_word_counts(
    tweets: DataFrame,
    roots: DataFrame,
    stopwords: DataFrame,
    word: str | None = None,
) -> DataFrame:
    """Words of every thread counted against the root tweet's date -> (word, date_key, date, n).

    With ``word`` given, only that word's counts: it is picked inside each text's word
    array, before anything is exploded.

    Threads whose root has no date are skipped; a date with fewer than six
    parts is 'UnknownDate' (null ``date``). Words come from the clean-and-split
    tokenizer; stopwords are removed after cleaning, so "don't" never removes
    "dont". Counting per tweet and attributing to the root's date equals
    counting the concatenated thread text (the joiner is a space), without ever
    building thread strings.
    """
    # id-level first (no text): each tweet id -> its root's date key; a hot
    # root (one thread holding a large share of all tweets) is split off.
    root_dates = (
        dedup_last(tweets.select(*KEY, "pos", "created_at"))
        .where(F.col("created_at").isNotNull() & (F.col("created_at") != ""))
        .select("account_id", F.col("id").alias("root_id"), archive_date_key("created_at").alias("date_key"))
    )
    r = roots.where(~F.col("is_cycle")).select(*KEY, "root_id")
    d = root_dates.select(F.col("account_id").alias("d_account"), F.col("root_id").alias("d_root"), "date_key")
    dated_ids = split_hot_join(r, d, [("account_id", "d_account"), ("root_id", "d_root")], "inner")
    # then the texts move once, joined on the unique (account_id, id)
    tokens = clean_split("full_text")
    if word is not None:
        tokens = F.filter(tokens, lambda t: t == F.lit(word))
    words = tweets.select(*KEY, "full_text").join(dated_ids.select(*KEY, "date_key"), KEY).select(
        "date_key", F.explode(tokens).alias("word")
    )
    words = small_side_join(words, stopwords.select("word").distinct(), "word", "left_anti")
    return (
        words.groupBy("word", "date_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("word", "date_key", parse_archive_date_key("date_key").alias("date"), "n")
    )


def word_series(counts: DataFrame, word: str) -> DataFrame:
    """One word's dated counts, sorted by date -> (date, n). An absent word gives no rows."""
    return (
        counts.where((F.col("word") == word) & F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.sum("n").cast("long").alias("n"))
        .orderBy("date")
    )

"""User-level queries over the driver tables, one callable per registered name.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose column
names match the SQL oracle of the same name in ``chirpflow.plans.oracles``.
Parameters are the reference's defaults unless a note says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.operators import ann, clean, embed, ingest, profile, search, threads, trends
from chirpflow.plans import jobs
from chirpflow.session import scratch_path, written
from chirpflow.sources import archives, posts
from chirpflow.sources import fixtures as fx
from chirpflow.streaming.ingest_stream import ingest_stream

# --- Fixed values: parameters of the registered queries ---
SERIES_WORD = "the"          # a word present in the generated text
SPIKE_FACTOR = 5.0           # the reference's 10 finds nothing at sf0.01; 10 is unit-tested
TOP_WORDS = 1000
CLIP = ("1993-07-01", "1996-06-30")   # both ends inclusive
# --- end of fixed values ---

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def typed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts after the notebook's cleaning: null text dropped, bad dates dropped."""
    p = fx.posts(spark, sf_dir)
    return clean.normalize_created_at(clean.drop_null_text(p), on_invalid="drop")


# ---- word usage over time -------------------------------------------------


@register("daily_word_count")
def q_daily_word_count(spark, sf_dir):
    return trends.daily_word_count(typed_posts(spark, sf_dir), SERIES_WORD)


@register("daily_word_count_clipped")
def q_daily_word_count_clipped(spark, sf_dir):
    return trends.daily_word_count(typed_posts(spark, sf_dir), SERIES_WORD, start=CLIP[0], end=CLIP[1])


@register("doc_term_counts")
def q_doc_term_counts(spark, sf_dir):
    return trends.doc_term_counts(typed_posts(spark, sf_dir))


@register("term_totals")
def q_term_totals(spark, sf_dir):
    return trends.term_totals(typed_posts(spark, sf_dir), grain="date")


@register("term_totals_timestamp")
def q_term_totals_timestamp(spark, sf_dir):
    return trends.term_totals(typed_posts(spark, sf_dir))


@register("term_series")
def q_term_series(spark, sf_dir):
    return trends.term_totals(typed_posts(spark, sf_dir), term=SERIES_WORD, grain="date")


@register("vocabulary")
def q_vocabulary(spark, sf_dir):
    return trends.vocabulary(typed_posts(spark, sf_dir))


@register("monthly_posts")
def q_monthly_posts(spark, sf_dir):
    return trends.monthly_posts(fx.posts(spark, sf_dir))


@register("monthly_top_words")
def q_monthly_top_words(spark, sf_dir):
    return trends.top_words(fx.posts(spark, sf_dir), top_n=TOP_WORDS)


@register("word_spikes")
def q_word_spikes(spark, sf_dir):
    counts = trends.monthly_doc_counts(fx.posts(spark, sf_dir))
    return trends.word_spikes(counts, factor=SPIKE_FACTOR)


# ---- reply threads ---------------------------------------------------------

THREAD_WORD = "ertion"       # a cleaned word frequent in the generated conversations
THREAD_PART = 3              # posts of a thread part (the generated threads are short)


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.exclude_retweets(fx.archive_tweets(spark, sf_dir))


@register("dedup_last")
def q_dedup_last(spark, sf_dir):
    return threads.dedup_last(archive(spark, sf_dir)).select("account_id", "id", "pos", "full_text")


@register("thread_roots_in_archive")
def q_thread_roots_in_archive(spark, sf_dir):
    return threads.thread_roots(archive(spark, sf_dir), in_archive=True)


@register("thread_roots_dangling")
def q_thread_roots_dangling(spark, sf_dir):
    return threads.thread_roots(archive(spark, sf_dir), in_archive=False)


@register("thread_text")
def q_thread_text(spark, sf_dir):
    tw = archive(spark, sf_dir)
    return threads.thread_text(tw, threads.thread_roots(tw, in_archive=True))


@register("thread_text_by_date")
def q_thread_text_by_date(spark, sf_dir):
    tw = archive(spark, sf_dir)
    return threads.thread_text(tw, threads.thread_roots(tw, in_archive=True), order_by="created_at", chunk=THREAD_PART)


@register("thread_parts")
def q_thread_parts(spark, sf_dir):
    tw = archive(spark, sf_dir)
    return threads.thread_parts(tw, threads.thread_roots(tw, in_archive=True), order_by="created_at", part_posts=THREAD_PART)


def _thread_words(spark, sf_dir, word=None):
    tw = written(archive(spark, sf_dir), "archive")
    roots = written(threads.thread_roots(tw, in_archive=True), "roots")
    path = scratch_path(spark, "stopwords")
    fx.stopwords(spark).write.text(path)
    return threads.thread_word_counts(tw, roots, posts.read_stopwords(spark, path), word)


@register("thread_word_by_date")
def q_thread_word_by_date(spark, sf_dir):
    return _thread_words(spark, sf_dir)


@register("word_series")
def q_word_series(spark, sf_dir):
    return threads.word_series(_thread_words(spark, sf_dir, THREAD_WORD), THREAD_WORD)


@register("thread_roots_cycles")
def q_thread_roots_cycles(spark, sf_dir):
    return threads.thread_roots(threads.exclude_retweets(fx.looping_tweets(spark, sf_dir)), in_archive=True)


# ---- sources: the tables written as the reference's files and read back ------


@register("csv_posts")
def q_csv_posts(spark, sf_dir):
    path = scratch_path(spark, "posts-csv")
    posts.write_posts_csv(fx.csv_posts(spark, sf_dir), path)
    typed = posts.type_posts(posts.read_posts_csv(spark, path, na_strings=("NA",)))
    return clean.drop_null_text(typed)


@register("archive_flat")
def q_archive_flat(spark, sf_dir):
    path = scratch_path(spark, "archives")
    fx.archive_documents(spark, sf_dir).write.json(path)
    return archives.read_archives(spark, path, multiline=False)


@register("archive_large")
def q_archive_large(spark, sf_dir):
    """Each account as one document in a file of its own, split inside the document."""
    path = scratch_path(spark, "large-archives")
    whole = fx.archive_documents(spark, sf_dir, part=None)
    # a file a document: tasks put their own files in place, the driver does not rename them one by one
    whole.write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).json(path)
    return archives.read_large_archives(spark, path)


@register("embed_job_resumed")
def q_embed_job_resumed(spark, sf_dir):
    """The embed job in waves, started twice: the second start finds every wave committed."""
    root = scratch_path(spark, "embed-waves")
    posts.write_posts_csv(fx.csv_posts(spark, sf_dir), f"{root}/csv")
    for _ in range(2):
        jobs.resumable_embed_job(spark, f"{root}/csv", f"{root}/out", encoder=embed.hashing_encoder(HASH_DIM), waves=4)
    parsed = jobs.read_embedded(spark, f"{root}/out")
    e = embed.vector_entries(parsed.select("tweet_id", F.col("full_text_vector").cast("array<float>")), "tweet_id")
    return e.select("tweet_id", "bucket", F.round(F.col("weight").cast("double"), SCORE_DECIMALS).alias("weight"))


@register("embed_job")
def q_embed_job(spark, sf_dir):
    """Posts CSV -> vectors -> JSON lines (the job), read back and validated."""
    root = scratch_path(spark, "embed-job")
    posts.write_posts_csv(fx.csv_posts(spark, sf_dir), f"{root}/csv")
    jobs.embed_posts_job(spark, f"{root}/csv", f"{root}/jsonl", encoder=embed.hashing_encoder(HASH_DIM))
    parsed = ingest.read_posts_jsonl(spark, f"{root}/jsonl")
    e = embed.vector_entries(parsed.select("tweet_id", F.col("full_text_vector").cast("array<float>")), "tweet_id")
    return e.select("tweet_id", "bucket", F.round(F.col("weight").cast("double"), SCORE_DECIMALS).alias("weight"))


@register("ingest_batch")
def q_ingest_batch(spark, sf_dir):
    """The JSON lines written as files and ingested twice into one new table; the second run adds nothing."""
    root = scratch_path(spark, "ingest-batch")
    fx.ingest_lines(spark, sf_dir).select("value").write.text(f"{root}/in")
    ingest.create_posts_table(spark, f"{root}/posts")
    for _ in range(2):
        jobs.ingest_job(spark, f"{root}/in", f"{root}/posts", f"{root}/quarantine", dim=INGEST_DIM, mode="dedup")
    table = ingest.read_posts_table(spark, f"{root}/posts")
    return table.select("tweet_id", "month", "retweet_count", "favorite_count")


# ---- vectors and search ------------------------------------------------------

HASH_DIM = 64                # stand-in encoder width (the driver's vectors are 64-d)
SCORE_DECIMALS = 6


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, SCORE_DECIMALS))
    return df


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned posts embedded with the stand-in encoder (the embed pipeline's output)."""
    p = clean.clean_posts(fx.posts(spark, sf_dir))
    return embed.embed(p, embed.hashing_encoder(HASH_DIM))


def text_query_table(spark: SparkSession) -> DataFrame:
    return search.embed_queries(fx.text_queries(spark), embed.hashing_encoder(HASH_DIM))


@register("cosine_topk")
def q_cosine_topk(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    hits = search.vector_topk(v, fx.centroid_queries(v, by=None), k=10, metric="cosine",
                              id_col="vec_id", vec_col="embedding")
    return _rounded(hits.withColumnRenamed("id", "vec_id"), "score")


@register("cosine_topk_batch")
def q_cosine_topk_batch(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    hits = search.vector_topk(v, fx.centroid_queries(v, by="label"), k=10, metric="cosine",
                              id_col="vec_id", vec_col="embedding")
    return _rounded(hits.withColumnRenamed("id", "vec_id"), "score")


def _vector_corpus_queries(spark, sf_dir):
    corpus = fx.vector_corpus(spark, sf_dir)
    return corpus, fx.centroid_queries(fx.vectors(spark, sf_dir), by="label")


@register("knn_search")
def q_knn_search(spark, sf_dir):
    corpus, queries = _vector_corpus_queries(spark, sf_dir)
    hits = search.knn(corpus, queries, k=10, size=5, metric="l2")
    return _rounded(search.result_rows(hits, corpus), "score")


@register("knn_by_date")
def q_knn_by_date(spark, sf_dir):
    corpus, queries = _vector_corpus_queries(spark, sf_dir)
    hits = search.knn_by_date(corpus, queries, k=10, size=5, metric="l2")
    return _rounded(search.result_rows(hits, corpus), "score")


@register("embed_posts")
def q_embed_posts(spark, sf_dir):
    e = embed.vector_entries(text_corpus(spark, sf_dir), "tweet_id")
    return e.select("tweet_id", "bucket", F.round(F.col("weight").cast("double"), SCORE_DECIMALS).alias("weight"))


@register("knn_text")
def q_knn_text(spark, sf_dir):
    hits = search.knn(text_corpus(spark, sf_dir), text_query_table(spark), k=10, size=5, metric="l2")
    return _rounded(hits.withColumnRenamed("id", "tweet_id"), "score")


@register("bm25_match")
def q_bm25_match(spark, sf_dir):
    corpus = clean.clean_posts(fx.posts(spark, sf_dir))
    hits = search.bm25(corpus, fx.text_queries(spark), size=10)
    return _rounded(hits.withColumnRenamed("id", "tweet_id"), "score")


@register("hybrid_search")
def q_hybrid_search(spark, sf_dir):
    hits = search.hybrid(text_corpus(spark, sf_dir), text_query_table(spark), k=10, size=5)
    return _rounded(hits.withColumnRenamed("id", "tweet_id"), "score", "knn_score", "text_score")


@register("hybrid_minmax")
def q_hybrid_minmax(spark, sf_dir):
    hits = search.hybrid(text_corpus(spark, sf_dir), text_query_table(spark), k=10, size=5, fusion="minmax")
    return _rounded(hits.withColumnRenamed("id", "tweet_id"), "score", "knn_score", "text_score")


@register("hybrid_rrf")
def q_hybrid_rrf(spark, sf_dir):
    hits = search.hybrid(text_corpus(spark, sf_dir), text_query_table(spark), k=10, size=5, fusion="rrf")
    return _rounded(hits.withColumnRenamed("id", "tweet_id"), "score", "knn_score", "text_score")


@register("search_results_knn")
def q_search_results_knn(spark, sf_dir):
    rows = search.search(text_corpus(spark, sf_dir), fx.text_queries(spark), mode="knn",
                         size=5, k=10, encoder=embed.hashing_encoder(HASH_DIM))
    return _rounded(rows, "score")


@register("search_results_by_date")
def q_search_results_by_date(spark, sf_dir):
    """The k nearest, newest first, with scores as they are displayed (three places)."""
    rows = search.search(text_corpus(spark, sf_dir), fx.text_queries(spark), mode="by_date",
                         size=5, k=10, encoder=embed.hashing_encoder(HASH_DIM))
    return search.shown(rows)


@register("search_results")
def q_search_results(spark, sf_dir):
    rows = search.search(text_corpus(spark, sf_dir), fx.text_queries(spark), mode="hybrid",
                         size=5, k=10, encoder=embed.hashing_encoder(HASH_DIM))
    return _rounded(rows, "score")


# ---- cleaning, profiles, ingest ---------------------------------------------

INGEST_DIM = 3               # vector width of the generated JSON lines


@register("clean_posts")
def q_clean_posts(spark, sf_dir):
    kept = clean.clean_posts(fx.dirty_posts(spark, sf_dir), max_chars=clean.MAX_TEXT_CHARS)
    return kept.select("tweet_id", F.length("full_text").cast("long").alias("n_chars"), "full_text")


@register("post_profile")
def q_post_profile(spark, sf_dir):
    p = profile.profile(fx.posts(spark, sf_dir), ["retweet_count", "favorite_count"], approx=False)
    return _rounded(p, "mean", "std", "min", "p25", "p50", "p75", "max")


@register("post_time_profile")
def q_post_time_profile(spark, sf_dir):
    return profile.time_profile(fx.posts(spark, sf_dir))


@register("post_preview")
def q_post_preview(spark, sf_dir):
    return profile.preview(fx.posts(spark, sf_dir).select("tweet_id", "created_at", "username", "full_text"), 5, "tweet_id")


@register("missing_text_filled")
def q_missing_text_filled(spark, sf_dir):
    return clean.fill_missing_text(fx.dirty_posts(spark, sf_dir)).select("tweet_id", "full_text")


@register("null_profile")
def q_null_profile(spark, sf_dir):
    return profile.null_profile(fx.posts(spark, sf_dir))


def _validated(spark, sf_dir):
    parsed = ingest.parse_json_lines(fx.ingest_lines(spark, sf_dir))
    return ingest.validate_posts(parsed, dim=INGEST_DIM)


@register("ingest_accept_reject")
def q_ingest_accept_reject(spark, sf_dir):
    accepted, rejected = _validated(spark, sf_dir)
    return accepted.select("line_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("line_id", F.lit(False).alias("accepted"), "reject_reason")
    )


@register("reject_counts")
def q_reject_counts(spark, sf_dir):
    return ingest.reject_counts(_validated(spark, sf_dir)[1])


@register("created_at_normalized")
def q_created_at_normalized(spark, sf_dir):
    accepted, _ = _validated(spark, sf_dir)
    return ingest.created_at_iso(accepted.select("line_id", "tweet_id", "created_at"))


@register("ann_topk")
def q_ann_topk(spark, sf_dir):
    """Cell-pruned search (exact mode) over the embeddings table; equals cosine_topk_batch."""
    v = fx.vectors(spark, sf_dir)
    path = ann.build_ivf_index(v, ann.index_path(spark), n_cells=8, metric="cosine",
                               id_col="vec_id", vec_col="embedding", max_iter=4, init_mode="random")
    hits = ann.ivf_search(spark, path, fx.centroid_queries(v, by="label"), k=10, nprobe=2, exact=True)
    return _rounded(hits.withColumnRenamed("id", "vec_id"), "score")


@register("ann_recall")
def q_ann_recall(spark, sf_dir):
    """The approximate search, calibrated to recall 0.95, held against the exact one: the vectors whose
    id is divisible by 100 as queries, all vectors searched."""
    v = fx.vectors(spark, sf_dir)
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    path = ann.build_ivf_index(v, ann.index_path(spark), n_cells=32, metric="cosine", id_col="vec_id", vec_col="embedding",
                               max_iter=4, init_mode="random", target_recall=ann.TARGET_RECALL)
    found = ann.ivf_search(spark, path, queries, k=10, exact=False)
    truth = search.vector_topk(v, queries, k=10, metric="cosine", id_col="vec_id", vec_col="embedding")
    per = ann.recall(found, truth)
    return per.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum("n_found") >= ann.TARGET_RECALL * F.sum("k")).alias("recall_reached"))


def _streamed(spark, sf_dir, deliveries: int):
    root = ann.index_path(spark, "stream")
    ingest.create_posts_table(spark, f"{root}/posts")
    for _ in range(deliveries):
        fx.write_ingest_lines(spark, sf_dir, f"{root}/in")
        q = ingest_stream(spark, f"{root}/in", f"{root}/posts", f"{root}/quarantine", f"{root}/checkpoint",
                          dim=INGEST_DIM, max_files_per_trigger=8)
        q.awaitTermination()
    return root


@register("ingest_stream_accepted")
def q_ingest_stream_accepted(spark, sf_dir):
    """The JSON lines written as files, ingested by the checkpointed file stream
    (availableNow, a few files per micro-batch), read back from the posts table."""
    table = ingest.read_posts_table(spark, f"{_streamed(spark, sf_dir, 1)}/posts")
    return table.select("tweet_id", "retweet_count", "favorite_count")


@register("ingest_stream_twice")
def q_ingest_stream_twice(spark, sf_dir):
    """The same lines delivered a second time as new files: neither table nor quarantine grows; then compacted."""
    root = _streamed(spark, sf_dir, 2)
    ingest.compact_posts(spark, f"{root}/posts")
    table = ingest.read_posts_table(spark, f"{root}/posts").select("tweet_id", F.lit(None).cast("string").alias("reject_reason"))
    rejects = ingest.read_quarantine(spark, f"{root}/posts", f"{root}/quarantine")
    return table.unionByName(rejects.select(F.lit(None).cast("string").alias("tweet_id"), "reject_reason"))


@register("ingest_counters")
def q_ingest_counters(spark, sf_dir):
    """Row counters of a batch that is ingested twice under one batch id, then once more in dedup mode."""
    root = scratch_path(spark, "ingest-counters")
    fx.ingest_lines(spark, sf_dir).select("value").write.text(f"{root}/in")
    for batch, mode in (("first", "append"), ("first", "append"), ("second", "dedup")):
        jobs.ingest_job(spark, f"{root}/in", f"{root}/posts", f"{root}/quarantine", dim=INGEST_DIM, mode=mode, batch_id=batch)
    return ingest.ingest_counters(spark, f"{root}/posts")

"""Exact vector top-k, BM25 keyword search, hybrid fusion, date re-sort, result rows.

Scale design
------------
* The corpus is scanned once per query pass and never shuffled with its
  vectors. The query set is the side that travels: its size is checked
  (``MAX_QUERY_BYTES`` per pass) before it is broadcast as one matrix; a larger
  query set is split into several passes, never truncated.
* Per Arrow batch, a NumPy matrix product scores every corpus row against all
  queries; each task keeps a running exact top-k per query (ties broken by id)
  and emits it once, so the shuffle carries at most k candidates per query per
  task; a window with a partial WindowGroupLimit then picks the final k. No
  cross join is planned.
* Only (query_id, id, score) flows through top-k; wide columns (text, user,
  dates) are joined back afterwards against a broadcast of the bounded hits.
* BM25 looks each token up in a hash table of the query terms (a broadcast join
  behind a size check, else a shuffled one): the cost of a token does not depend
  on the number of terms, and only matched (doc, term) pairs are shuffled.
* Display columns of the hits are joined back once. For a handful of hits their
  ids also become a literal IN-list, pushed into the Parquet scan (row-group
  statistics skip the rest).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from chirpflow.functions.text import snippet, tokenize
from chirpflow.functions.times import display_date
from chirpflow.operators.embed import EncoderFactory, embed, encoder_of
from chirpflow.operators.joins import small_side_join
from chirpflow.operators.ranks import numbered
from chirpflow.session import written

# --- Fixed values: search defaults of the reference ---
DEFAULT_K = 10          # nearest neighbours considered
DEFAULT_SIZE = 5        # results returned
KEYWORD_BOOST = 0.3     # weight of the keyword clause in hybrid search
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
# --- end of fixed values ---

MAX_BLOCK_CELLS = 4_000_000  # rows x queries scored at once in a task (32 MB of scores)
MAX_QUERY_BYTES = 64 << 20     # query matrix broadcast per pass
MAX_QUERIES_PER_PASS = 100_000
MAX_QUERY_TERMS = 200_000      # query vocabulary broadcast for BM25
TIE_DECIMALS = 9               # scores equal to 1e-9 are ties, broken by id


def _order(score="score", id_col="id"):
    return [F.desc(F.round(F.col(score), TIE_DECIMALS)), F.asc(id_col)]


def _best(ids, keys, scores, k):
    """Indices of the exact top-k by (score desc, id asc); scores equal to 1e-9 tie."""
    n = len(scores)
    if n > k:
        thr = np.partition(scores, n - k)[n - k]
        cand = np.flatnonzero(scores >= thr - 10.0 ** -TIE_DECIMALS)
    else:
        cand = np.arange(n)
    if len(cand) > 1:
        cand = cand[np.lexsort((keys[cand], -np.round(scores[cand], TIE_DECIMALS)))]
    return cand[:k]


def _block_top(keys, S, k):
    """Per column of the score block S (rows x queries): row indices of the exact
    top-k by (score rounded to 1e-9 desc, key asc). One vectorised partition
    finds every column's k-th score; ties at the cut are resolved by key."""
    n, q = S.shape
    if n <= k:
        return [np.arange(n)] * q
    R = np.round(S, TIE_DECIMALS)
    kth = np.partition(R, n - k, axis=0)[n - k]
    above, at = R > kth, R == kth
    out = []
    for j in range(q):
        a = np.flatnonzero(above[:, j])
        t = np.flatnonzero(at[:, j])
        need = k - len(a)
        if len(t) > need:
            t = t[np.argsort(keys[t], kind="stable")[:need]]
        out.append(np.concatenate([a, t]))
    return out


def vector_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors of a list column that are ``dim`` long and finite."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    at = np.flatnonzero(lengths == dim)
    if len(at) == len(lengths):
        matrix = values.reshape(len(at), dim)
    else:
        matrix = values[starts[at][:, None] + np.arange(dim)]
    sound = np.isfinite(matrix).all(axis=1)
    return at[sound], matrix[sound]


def sortable(ids: pa.Array) -> np.ndarray:
    """Ids as a numpy array that sorts like the column."""
    if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type):
        return np.array(ids.to_pylist(), dtype=str)
    return ids.to_numpy(zero_copy_only=False)


def _topk_fn(bc, k: int, metric: str, qid_type: pa.DataType):
    """mapInArrow kernel over (id, vector): score every row of the task against the
    broadcast queries and emit, once per task, the exact top-k per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, Q = bc.value
        dim = Q.shape[1]
        qn = np.sqrt((Q * Q).sum(axis=1))
        qq = qn * qn
        best = [None] * len(qids)  # per query: (ids, keys, scores) of the running top-k
        step = max(1, MAX_BLOCK_CELLS // len(qids))

        def score_block(X, ids):
            keys = sortable(ids)
            S = X @ Q.T
            if metric == "cosine":
                denom = np.sqrt((X * X).sum(axis=1))[:, None] * qn[None, :]
                S = np.divide(S, denom, out=np.zeros_like(S), where=denom > 0)
            elif metric == "l2":
                d2 = (X * X).sum(axis=1)[:, None] + qq[None, :] - 2.0 * S
                S = 1.0 / (1.0 + np.maximum(d2, 0.0))
            for j, top in enumerate(_block_top(keys, S, k)):
                new = (ids.take(pa.array(top)), keys[top], S[top, j])
                if best[j] is not None:
                    bi, bk, bs = best[j]
                    ci = pa.concat_arrays([bi, new[0]])
                    ck, cs = np.concatenate([bk, new[1]]), np.concatenate([bs, new[2]])
                    keep = _best(ci, ck, cs, k)
                    new = (ci.take(pa.array(keep)), ck[keep], cs[keep])
                best[j] = new

        ids_type = None
        for batch in batches:
            # rows without a vector of the query dimension are skipped here, not
            # by a Spark filter: a filter on an encoder output would be pushed
            # below the exchange and run the encoder twice; a NaN would rank by chance
            ids_type = batch.column(0).type
            at, X = vector_rows(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(at))
            for i in range(0, len(X), step):
                score_block(X[i : i + step], ids.slice(i, step))
        for qid, b in zip(qids, best, strict=True):
            if b is not None and len(b[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * len(b[0]), qid_type), b[0].cast(ids_type), pa.array(b[2], pa.float64())], ["query_id", "id", "score"]
                )

    return run


def _matrix(rows):
    return [r[0] for r in rows], np.array([list(r[1]) for r in rows], dtype=np.float64)


def _same_length(rows, dim):
    if any(len(r[1]) != dim for r in rows):
        raise ValueError("the query vectors differ in length")
    return rows


def _query_passes(queries: DataFrame, query_id_col: str, query_vec_col: str):
    """Query matrices, each within MAX_QUERY_BYTES; a larger query set is split
    into hash passes (every query is kept). Yields (query ids, matrix)."""
    q = queries.select(query_id_col, query_vec_col).where(F.col(query_vec_col).isNotNull())
    probe = q.limit(MAX_QUERIES_PER_PASS + 1).collect()
    dim = max((len(r[1]) for r in probe), default=0)
    if not probe or dim == 0:
        return
    per_pass = max(1, min(MAX_QUERIES_PER_PASS, MAX_QUERY_BYTES // (8 * dim)))
    if len(probe) <= per_pass:
        yield _matrix(_same_length(probe, dim))
        return
    n_pass = math.ceil(q.count() / per_pass)
    for p in range(n_pass):
        rows = q.where(F.pmod(F.hash(query_id_col), F.lit(n_pass)) == p).collect()
        if rows:
            yield _matrix(_same_length(rows, dim))


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    id_col: str = "tweet_id",
    vec_col: str = "full_text_vector",
    query_id_col: str = "query_id",
    query_vec_col: str = "query_vector",
) -> DataFrame:
    """Exact top-k corpus rows per query -> (query_id, rank, id, score).

    metric: 'cosine' (zero vector scores 0), 'l2' (score 1/(1+d^2)) or 'dot'.
    Corpus rows whose vector is null, of another dimension or not finite are
    skipped; query vectors of different lengths raise ValueError.
    Ties (to 1e-9) are broken by id ascending.
    """
    if metric not in ("cosine", "l2", "dot"):
        raise ValueError("metric must be cosine, l2 or dot")
    spark = corpus.sparkSession
    qid_type = queries.schema[query_id_col].dataType
    id_type = corpus.schema[id_col].dataType
    schema = StructType([
        StructField("query_id", qid_type), StructField("id", id_type), StructField("score", DoubleType()),
    ])
    rows = corpus.select(id_col, vec_col)
    parts = []
    for qids, Q in _query_passes(queries, query_id_col, query_vec_col):
        bc = spark.sparkContext.broadcast((qids, Q))
        parts.append(rows.mapInArrow(_topk_fn(bc, k, metric, to_arrow_type(qid_type)), schema))
    if not parts:
        empty = StructType(schema.fields + [StructField("rank", IntegerType())])
        return spark.createDataFrame([], empty).select("query_id", "rank", "id", "score")
    cands = parts[0]
    for p in parts[1:]:
        cands = cands.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(*_order())
    return (
        cands.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def knn(corpus, queries, k=DEFAULT_K, size=DEFAULT_SIZE, metric="l2", **cols) -> DataFrame:
    """k candidates, then the best ``size`` of them -> (query_id, rank, id, score)."""
    k, size = _defaults(k, size)
    return vector_topk(corpus, queries, k, metric, **cols).where(F.col("rank") <= size)


def _defaults(k, size):
    """0, None or non-numeric fall back to the defaults, as the command line does."""
    def ok(v, d):
        try:
            v = int(v)
        except (TypeError, ValueError):
            return d
        return v if v > 0 else d

    return ok(k, DEFAULT_K), ok(size, DEFAULT_SIZE)


def knn_by_date(
    corpus, queries, k=DEFAULT_K, size=DEFAULT_SIZE, metric="l2",
    id_col="tweet_id", ts_col="created_at", **cols,
) -> DataFrame:
    """k nearest, re-sorted newest first (score breaks ties; no date sorts last), keep ``size``.

    -> (query_id, rank, id, score)
    """
    k, size = _defaults(k, size)
    cand = vector_topk(corpus, queries, k, metric, id_col=id_col, **cols)
    # candidates are bounded (queries x k): fetch their dates by id
    j = lookup(corpus, cand.drop("rank"), id_col, [F.col(ts_col).alias("_ts")])
    return _newest(j, "_ts", size).select("query_id", "rank", "id", "score")


def _newest(rows: DataFrame, ts_col: str, size: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(
        F.desc_nulls_last(ts_col), F.desc(F.round("score", TIE_DECIMALS)), F.asc("id")
    )
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def bm25(
    corpus: DataFrame,
    queries: DataFrame,
    size: int = DEFAULT_K,
    k1: float = BM25_K1,
    b: float = BM25_B,
    tokenizer: str = "standard",
    id_col: str = "tweet_id",
    text_col: str = "full_text",
    query_id_col: str = "query_id",
    query_text_col: str = "query_text",
    corpus_stats: tuple[int, float] | None = None,
) -> DataFrame:
    """Keyword match (OR of the query's terms) scored with BM25 -> (query_id, rank, id, score).

    ``corpus_stats`` = (document count, average document length) when the
    caller maintains them (e.g. at ingest); otherwise they are observed during
    the single pass that extracts the matches, which are then written once to
    the shared checkpoint folder.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); term score
    idf * tf / (tf + k1 * (1 - b + b * dl / avgdl)), summed over query terms
    (a term repeated in the query counts again). Statistics are global and use
    exact document lengths. Documents matching no term are not returned.
    """
    scored = bm25_scores(corpus, queries, k1, b, tokenizer, id_col, text_col, query_id_col, query_text_col, corpus_stats)
    w = Window.partitionBy("query_id").orderBy(*_order())
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= size)
        .select("query_id", "rank", "id", "score")
    )


def bm25_scores(
    corpus: DataFrame,
    queries: DataFrame,
    k1: float = BM25_K1,
    b: float = BM25_B,
    tokenizer: str = "standard",
    id_col: str = "tweet_id",
    text_col: str = "full_text",
    query_id_col: str = "query_id",
    query_text_col: str = "query_text",
    corpus_stats: tuple[int, float] | None = None,
) -> DataFrame:
    """BM25 of every matching document, unranked (see ``bm25``) -> (query_id, id, score)."""
    docs = corpus.select(F.col(id_col).alias("id"), tokenize(text_col, tokenizer).alias("toks"))
    terms = written(
        queries.select(F.col(query_id_col).alias("query_id"), F.explode(tokenize(query_text_col, tokenizer)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf")),
        "bm25-terms",
    )
    vocabulary = terms.select("term").distinct()
    small = vocabulary.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS and terms.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS
    side = F.broadcast if small else (lambda d: d)
    sized = docs.select("id", F.size("toks").alias("dl"), "toks")
    observed = None
    if corpus_stats is None:
        # corpus statistics are observed on every document while the matches
        # are computed: one pass over the texts, no separate statistics scan
        observed = Observation()
        sized = sized.observe(observed, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    matched = (
        sized.select("id", "dl", F.explode("toks").alias("term"))
        .join(side(vocabulary), "term")
        .groupBy("id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    if observed is not None:
        # the (doc, term, tf) matches are written once to the shared checkpoint
        # folder (cutting lineage); the statistics arrive with that write
        matched = written(matched, "bm25-matches")
        m = observed.get
        corpus_stats = (m["n"], (m["total"] / m["n"]) if m["n"] else 0.0)
    n_docs, avgdl = corpus_stats
    # count(tf), not count(*): both branches then read the same (id, dl, term, tf)
    # aggregate and Spark reuses its exchange instead of tokenizing the corpus again
    dfreq = matched.groupBy("term").agg(F.count("tf").alias("df"))
    idf = F.log(1.0 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(k1) * (1.0 - b + b * F.col("dl") / F.lit(avgdl if avgdl > 0 else 1.0))
    return (
        matched.join(side(dfreq), "term")
        .join(side(terms), "term")
        .select("query_id", "id", (F.col("qtf") * idf * F.col("tf") / (F.col("tf") + norm)).alias("s"))
        .groupBy("query_id", "id")
        .agg(F.sum("s").alias("score"))
    )


def hybrid(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    size: int = DEFAULT_SIZE,
    boost: float = KEYWORD_BOOST,
    fusion: str = "weighted_sum",
    metric: str = "l2",
    id_col: str = "tweet_id",
    vec_col: str = "full_text_vector",
    text_col: str = "full_text",
) -> DataFrame:
    """Vector hits and keyword matches fused per query -> (query_id, rank, id, score, knn_score, text_score).

    The vector side is its top-k (a document outside it scores 0 there), the
    keyword side every match with its exact BM25 (no match scores 0), so a query
    without usable words falls back to pure vector search. fusion: 'weighted_sum'
    (knn + boost * bm25, default), 'minmax' (each side scaled to [0, 1] per
    query first: over the k vector hits, over all matches) or 'rrf' (sum of
    1 / (60 + rank), the keyword rank counted among all matches).
    """
    if fusion not in ("weighted_sum", "minmax", "rrf"):
        raise ValueError("fusion must be weighted_sum, minmax or rrf")
    k, size = _defaults(k, size)
    # both are read several times below: the vector hits (queries x k rows) and the
    # scored matches are written once to the shared checkpoint folder
    kn = written(vector_topk(corpus, queries, k, metric, id_col=id_col, vec_col=vec_col), "hybrid-knn").select(
        "query_id", "id", F.col("score").alias("knn_score"), F.col("rank").alias("knn_rank")
    )
    matches = written(bm25_scores(corpus, queries, id_col=id_col, text_col=text_col), "hybrid-text")
    w = Window.partitionBy("query_id").orderBy(*_order())
    if fusion == "rrf":
        # exact ranks of all matches, however many one query has
        tx = numbered(matches, ["query_id"], _order(), "text_rank")
        wanted = F.col("text_rank") <= k + size
        hit = small_side_join(tx.where(~wanted), kn.select("query_id", "id"), ["query_id", "id"], "left_semi")
        tx = tx.where(wanted).unionByName(hit)
    else:
        # a match outside the vector hits enters the result only if fewer than size such
        # matches rank before it: the k + size best hold them all
        tx = matches.withColumn("text_rank", F.row_number().over(w).cast("long")).where(F.col("text_rank") <= k + size)
        # vector hits that match further down keep their exact score
        hits = small_side_join(matches, kn.select("query_id", "id"), ["query_id", "id"], "left_semi")
        rest = small_side_join(hits, tx.select("query_id", "id"), ["query_id", "id"], "left_anti")
        tx = tx.unionByName(rest.withColumn("text_rank", F.lit(None).cast("long")))
    tx = tx.select("query_id", "id", F.col("score").alias("text_score"), "text_rank")
    j = kn.join(tx, ["query_id", "id"], "full_outer")
    ks, ts = F.coalesce("knn_score", F.lit(0.0)), F.coalesce("text_score", F.lit(0.0))
    if fusion == "weighted_sum":
        score = ks + F.lit(boost) * ts
    elif fusion == "minmax":
        wq = Window.partitionBy("query_id")
        j = j.withColumn("_klo", F.min("knn_score").over(wq)).withColumn("_khi", F.max("knn_score").over(wq))
        j = j.join(matches.groupBy("query_id").agg(F.min("score").alias("_tlo"), F.max("score").alias("_thi")), "query_id", "left")

        def scaled(c, lo, hi):
            inside = F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.lit(1.0))
            return F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(inside)
        score = scaled("knn_score", "_klo", "_khi") + F.lit(boost) * scaled("text_score", "_tlo", "_thi")
    else:
        score = F.coalesce(1.0 / (RRF_K + F.col("knn_rank")), F.lit(0.0)) + F.coalesce(
            1.0 / (RRF_K + F.col("text_rank")), F.lit(0.0)
        )
    return (
        j.withColumn("score", score)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= size)
        .select("query_id", "rank", "id", "score", ks.alias("knn_score"), ts.alias("text_score"))
    )


MAX_LOOKUP_IDS = 1_000       # hit ids that become an IN-list pushed into the scan


def lookup(corpus: DataFrame, hits: DataFrame, id_col: str, cols: list) -> DataFrame:
    """Join ``hits`` (with column ``id``) to ``cols`` of the matching corpus rows.

    The hits (queries x size rows) are written once and joined, broadcast behind a
    row count. When they name at most MAX_LOOKUP_IDS ids, these also become a literal
    IN filter that reaches the Parquet scan, so that row groups whose id statistics
    exclude every hit are skipped.
    """
    hits = written(hits, "hits")
    ids = [r["id"] for r in hits.select("id").distinct().limit(MAX_LOOKUP_IDS + 1).collect()]
    rows = corpus.where(F.col(id_col).isin(ids)) if len(ids) <= MAX_LOOKUP_IDS else corpus
    return small_side_join(rows.select(F.col(id_col).alias("id"), *cols), hits, "id")


DISPLAY = ["username", "created_at", "retweet_count", "favorite_count", "full_text"]


def _display(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id",
        "rank",
        "score",
        "username",
        display_date("created_at").alias("date"),
        "retweet_count",
        "favorite_count",
        snippet("full_text").alias("snippet"),
        F.col("id").alias("tweet_id"),
    )


def result_rows(hits: DataFrame, corpus: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """Hits as display rows -> (query_id, rank, score, username, date, retweet_count,
    favorite_count, snippet, tweet_id). Text over 150 characters is cut with '...'."""
    return _display(lookup(corpus, hits.select("query_id", "rank", "score", "id"), id_col, DISPLAY))


def shown(rows: DataFrame, col: str = "score") -> DataFrame:
    """Scores as they are displayed: rounded to three places."""
    return rows.withColumn(col, F.round(col, 3))


def embed_queries(queries: DataFrame, encoder: EncoderFactory, text_col: str = "query_text") -> DataFrame:
    """Encode query texts with the corpus' encoder -> + query_vector."""
    return embed(queries, encoder, text_col=text_col, out_col="query_vector")


def search(
    corpus: DataFrame,
    queries: DataFrame,
    mode: str = "knn",
    size=DEFAULT_SIZE,
    k=DEFAULT_K,
    encoder: EncoderFactory | None = None,
    id_col: str = "tweet_id",
) -> DataFrame:
    """Search dispatch over a table of queries (query_id, query_text[, query_vector]).

    mode 'knn', 'hybrid' or 'by_date'; result rows as ``result_rows``. When
    queries carry no vector they are encoded with ``encoder``, which must be the
    encoder the corpus was embedded with.
    """
    k, size = _defaults(k, size)
    if "query_vector" not in queries.columns:
        if encoder is None:
            raise ValueError("queries have no query_vector and no encoder was given")
        used = encoder_of(corpus, "full_text_vector")
        name = getattr(encoder, "encoder_name", None)
        if used and name and used != name:
            raise ValueError(f"corpus embedded with {used!r}, queries would use {name!r}")
        queries = embed_queries(queries, encoder)
    if mode == "by_date":
        # dates and display columns come with one lookup
        cand = vector_topk(corpus, queries, k, "l2", id_col=id_col).drop("rank")
        return _display(_newest(lookup(corpus, cand, id_col, DISPLAY), "created_at", size))
    if mode == "hybrid":
        hits = hybrid(corpus, queries, k, size, id_col=id_col)
    elif mode == "knn":
        hits = knn(corpus, queries, k, size, id_col=id_col)
    else:
        raise ValueError("mode must be knn, hybrid or by_date")
    return result_rows(hits, corpus, id_col)


def bm25_corpus_stats(corpus: DataFrame, tokenizer: str = "standard", text_col: str = "full_text") -> tuple[int, float]:
    """(document count, average token count) for ``bm25(corpus_stats=...)``."""
    r = corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokenize(text_col, tokenizer))).alias("a")).first()
    return r["n"], r["a"] or 0.0

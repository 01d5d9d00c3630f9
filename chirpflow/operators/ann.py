"""Approximate and exact nearest-neighbour search over a stored cell index.

The search server answers vector queries from an approximate k-NN index. Here the
index is a Parquet table built once and searched by joins; queries stay a DataFrame.

*Index.* Cells come from Spark ML k-means, fitted on at most ``FIT_ROWS`` vectors
(chosen by a hash of the id); every vector of the corpus is then stored under its
nearest centroid. A row of the index is a *block*: at most ``BLOCK_ROWS`` vectors of
one cell, ids and one packed matrix, with the largest distance of its members from the
centroid. A hot cell is many blocks, so neither building nor searching ever holds a
cell in one task. A small side table keeps centroid, radius and size of each cell.

*Search.* Distances of every query to the centroids, the rank of each cell and a bound
on the best score a cell can hold are columns of a (query, cell) table. The cells to
read are rows of that table; queries that read one cell are packed into blocks of their
own, joined with the index blocks on the cell, and each joined row is one matrix
product that yields the k best of a block for each query. A window with a partial
limit keeps k of them.

``exact=False`` reads the nearest cells only, as many as hold the share of the corpus
that the index was calibrated to: for a bounded sample of its own vectors the exact
neighbours are found when it is built, and the share is the smallest that would have
read the cells of ``target_recall`` of them. ``exact=True`` also reads the cells whose bound still reaches the k-th score found: by the triangle inequality no
vector of cell c is closer to q than d(q, c) - radius(c), so nothing is missed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirpflow.operators import search
from chirpflow.session import scratch_path, written

#: Vectors that teach the centroids; every vector is indexed.
FIT_ROWS = 200_000
BLOCK_ROWS = 4096
#: Vectors waiting for their block to fill, per task.
PENDING_BYTES = 64 << 20
QUERY_BLOCK = 512
#: Centroid matrix that travels with the tasks; a larger one is refused when the index is built.
MAX_CENTROID_BYTES = 64 << 20
#: Blocks of queries are broadcast up to this size, beyond it the join shuffles.
MAX_PROBE_BYTES = 64 << 20
#: Vectors (chosen by a hash of the id) whose neighbours calibrate the approximate search.
CALIBRATION_ROWS = 256
TARGET_RECALL = 0.95
#: Up to so many cells are named in the filter that prunes the index folders.
MAX_NAMED_CELLS = 10_000


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d2 = (m * m).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * (m @ centres.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _finite() -> Column:
    """The vector ``v`` has entries, all of them finite numbers."""
    x = F.transform("v", lambda x: x.cast("double"))
    return F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))


def _fit_centres(vectors: DataFrame, metric: str, n_cells: int, max_iter: int, seed: int, init_mode: str) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.transform("v", lambda x: x.cast("double"))
    sound = vectors.where(_finite())
    lengths = sound.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return np.empty((0, 0))
    dim, total = lengths[0]
    sound = sound.where(F.size("v") == dim)
    if total > FIT_ROWS:
        sound = sound.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / total))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    model = KMeans(k=n_cells, maxIter=max_iter, seed=seed, initMode=init_mode, predictionCol="cell").fit(
        sound.select(array_to_vector(v).alias("features"))
    )
    return np.array(model.clusterCenters(), dtype=np.float64)


def build_ivf_index(
    corpus: DataFrame,
    path: str,
    n_cells: int = 16,
    metric: str = "cosine",
    id_col: str = "tweet_id",
    vec_col: str = "full_text_vector",
    max_iter: int = 10,
    seed: int = 42,
    init_mode: str = "k-means||",
    target_recall: float | None = None,
) -> str:
    """Write the index under ``path``: ``/cells`` (blocks by cell) and ``/centroids``.

    ``target_recall`` calibrates the approximate search (without it, it reads every cell).
    Vectors that are null, of another length than the most frequent one or not finite are
    left out; a corpus without a sound vector gives an empty index."""
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    spark = corpus.sparkSession
    base = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    centres = _fit_centres(base, metric, n_cells, max_iter, seed, init_mode)
    if centres.nbytes > MAX_CENTROID_BYTES:
        raise ValueError(f"{centres.nbytes} bytes of centroids; use fewer cells")
    dim = centres.shape[1] if len(centres) else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not dim:
            return
        pending: dict[int, list] = {}
        held = 0

        def block(cell: int) -> pa.RecordBatch:
            ids, ms, far = zip(*pending.pop(cell), strict=True)
            ids, m = pa.chunked_array(ids).combine_chunks(), np.concatenate(ms)
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int32()), pa.array([len(m)], pa.int64()), pa.array([float(np.concatenate(far).max())]),
                 whole, pa.array([m.tobytes()], pa.binary())],
                ["cell", "n", "far", "ids", "m"],
            )

        for batch in batches:
            at, m = search.vector_rows(batch.column(1), dim)
            if not len(at):
                continue
            m = _unit(m) if metric == "cosine" else m
            distance = _distances(m, centres)
            cell = distance.argmin(axis=1)
            near = distance[np.arange(len(m)), cell]
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                for s in range(0, len(rows), BLOCK_ROWS):
                    part = rows[s : s + BLOCK_ROWS]
                    have = sum(len(x[1]) for x in pending.get(c, ()))
                    if have + len(part) > BLOCK_ROWS:
                        held -= have
                        yield block(c)
                    pending.setdefault(c, []).append((batch.column(0).take(pa.array(at[part])), m[part], near[part]))
                    held += len(part)
            while held * dim * 8 > PENDING_BYTES:
                c = max(pending, key=lambda x: sum(len(p[1]) for p in pending[x]))
                held -= sum(len(x[1]) for x in pending[c])
                yield block(c)
        for c in sorted(pending):
            yield block(c)

    id_type = base.schema["id"].dataType.simpleString()
    schema = f"cell int, n long, far double, ids array<{id_type}>, m binary"
    blocks = base.mapInArrow(pack, schema)
    # a cell's blocks come together, a large cell is split again by its size
    blocks.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(os.path.join(path, "cells"))
    cent = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, c array<double>")
    stats = _blocks(spark, path, id_type).groupBy("cell").agg(F.max("far").alias("radius"), F.sum("n").alias("n"))
    table = written(cent.join(F.broadcast(stats), "cell").coalesce(1), "ann-centroids")
    share = _calibrated_share(base, _blocks(spark, path, id_type), table, metric, target_recall) if target_recall and dim else 1.0
    facts = {"metric": F.lit(metric), "id_type": F.lit(id_type), "share": F.lit(share)}
    table.withColumns(facts).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "centroids"))
    return path


def _calibrated_share(base: DataFrame, index: DataFrame, cent: DataFrame, metric: str, target: float, k: int = search.DEFAULT_K) -> float:
    """Share of the corpus to read, nearest cells first, that holds ``target`` of the true neighbours
    of a sample (its half-way point to all of them, as a margin for other queries)."""
    total = cent.agg(F.sum("n")).first()[0]
    chosen = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(1 << 30)) < max(1, int((1 << 30) * min(1.0, CALIBRATION_ROWS / total)))
    dim = len(cent.select("c").first()[0])
    sample = written(base.where(chosen & _finite() & (F.size("v") == dim)).select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")), "ann-sample")
    truth = search.vector_topk(base, sample, k, metric, id_col="id", vec_col="v").select("query_id", "id")
    cell_of = index.select("cell", F.explode("ids").alias("id"))
    at = cell_of.join(F.broadcast(truth), "id")  # sample x k rows
    bounds = cell_bounds(sample, cent, metric).select("query_id", "cell", "before")
    need = at.join(bounds, ["query_id", "cell"]).agg(F.expr(f"percentile_approx(before, {(1 + target) / 2})")).first()[0]
    return 1.0 if need is None else min(1.0, (need + 1) / total)


def _blocks(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    schema = f"n long, far double, ids array<{id_type}>, m binary, cell int"
    return spark.read.schema(schema).parquet(os.path.join(path, "cells"))


def cell_bounds(queries: DataFrame, cent: DataFrame, metric: str) -> DataFrame:
    """(query_id, v, cell, place, before, best): for every query its unit (cosine) or plain vector and
    each cell: rank by distance, vectors in nearer cells, and the best score the cell can hold.

    ``cent`` has one row a cell and is bounded when the index is built; queries of another
    length than the centroids raise ValueError, null query vectors have no rows."""
    rows = cent.orderBy("cell").collect()
    cells = np.array([r["cell"] for r in rows], dtype=np.int32)
    centres = np.array([r["c"] for r in rows], dtype=np.float64)
    radius = np.array([r["radius"] for r in rows])
    sizes = np.array([r["n"] for r in rows], dtype=np.int64)
    dim = centres.shape[1]
    id_type = queries.schema[0].dataType.simpleString()
    k = len(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.filter(pa.compute.is_valid(batch.column(1)))
            if not given.num_rows:
                continue
            at, m = search.vector_rows(given.column(1), dim)
            if len(at) != given.num_rows:
                raise ValueError(f"a query vector is not {dim} finite numbers")
            m = _unit(m) if metric == "cosine" else m
            d = _distances(m, centres)
            order = np.argsort(d, axis=1, kind="stable")
            gap = np.maximum(np.take_along_axis(d, order, 1) - radius[order], 0.0)
            best = np.maximum(1.0 - gap * gap / 2.0, 0.0) if metric == "cosine" else 1.0 / (1.0 + gap * gap)
            counts = sizes[order]
            each = pa.array(np.repeat(np.arange(len(m)), k))
            ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim)
            vectors = pa.ListArray.from_arrays(ends, pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays(
                [given.column(0).take(each), vectors.take(each), pa.array(cells[order].ravel()),
                 pa.array(np.tile(np.arange(k, dtype=np.int32), len(m))), pa.array((np.cumsum(counts, axis=1) - counts).ravel()), pa.array(best.ravel())],
                ["query_id", "v", "cell", "place", "before", "best"],
            )

    schema = f"query_id {id_type}, v array<double>, cell int, place int, before long, best double"
    return queries.mapInArrow(run, schema)


def _query_blocks(probes: DataFrame) -> DataFrame:
    """(cell, qids, qs): the queries of each cell, at most about QUERY_BLOCK in one row."""
    several = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("parts"))  # a row a cell
    dealt = probes.join(F.broadcast(several), "cell").select(
        "cell", F.struct("query_id", "v").alias("q"), F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part")
    )
    grouped = dealt.groupBy("cell", "part").agg(F.collect_list("q").alias("q"))
    return grouped.select("cell", F.col("q.query_id").alias("qids"), F.col("q.v").alias("qs"))


def _best_of_blocks(index: DataFrame, probes: DataFrame, k: int, metric: str, id_type: str) -> DataFrame:
    """(query_id, id, score): the k best vectors of each (index block, query) pair of ``probes`` rows."""
    spark = index.sparkSession
    packed = written(_query_blocks(probes), "ann-probes")
    named = [r[0] for r in packed.select("cell").distinct().limit(MAX_NAMED_CELLS + 1).collect()]
    if len(named) <= MAX_NAMED_CELLS:
        index = index.where(F.col("cell").isin(named))  # folders of other cells are not read
    size = packed.agg(F.sum(F.size("qids") * (F.size(F.get("qs", F.lit(0))) + 2) * 8)).first()[0] or 0
    joined = index.join(F.broadcast(packed) if size <= MAX_PROBE_BYTES else packed, "cell")
    qid_type = probes.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ids, qids = row.column(0).flatten(), row.column(2).flatten()
                q = row.column(3).flatten()
                q = q.flatten().to_numpy(zero_copy_only=False).reshape(len(qids), -1)
                m = np.frombuffer(row.column(1)[0].as_buffer(), dtype=np.float64).reshape(len(ids), -1)
                score = m @ q.T
                if metric == "l2":
                    d2 = (m * m).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2.0 * score
                    score = 1.0 / (1.0 + np.maximum(d2, 0.0))
                tops = search._block_top(search.sortable(ids), score, k)
                at = np.concatenate(tops)
                of = np.repeat(np.arange(len(qids)), [len(t) for t in tops])
                yield pa.RecordBatch.from_arrays(
                    [qids.take(pa.array(of)), ids.take(pa.array(at)), pa.array(score[at, of])], ["query_id", "id", "score"]
                )

    return joined.select("ids", "m", "qids", "qs").mapInArrow(run, f"query_id {qid_type}, id {id_type}, score double")


def _ranked(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*search._order())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ivf_search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = search.DEFAULT_K,
    nprobe: int = 1,
    exact: bool = True,
    probe_share: float | None = None,
    query_id_col: str = "query_id",
    query_vec_col: str = "query_vector",
) -> DataFrame:
    """k nearest stored vectors per query -> (query_id, rank, id, score).

    Scores as in ``search.vector_topk``: cosine for a cosine index, 1/(1+d^2) for an l2
    index. The first step reads the ``nprobe`` nearest cells of a query and as many more
    as hold ``probe_share`` of the corpus (default when approximate: the calibrated share).
    ``exact=True`` returns exactly the exhaustive answer.
    """
    cent = spark.read.parquet(os.path.join(path, "centroids"))
    total = cent.agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("metric", "id_type", "share")]).first()
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).alias("v"))
    if not total["n"]:
        return spark.createDataFrame([], f"query_id {q.schema[0].dataType.simpleString()}, rank int, id string, score double")
    metric, id_type = total["metric"], total["id_type"]
    share = probe_share if probe_share is not None else (0.0 if exact else total["share"])
    bounds = written(cell_bounds(q, cent, metric), "ann-bounds")
    first_step: Column = (F.col("place") < max(1, nprobe)) | (F.col("before") < share * total["n"])
    index = _blocks(spark, path, id_type)
    first = _best_of_blocks(index, bounds.where(first_step), k, metric, id_type)
    if not exact:
        return _ranked(first, k)
    first = written(_ranked(first, k), "ann-first")
    found = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("kth"))
    rest = bounds.where(~first_step).join(found, "query_id", "left")
    open_ = F.col("found").isNull() | (F.col("found") < k) | (F.col("best") >= F.col("kth") - 10.0**-search.TIE_DECIMALS * 2)
    second = _best_of_blocks(index, rest.where(open_).select("query_id", "v", "cell"), k, metric, id_type)
    return _ranked(first.drop("rank").unionByName(second), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found -> (query_id, k, n_found, recall)."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit")).distinct()
    per = truth.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id")
    return per.agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("n_found")).select("*", (F.col("n_found") / F.col("k")).alias("recall"))


def index_path(spark: SparkSession, name: str = "ivf") -> str:
    """A fresh folder for an index under the cluster's shared checkpoint folder."""
    return scratch_path(spark, name)

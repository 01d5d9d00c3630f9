"""A ledger of document batches: look up keys of all texts in a corpus-wide table
without a broadcast and without one row per key.

Each batch (a few MB of text) is written once to the shared scratch folder, with its
distinct keys as packed arrays, one row per (batch, bucket). A bucket merges the key
arrays of all batches and answers each batch with one value per key; answers and texts
meet again by batch. Rows shuffled: batches x buckets; every group is a bucket's share
of the distinct keys or one batch, whatever the skew of the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.common import bytes_list, rebatched
from chirpflow.session import scratch_path

BATCH_BYTES = 4 << 20
NO_ID = -(2**63)
SCHEMA = "kind string, batch long, bucket int, ids binary, a binary, b binary"


def pack(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_texts(texts: list[bytes]) -> bytes:
    sizes = np.array([len(texts), *map(len, texts)], dtype=np.int64)
    return pack(sizes.tobytes() + b"".join(texts), 4)


def unpack_texts(data: bytes) -> list[bytes]:
    raw = unpack(data)
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], dtype=np.int64))
    starts = [8 * (n + 1), *ends[:-1].tolist()]
    return [raw[s:e] for s, e in zip(starts, ends.tolist(), strict=True)]


def buckets(spark: SparkSession) -> int:
    """Buckets follow the session's shuffle partitions, which the user sizes to the data."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_columns(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return pack(sink.getvalue().to_pybytes(), 4)


def unpack_columns(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(unpack(data)).read_all()


def write_ledger(docs: DataFrame, keys: Callable, name: str, carried: list[str] | None = None) -> str:
    """Write texts and keys. ``keys(ids, texts)`` yields (kind, bucket, a, b) per batch. The ``carried`` columns
    stay with the batch's texts (packed, in ``b``)."""
    path = scratch_path(docs.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in rebatched(batches, BATCH_BYTES, 1):
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64)
            texts = [t or b"" for t in bytes_list(batch.column(1))]
            own = b"" if carried is None else pack_columns(batch.select(range(2, batch.num_columns)))
            rows = [("text", 0, ids.tobytes(), pack_texts(texts), own)]
            rows += [(kind, bucket, b"", a, b) for kind, bucket, a, b in keys(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([number] * len(rows), pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    *[pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3, 4)],
                ],
                ["kind", "batch", "bucket", "ids", "a", "b"],
            )
            number += 1

    docs.select("doc_id", "text", *(carried or ())).mapInArrow(run, SCHEMA).write.partitionBy("kind").parquet(path)
    return path


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA.removeprefix("kind string, ") + ", kind string").parquet(path)
    return rows.where(F.col("kind") == kind).drop("kind")


def split_by(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, arrays...) for each bucket with entries; inside one, the order is kept."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part = order[edges[k] : edges[k + 1]]
        yield (k, *[a[part] for a in arrays])


def in_bucket_order(bucket: np.ndarray) -> np.ndarray:
    """The order in which split_by lists entries, all buckets one after another."""
    return np.argsort(bucket, kind="stable")


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))

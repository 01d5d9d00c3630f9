"""Document fingerprints: a quartile bucket digest with a bounded difference score.

Every window of five bytes gives six byte triplets; each is hashed into one of 128
buckets. The digest holds, per bucket, the quartile its count falls into (two bits),
and a header with the logarithm of the length and two quartile ratios. Two digests
are compared by summed bucket distances plus header distances.

Defined results: a null text counts as empty; an empty text has the all-zero digest;
equal texts have equal digests; texts shorter than five bytes have empty buckets; rows
without a doc_id come first, and rows with the same doc_id are in the order of their
texts' MD5; an empty table gives no rows; a single row is its own next document; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chirpflow.session import read_table, written

BUCKETS = 128
WINDOW = 5
#: A difference of this much or more means likeness 0.
FAR = 250
BATCH_BYTES = 4 << 20
#: Byte permutation for the triplet hash: bytes in the order of their SHA-256.
TABLE = np.array(sorted(range(256), key=lambda i: hashlib.sha256(bytes([i])).digest()), dtype=np.uint8)
#: Offsets back from the newest byte that form the six triplets of a window, each with its salt.
TRIPLETS = [(1, 2, 2), (1, 3, 3), (2, 3, 5), (2, 4, 7), (1, 4, 11), (3, 4, 13)]


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """[n, 128] triplet counts of the texts, computed on their concatenation."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(raw) < WINDOW:
        return out
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    row = owner[WINDOW - 1 :]
    inside = row == owner[: len(raw) - WINDOW + 1]  # windows across two texts do not count
    base = row * (BUCKETS + 1)
    newest = raw[WINDOW - 1 :]
    flat = np.zeros(len(texts) * (BUCKETS + 1), dtype=np.int64)
    for i, j, salt in TRIPLETS:
        h = TABLE[newest ^ np.uint8(salt)]
        h = TABLE[h ^ raw[WINDOW - 1 - i : len(raw) - i]]
        h = TABLE[h ^ raw[WINDOW - 1 - j : len(raw) - j]]
        flat += np.bincount(base + np.where(inside, h >> 1, BUCKETS), minlength=len(flat))
    return flat.reshape(len(texts), BUCKETS + 1)[:, :BUCKETS]


def digests(texts: list[bytes]) -> np.ndarray:
    """[n, 34] bytes: length code, two ratio nibbles, 32 bytes of bucket quartiles."""
    counts = bucket_counts(texts)
    out = np.zeros((len(texts), 2 + BUCKETS // 4), dtype=np.uint8)
    if not len(texts):
        return out
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1 : BUCKETS * k // 4] for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(len(texts), -1, 4)
    out[:, 2:] = codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6
    sizes = np.array([len(t) for t in texts], dtype=np.float64)
    out[:, 0] = np.minimum(255, np.floor(np.log(sizes + 1) / np.log(1.25)))
    top = np.maximum(q3, 1)
    out[:, 1] = (np.minimum(15, 16 * q1 // top) << 4 | np.minimum(15, 16 * q2 // top))[:, 0]
    return out


_PAIRS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
#: Distance of two body bytes: four bucket codes, opposite quartiles count double.
BODY = np.array(
    [sum(_PAIRS[np.arange(256)[:, None] >> s & 3, np.arange(256)[None, :] >> s & 3] for s in (0, 2, 4, 6))]
)[0].astype(np.int64)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference score of digest rows; at least 0, at most 768 + 3 * 24."""
    body = BODY[a[:, 2:], b[:, 2:]].sum(axis=1)

    def header(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.abs(x.astype(np.int64) - y.astype(np.int64))
        return np.minimum(24, np.where(d <= 1, d, 4 * (d - 1)))

    ratios = header(a[:, 1] >> 4, b[:, 1] >> 4) + header(a[:, 1] & 15, b[:, 1] & 15)
    return body + header(a[:, 0], b[:, 0]) + ratios


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, falling to 0 at a difference of FAR."""
    return 1.0 - np.minimum(1.0, difference(a, b) / FAR)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex): the plain operator, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chirpflow.llm.common import bytes_list, rebatched

        for batch in rebatched(batches, BATCH_BYTES, 1):
            d = digests([t or b"" for t in bytes_list(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes().hex() for r in d], pa.string())], ["doc_id", "fingerprint"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _pairs(batches: Iterator[pa.RecordBatch], edges: list) -> Iterator[list[tuple]]:
    """Chunks of (doc_id, text, next text) of bounded bytes from rows (doc_id, text) in order; the first
    and the last row are left in ``edges`` (the last has no next text here)."""
    held, chunk, size = None, [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held is None:
                edges.append(row)
            else:
                chunk.append((*held, row[1]))
                size += len(held[1]) + len(row[1])
            held = row
            if size > BATCH_BYTES:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk
    if held is not None:
        edges.append(held)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(chunk: list[tuple], id_type: pa.DataType) -> list[pa.Array]:
    """The result columns of rows (doc_id, text, next text)."""
    edited = []
    for _, text, following in chunk:
        q = len(text) // 4
        edited.append((text[: len(text) - q] + following[:q]).encode())
    own = digests([c[1].encode() for c in chunk])
    changed = digests(edited)
    # mostly a row's next document is the next row
    nexts = np.concatenate([own[1:], digests([c[2].encode() for c in chunk[-1:]])])
    breaks = [i for i in range(len(chunk) - 1) if chunk[i][2] is not chunk[i + 1][1]]
    if breaks:
        nexts[breaks] = digests([chunk[i][2].encode() for i in breaks])
    return [
        pa.array([c[0] for c in chunk], id_type),
        pa.array([len(c[1]) for c in chunk], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([r.tobytes().hex() for r in own], pa.string()),
        pa.array([r.tobytes().hex() for r in changed], pa.string()),
        pa.array(likeness(own, changed), pa.float64()),
        pa.array(likeness(own, nexts), pa.float64()),
    ]


def compare_with_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter replaced by
    the start of the next document), and the likeness to it and to the next document.

    The texts are shuffled once, into ranges of (doc_id, digest of the text), so that neither a common
    doc_id nor its lack makes a large part. Inside a range each row's next document follows it. The
    first and the last row of every range are kept aside with their texts, and the last ones meet the
    first ones of the next range in a second, small step."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    rows = docs.select("doc_id", text.alias("text")).withColumn("h", F.md5(F.col("text").cast("binary")))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    id_name = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = [*COLUMNS, "kind", "part", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        edges: list[tuple] = []
        for chunk in _pairs(batches, edges):
            n = len(chunk)
            side = [pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*_compared(chunk, id_type), *side], names)
        if edges:
            first, last = edges
            none = [pa.nulls(2, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            side = [pa.array([1, 2], pa.int32()), pa.array([part] * 2, pa.int32()), pa.array([first[1], last[1]], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([first[0], last[0]], id_type), *none, *side], names)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_arrays(_compared([row], id_type), COLUMNS)

    done = written(rows.select("doc_id", "text").mapInArrow(run, f"doc_id {id_name}, {_TYPES}, kind int, part int, text string"), "fingerprints")
    # the range after each range, in a circle: two numbers a range
    near = Window.orderBy("part")
    ring = done.where("kind = 1").select("part", F.lead("part").over(near).alias("next"), F.min("part").over(Window.partitionBy()).alias("least"))
    ring = ring.select("part", F.coalesce("next", "least").alias("next"))
    lasts = done.where("kind = 2").select("part", "doc_id", "text")
    firsts = done.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    edge = lasts.join(ring, "part").join(firsts, "next").select("doc_id", "text", "following")
    closing = edge.mapInArrow(ends, f"doc_id {id_name}, {_TYPES}")
    return done.where("kind = 0").select(*COLUMNS).unionByName(closing)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(read_table(spark, sf_dir, "documents"))

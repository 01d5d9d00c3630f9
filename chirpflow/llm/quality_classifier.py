"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

One pass over the whole texts turns each into a row of statistics (lengths, shares of
character kinds, repetition). Random Fourier features z(x) = sqrt(2/D) cos(Wx + b)
of the standardised statistics approximate a Gaussian kernel. Tasks add up the normal
equations of their labelled rows, one sum for each training fold; the driver solves
them (D + 1 unknowns). Each fold is scored by the model of the other folds, these
scores are counted in bins, and the pool-adjacent-violators rule over the bins gives
the calibration that turns the score of the model of all folds into a probability.

Nothing that is learned depends on the number of rows in size: statistics x D weights,
(D + 1)^2 sums a fold, SCORE_BINS counts. All labelled rows are used.

Defined results: a null text counts as empty, and an empty or blank text is scored as
such; documents without a doc_id are scored, never learned from; several labels of one
doc_id teach their mean, null labels nothing; repeated rows are scored alike (and teach
as often as they occur); with no labelled row at all every score is 0.5, with labels of
one kind every score is that label; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.blocks import sum_blocks
from chirpflow.llm.common import bytes_list, crc_mod, rebatched
from chirpflow.session import read_table, scratch_path

FEATURES = 256
#: Kernel width in units of the standardised statistics, and ridge weight per labelled row.
WIDTH = 3.0
RIDGE = 1e-4
SEED = 13
#: crc32(doc_id) mod FOLDS is the fold; fold HELD_OUT is never learned from.
FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
#: Raw scores are counted in bins of a thousandth between -1 and 2 (beyond: the end bins).
SCORE_BINS = 3001
BATCH_BYTES = 1 << 20
ROWS_AT_ONCE = 4096

KINDS = {"symbol": b"#*$%&|<>{}[]\\^_~=+@`", "loud": b"!?", "stop": b".,;:", "digit": b"0123456789"}
_KIND = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate(KINDS.values(), 1):
    _KIND[list(_chars)] = _k
_KIND[65:91] = len(KINDS) + 1
_KIND[97:123] = len(KINDS) + 2
_KIND[128:] = len(KINDS) + 3
STATISTICS = [
    "words", "bytes", "word_length", "word_length_spread", "longest_word", "symbols", "loud", "stops", "digits", "capitals",
    "capital_words", "bare_words", "distinct_words", "distinct_triples", "top_word", "repeated_lines", "words_a_line",
    "ended_lines", "packed", "longest_repeat",
]


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=len(KINDS) + 4)
    shown = float(sizes.sum())
    letters = max(float(kinds[len(KINDS) + 1 :].sum()), 1.0)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 0
    most_again = 0
    last = None
    for w in words:
        again = again + 1 if w == last else 0
        most_again = max(most_again, again)
        last = w
    return [
        np.log1p(n), np.log1p(len(text)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        *[np.sqrt(kinds[k] / shown) for k in range(1, len(KINDS) + 1)], kinds[len(KINDS) + 1] / letters,
        sum(map(bytes.isupper, words)) / n, sum(not w.isalpha() and w.isascii() for w in words) / n,
        len(counts) / n**0.8, triples / max(n - 2, 1), np.log(max(counts.values())) - 0.5 * np.log(n), 1 - len(set(lines)) / len(lines),
        np.log(n / len(lines)), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        len(zlib.compress(text, 1)) / (len(text) + 20), np.log1p(most_again),
    ]


def write_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row, written to the shared folder."""
    spark = docs.sparkSession
    path = scratch_path(spark, "quality-statistics")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_BYTES, 1):
            rows = np.array([statistics(t or b"") for t in bytes_list(batch.column(1))], dtype=np.float64)
            flat = pa.array(rows.ravel())
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "x"])

    docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, x array<double>").write.parquet(path)
    return spark.read.parquet(path)


def write_labelled(table: DataFrame, labels: DataFrame) -> DataFrame:
    """fold, label, x of the rows that teach, written to the shared folder (``labels``: doc_id, quality)."""
    spark = table.sparkSession
    path = scratch_path(spark, "quality-labelled")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    fold = crc_mod(F.col("doc_id"), FOLDS).cast("int")
    table.where(fold != HELD_OUT).join(known, "doc_id").select(fold.alias("fold"), "label", "x").write.parquet(path)
    return spark.read.parquet(path)


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


class FourierFeatures:
    """z(x) of standardised statistics, with a last constant feature."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0.0, 2.0 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        centred = np.clip((x - self.mean) / self.spread, -8.0, 8.0)
        z = np.cos(centred @ self.w + self.b)
        z *= np.sqrt(2.0 / len(self.b))
        return np.hstack([z, np.ones((len(x), 1))])


def normal_equations(labelled: DataFrame, features: FourierFeatures, tasks: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ZᵀZ, Zᵀy, rows) for each fold."""

    def block(batches: Iterator[pa.RecordBatch]):
        size = len(features.b) + 1
        a, b, n = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS)
        for part, x in _matrices(batches, 2):
            fold, y = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            z = features(x)
            for k in np.unique(fold).tolist():
                mine = z[fold == k]
                a[k] += mine.T @ mine
                b[k] += mine.T @ y[fold == k]
                n[k] += len(mine)
        return a, b, n

    return sum_blocks(labelled, block, tasks)


def ridge(a: np.ndarray, b: np.ndarray, n: float, weight: float = RIDGE) -> np.ndarray:
    """Weights of the features; the constant one is not held down."""
    held = np.full(len(b), weight * max(n, 1.0))
    held[-1] = 1e-9
    return np.linalg.solve(a + np.diag(held), b)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 1.0) * 1000.0), 0, SCORE_BINS - 1).astype(np.int64)


def pooled(rows: np.ndarray, score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order (sums per bin): mean score and mean label of each block."""
    blocks: list[list[float]] = []
    for n, s, y in zip(rows.tolist(), score.tolist(), label.tolist(), strict=True):
        if not n:
            continue
        blocks.append([n, s, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 1] / table[:, 0], table[:, 2] / table[:, 0]


class QualityModel:
    """Scores statistics; small enough to travel with the tasks."""

    def __init__(self, features: FourierFeatures | None, weights: np.ndarray | None, steps: tuple[np.ndarray, np.ndarray] | None):
        self.features, self.weights, self.steps = features, weights, steps

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.weights
        return np.clip(np.interp(raw, *self.steps), 0.0, 1.0)


def fit(labelled: DataFrame) -> QualityModel:
    """The calibrated model of columns fold, label, x."""
    tasks = labelled.rdd.getNumPartitions()

    def moments(batches: Iterator[pa.RecordBatch]):
        total = None
        for part, x in _matrices(batches, 2):
            block = (np.array([float(len(x))]), x.sum(axis=0), (x * x).sum(axis=0))
            total = block if total is None else tuple(a + b for a, b in zip(total, block, strict=True))
        return total

    found = sum_blocks(labelled, moments, tasks)
    if found is None:
        return QualityModel(None, None, None)
    n, first, second = found
    mean = first / n
    features = FourierFeatures(mean, np.sqrt(np.maximum(second / n - mean * mean, 0.0)))
    a, b, rows = normal_equations(labelled, features, tasks)
    weights = ridge(a.sum(axis=0), b.sum(axis=0), rows.sum())
    # a fold is scored by the model of the others; where there is no other, by the model of all
    others = [ridge(a.sum(axis=0) - a[k], b.sum(axis=0) - b[k], rows.sum() - rows[k]) if rows[k] < rows.sum() else weights for k in range(FOLDS)]

    def counted(batches: Iterator[pa.RecordBatch]):
        out = tuple(np.zeros(SCORE_BINS) for _ in range(3))
        for part, x in _matrices(batches, 2):
            fold, y = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ij->i", features(x), np.array(others)[fold])
            for total, value in zip(out, (np.ones(len(y)), raw, y), strict=True):
                total += np.bincount(bin_of(raw), value, SCORE_BINS)
        return out

    return QualityModel(features, weights, pooled(*sum_blocks(labelled, counted, tasks)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality."""
    table = write_statistics(docs)
    model = fit(write_labelled(table, labels))
    id_type = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model(x))], ["doc_id", "score"])

    held: Column = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = table.select("doc_id", "x").mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

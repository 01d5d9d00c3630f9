"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and character 1- to
4-grams are hashed into 2^16 features. The model is a matrix of log probabilities
(languages x features), fitted on a bounded sample of labelled rows and broadcast;
a batch of texts is scored sparsely: the features that occur are looked up per
language and summed per text with numpy.

Defined results: null texts and texts without a letter are "und" with score 0; ties
go to the language first by code point; repeated rows are scored alike; no labelled
rows (or an empty table): everything with a letter is "und"; other columns ignored.
Texts of any length are scored whole; features are looked up CHUNK characters at a time
(a text itself, as code points, is held once). More than MAX_LANGUAGES languages raise
an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.common import crc_mod, rebatched
from chirpflow.session import read_table

FEATURES = 1 << 16
MAX_N = 4
#: About so many labelled rows (chosen by hash of doc_id) fit the model.
FIT_ROWS = 20_000
#: More languages than this would make the broadcast matrix (256 KB each) too large.
MAX_LANGUAGES = 400
BATCH_BYTES = 1 << 20
CHUNK = 1 << 20

_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else a space (built once per worker)."""
    if not _LETTER:
        points = np.arange(0x110000, dtype=np.uint32)
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _LETTER.append(np.where(letters, points, np.uint32(32)))
    return _LETTER[0]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of letters and spaces, each followed by MAX_N spaces, so that
    no n-gram with letters of two texts exists; and the start of each."""
    lowered = [(t or "").lower() + " " * MAX_N for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype="<u4")
    starts = np.cumsum([0] + [len(t) for t in lowered[:-1]])
    return letter_table()[points], starts


def hashed_ngrams(points: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1..MAX_N the feature of the n-gram that ends at each place."""
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(MAX_N):
        shifted = np.full(len(points), 32, dtype=np.uint32)
        shifted[n:] = points[: len(points) - n]
        h = (h ^ (shifted + np.uint32(n + 1))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        yield (h >> np.uint32(16)).astype(np.intp)


def chunked_features(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, features) of the n-grams of each length that end in each CHUNK of places."""
    for at in range(0, len(points), CHUNK):
        before = min(at, MAX_N - 1)
        for feature in hashed_ngrams(points[at - before : at + CHUNK]):
            yield at, feature[before:]


def fit(labelled: DataFrame, rows: int = FIT_ROWS, smooth: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities [languages, features], log priors) from columns text, lang.

    At most about ``rows`` rows, chosen by a hash of doc_id, are read; their counts are
    summed per (language, feature), at most languages x features of them.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = labelled.select("lang").count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / total))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in rebatched(batches, BATCH_BYTES, 0):
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                points, _ = code_points(mine)
                into = found.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + len(mine)
                for _, feature in chunked_features(points):
                    into += np.bincount(feature, minlength=FEATURES)
        for lang, into in found.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(into[at], docs[lang]))],
                ["lang", "feature", "n"],
            )

    table = (
        labelled.select("text", "lang").mapInArrow(counts, "lang string, feature long, n long")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    )
    rows_ = table.toPandas()
    langs = sorted(rows_["lang"].unique().tolist())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model matrix is bounded to {MAX_LANGUAGES}")
    matrix = np.zeros((len(langs), FEATURES))
    prior = np.zeros(len(langs))
    index = rows_["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.intp)
    feature = rows_["feature"].to_numpy()
    n = rows_["n"].to_numpy(dtype=np.float64)
    grams = feature >= 0
    matrix[index[grams], feature[grams]] = n[grams]
    prior[index[~grams]] = n[~grams]
    log_p = np.log((matrix + smooth) / (matrix.sum(axis=1, keepdims=True) + smooth * FEATURES))
    return langs, log_p.astype(np.float32), np.log(prior / max(prior.sum(), 1.0)) if len(langs) else prior


def score(texts: list[str | None], langs: list[str], log_p: np.ndarray, log_prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability per text."""
    points, starts = code_points(texts)
    has_letter = np.add.reduceat((points != 32).astype(np.int64), starts) > 0
    total = np.zeros((len(texts), len(langs)))
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    for at, feature in chunked_features(points):
        first = int(np.searchsorted(starts, at, side="right")) - 1
        last = int(np.searchsorted(starts, at + len(feature)))  # texts first..last-1 lie in this chunk
        begin = np.maximum(starts[first:last] - at, 0)
        for k in range(len(langs)):
            total[first:last, k] += np.add.reduceat(log_p[k][feature], begin, dtype=np.float64)
    total += log_prior
    best = total.argmax(axis=1)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    p = 1.0 / share.sum(axis=1)
    return [langs[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)], np.where(has_letter, p, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p, log_prior = shared.value
        for batch in rebatched(batches, BATCH_BYTES, 1):
            pred, p = score(batch.column(1).to_pylist(), langs, log_p, log_prior)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs.select("doc_id", "text", "lang").where(~F.coalesce(held, F.lit(False))))
    return predict(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )

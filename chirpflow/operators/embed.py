"""Text encoder slot: embed a text column into a fixed-size float vector.

The encoder is a picklable *factory* returning ``list[str] -> ndarray(n, dim)``.
It is built once per Python worker and fed Arrow batches by an iterator Arrow
UDF, so a model is loaded once per worker and never per row. The only encoder
that runs here is a feature-hashing stand-in (lexical, not semantic), because
no sentence-embedding model ships with this environment; a
sentence-transformers factory is provided for clusters that have one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from chirpflow.functions.text import P_TOKEN

# --- Fixed values: encoder defaults ---
DEFAULT_MODEL = "all-MiniLM-L6-v2"
DEFAULT_DIM = 384
ARROW_BATCH = 256   # outer batch (rows per Arrow batch)
INNER_BATCH = 32    # encoder's own sub-batch
# --- end of fixed values ---

EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


class HashingEncoder:
    """Stand-in encoder: lower-cased word tokens hashed into ``dim`` buckets.

    bucket = int(first 8 hex digits of md5(token), 16) mod dim; the vector holds
    token counts per bucket, L2-normalised (all zeros for a text without
    tokens). Deterministic and reproducible in SQL, which is what the tests need.
    """

    def __init__(self, dim: int = 64):
        import regex

        self.dim = dim
        self._tok = regex.compile(P_TOKEN)  # the same word tokens as the Spark tokenizer
        self._cache: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % self.dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        cache = self._cache
        for i, t in enumerate(texts):
            if not t:
                continue
            toks = self._tok.findall(t.lower())
            if not toks:
                continue
            if len(cache) > 2_000_000:  # bound worker memory on huge vocabularies
                cache.clear()
            for tok in set(toks).difference(cache):
                cache[tok] = self.bucket(tok)
            out[i] = np.bincount(list(map(cache.__getitem__, toks)), minlength=self.dim)
        norms = np.sqrt((out * out).sum(axis=1))
        nz = norms > 0
        out[nz] /= norms[nz, None]
        return out.astype(np.float32)


def hashing_encoder(dim: int = 64) -> EncoderFactory:
    def factory():
        return HashingEncoder(dim)

    factory.encoder_name = f"hashing-{dim}"
    factory.dim = dim
    return factory


def sentence_transformer_encoder(model_name: str = DEFAULT_MODEL, device: str | None = None) -> EncoderFactory:
    """Factory for a sentence-transformers model (imported lazily on the worker)."""

    def factory():
        from sentence_transformers import SentenceTransformer  # optional dependency

        model = SentenceTransformer(model_name, device=device)

        def encode(texts: list[str]) -> np.ndarray:
            return np.asarray(
                model.encode(texts, batch_size=min(INNER_BATCH, max(1, len(texts))), show_progress_bar=False),
                dtype=np.float32,
            )

        return encode

    factory.encoder_name = model_name
    factory.dim = DEFAULT_DIM
    return factory


_WORKER_ENCODERS: dict[str, Callable] = {}


def _encoder_udf(factory: EncoderFactory):
    key = getattr(factory, "encoder_name", repr(factory))

    @F.arrow_udf(ArrayType(FloatType(), containsNull=False))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _WORKER_ENCODERS.get(key)
        if enc is None:
            enc = _WORKER_ENCODERS[key] = factory()
        for texts in batches:
            items = ["" if t is None else t for t in texts.cast(pa.string()).to_pylist()]
            parts = [np.asarray(enc(items[i : i + ARROW_BATCH]), dtype=np.float32) for i in range(0, len(items), ARROW_BATCH)]
            matrix = np.concatenate(parts) if parts else np.empty((0, 0), dtype=np.float32)
            # the matrix as it is becomes the list column: offsets and one flat buffer
            ends = pa.array(np.arange(len(items) + 1, dtype=np.int32) * matrix.shape[1])
            yield pa.ListArray.from_arrays(ends, pa.array(matrix.ravel()))

    return encode


def embed(
    df: DataFrame,
    encoder: EncoderFactory,
    text_col: str = "full_text",
    out_col: str = "full_text_vector",
) -> DataFrame:
    """Add ``out_col`` = encoder(text). Missing text is encoded as ''.

    The encoder name is stored in the column metadata so a query can be
    refused when it was embedded with a different encoder.
    """
    name = getattr(encoder, "encoder_name", "unknown")
    return df.withColumn(out_col, _encoder_udf(encoder)(F.col(text_col)).alias(out_col, metadata={"encoder": name}))


def encoder_of(df: DataFrame, col: str) -> str | None:
    return df.schema[col].metadata.get("encoder")


def vector_entries(df: DataFrame, id_col: str, vec_col: str = "full_text_vector") -> DataFrame:
    """Non-zero vector entries in long form -> (id, bucket, weight).

    ``posexplode_outer``: a plain posexplode makes Catalyst infer a
    ``size(vector) > 0`` filter and push it below the exchange, which would run
    the encoder twice; the weight filter drops the empty rows instead.
    """
    return (
        df.select(F.col(id_col), F.posexplode_outer(vec_col).alias("bucket", "weight"))
        .where(F.col("weight") != 0)
    )

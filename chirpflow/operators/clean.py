"""Cleaning and typing of post tables (null text, dates, blanks, long texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpflow.functions.text import MAX_TEXT_CHARS, strip
from chirpflow.functions.times import parse_timestamp


def drop_null_text(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    return df.where(F.col(text_col).isNotNull())  # reaches the scan as IsNotNull


def apply_na_strings(df: DataFrame, na_strings=(), text_col: str = "full_text") -> DataFrame:
    """Turn NA-like strings ('NA', 'null', ...) into null, as a pandas reader does.

    The default (no strings) keeps the csv-module behaviour: only blanks drop.
    """
    if not na_strings:
        return df
    c = F.col(text_col)
    return df.withColumn(text_col, F.when(c.isin(list(na_strings)), F.lit(None)).otherwise(c))


def normalize_created_at(df: DataFrame, col: str = "created_at", on_invalid: str = "null") -> DataFrame:
    """Parse ``col`` into a TIMESTAMP; unparsable values become null ('null') or the row goes ('drop')."""
    if on_invalid not in ("null", "drop"):
        raise ValueError("on_invalid must be 'null' or 'drop'")
    out = df.withColumn(col, parse_timestamp(col)) if dict(df.dtypes)[col] == "string" else df
    return out.where(F.col(col).isNotNull()) if on_invalid == "drop" else out


def clean_posts(
    df: DataFrame,
    text_col: str = "full_text",
    max_chars: int | None = None,
    na_strings=(),
) -> DataFrame:
    """Keep posts whose text is non-blank after a Python-style strip; cut long texts.

    Only a text longer than ``max_chars`` after stripping is replaced (by its
    stripped first ``max_chars`` characters); shorter texts keep their
    whitespace. The default keeps every text whole; pass ``MAX_TEXT_CHARS`` for
    the cut the embedding script makes before encoding.
    """
    df = apply_na_strings(df, na_strings, text_col)
    stripped = strip(text_col)
    kept = df.where(F.coalesce(stripped != "", F.lit(False)))
    if max_chars is None:
        return kept
    return kept.withColumn(
        text_col,
        F.when(F.length(stripped) > max_chars, F.substring(stripped, 1, max_chars)).otherwise(
            F.col(text_col)
        ),
    )


def fill_missing_text(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Missing text reads as '' (still embedded), as the notebook's ``.get(.., "")``."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))

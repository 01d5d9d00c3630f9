"""Helpers shared by the training-data operators.

A *word* is a maximal run of characters other than the six ASCII white-space
characters (``[^\\x20\\x09-\\x0D]+``). ``bytes.split()`` splits UTF-8 text on
exactly those six bytes, so Python kernels and SQL expressions agree.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\u000b\f\r"


def word_array(text: Column) -> Column:
    """Words of a text as an array (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``: the fold a document belongs to."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def bytes_list(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes objects (no decoding)."""
    return column.cast(pa.binary()).to_pylist()


def rebatched(batches: Iterator[pa.RecordBatch], max_bytes: int, text_at: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds more than about ``max_bytes`` of text
    (a single longer text forms a batch of its own)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = batch.column(text_at).cast(pa.large_binary())
        sizes = [0 if v is None else v for v in pa.compute.binary_length(offsets).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def documents_only(docs: DataFrame, *names: str) -> DataFrame:
    """Project to the columns an operator reads, so that extra columns never clash."""
    return docs.select(*[F.col(n) for n in names])


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and serves the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)

"""LM scoring by prediction by partial matching over bytes.

A byte is predicted from the longest context seen in training (up to ORDER bytes); if
it never followed that context, an escape is paid and the next shorter context is
asked, without the bytes the longer one has already ruled out (symbol exclusion).
Escapes are estimated by method D: with t occurrences of d different bytes, a byte
seen n times has (2n - 1) / 2t and the escape d / 2t. A document's code length is the
sum over its bytes; ``score`` is log10 of its probability.

The context trie is never in one place. Its nodes, as packed counts of (context, byte),
are merged in buckets by the last three context bytes: all contexts that extend these
three share a bucket, so the whole climb down to order 3 is local. Orders 0 to 2 are
one table of at most 2^24 (two bytes, byte) entries, in practice some ten thousand,
which is broadcast. Each batch of texts gets back one log probability per distinct
(context, byte) it holds. Word counts for the base score travel the same way.

Defined results: a null or blank text has one token, the end; a row without doc_id is a
training row; repeated rows count each time; an empty table gives no rows; other
columns are ignored. Without training rows every byte has probability 1/256.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm import ledger as L
from chirpflow.session import read_table, scratch_path

ORDER = 5
SHARED = 3  # context bytes that name a bucket
END = 10  # a line feed never stands in a word: the end symbol, and the context before a text
END_WORD = xxhash.xxh3_64_intdigest(b"\n")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HELD_FOLD, FOLDS = 1, 5


def held_out(doc_id: int) -> bool:
    return doc_id != L.NO_ID and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_FOLD


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def events(docs: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code (context bytes, then the byte) of every byte of every text, ends included, and
    where each text's events start."""
    pad = bytes([END]) * order
    streams = [b" ".join(w) for w in docs]
    raw = np.frombuffer(b"".join([pad + s + bytes([END]) for s in streams]), dtype=np.uint8)
    sizes = np.array([len(s) + 1 for s in streams], dtype=np.int64)
    codes = np.zeros(len(raw) - order, dtype=np.uint64)
    for k in range(order + 1):
        codes = codes << np.uint64(8) | raw[k : k + len(codes)]
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]])
    keep = np.ones(len(codes), bool)
    for k in range(order):
        keep[(starts[1:] - order + k)] = False  # events whose byte is padding
    return codes[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sum of their counts; zero sums are left out."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    if not len(codes):
        return codes, counts
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    total = np.add.reduceat(counts, starts)
    return codes[starts][total > 0], total[total > 0]


class Contexts:
    """One order of the trie: (context, byte) counts and per context total and variety."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        ctx = grams >> np.uint64(8)
        starts = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, np.int64)
        self.ctx = ctx[starts]
        self.starts = starts
        self.total = np.add.reduceat(counts, starts) if len(starts) else np.empty(0, np.int64)
        self.kinds = np.diff(np.append(starts, len(grams)))

    @staticmethod
    def find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(where):
            return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what


def tables(grams: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray]) -> list[Contexts]:
    """Contexts of orders 0..order; those below SHARED come from the broadcast table."""
    out: list[Contexts] = [None] * (order + 1)  # type: ignore[list-item]
    for o in range(order, SHARED - 1, -1):
        out[o] = Contexts(*summed(grams & _mask(o + 1), counts))
    for o in range(min(order, SHARED - 1), -1, -1):
        out[o] = Contexts(*summed(low[0] & _mask(o + 1), low[1]))
    return out


def log_probabilities(asked: np.ndarray, trie: list[Contexts]) -> np.ndarray:
    """log10 P(byte | context) of each code under the trie."""
    order = len(trie) - 1
    # count at order o of the bytes that the context one longer has ruled out
    excluded = [None] * (order + 2)
    for o in range(order):
        longer = trie[o + 1]
        at, ok = Contexts.find(trie[o].grams, longer.grams & _mask(o + 1))
        n = np.where(ok, trie[o].counts[at], 0) if len(trie[o].counts) else np.zeros(len(at), np.int64)
        excluded[o + 1] = np.add.reduceat(n, longer.starts) if len(longer.starts) else np.empty(0, np.int64)
    out = np.zeros(len(asked))
    done = np.zeros(len(asked), bool)
    above: tuple[np.ndarray, np.ndarray] | None = None
    for o in range(order, -1, -1):
        t = trie[o]
        at, found = Contexts.find(t.ctx, (asked >> np.uint64(8)) & _mask(o))
        if not len(t.ctx):
            continue
        total, kinds = t.total[at].astype(np.float64), t.kinds[at].astype(np.float64)
        if above is not None:
            total = total - np.where(above[1], excluded[o + 1][above[0]] if len(excluded[o + 1]) else 0, 0)
            kinds = kinds - np.where(above[1], trie[o + 1].kinds[above[0]] if len(trie[o + 1].kinds) else 0, 0)
        g, seen = Contexts.find(t.grams, asked & _mask(o + 1))
        hit = found & seen & ~done
        out[hit] += np.log10((2 * t.counts[g[hit]] - 1) / (2 * total[hit]))
        escape = found & ~seen & ~done & (kinds > 0)
        out[escape] += np.log10(kinds[escape] / (2 * total[escape]))
        done |= hit
        above = (at, found)
    known = int(trie[0].kinds[0]) if len(trie[0].kinds) else 0
    out[~done] -= np.log10(256 - known) if known < 256 else 0.0
    return out


def _gram_bucket(codes: np.ndarray, n: int) -> np.ndarray:
    return (L.mixed(codes >> np.uint64(8) & _mask(SHARED)) % np.uint64(n)).astype(np.int64)


def _concat(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    keys = [np.frombuffer(L.unpack(a), dtype=np.uint64) for a in rows["a"]]
    counts = np.concatenate([np.frombuffer(L.unpack(b), dtype=np.uint32) for b in rows["b"]]).astype(np.int64)
    return keys, np.concatenate(keys), counts


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a bucket and their counts over all batches. Each batch lists a code
    once, so batches are unpacked one by one after a single sort in place: about two words of
    memory an entry, however many batches share the bucket."""
    codes = np.concatenate([np.frombuffer(L.unpack(a), dtype=np.uint64) for a in rows["a"]])
    codes.sort()
    distinct = codes[np.concatenate([[True], codes[1:] != codes[:-1]])]
    del codes
    total = np.zeros(len(distinct), np.int64)
    for a, b in zip(rows["a"], rows["b"], strict=True):
        at = np.searchsorted(distinct, np.frombuffer(L.unpack(a), dtype=np.uint64))
        total[at] += np.frombuffer(L.unpack(b), dtype=np.uint32)
    return distinct, total


def _answer(rows: pd.DataFrame, keys: list[np.ndarray], values: np.ndarray, kind: str) -> pd.DataFrame:
    parts = np.split(values, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame(
        {"kind": kind, "batch": rows["batch"].to_numpy(), "bucket": rows["bucket"].to_numpy(),
         "a": [L.pack(p.tobytes()) for p in parts], "n": 0, "v": 0}
    )


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = docs.sparkSession
    n_buckets = L.buckets(spark)

    def keys(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
        words = [tokens(t) for t in texts]
        held = np.array([held_out(int(i)) for i in ids], bool)
        codes, starts = events(words, order)
        sizes = np.diff(np.append(starts, len(codes)))
        marked = codes << np.uint64(1) | np.repeat(held, sizes).astype(np.uint64)
        marked, counts = np.unique(marked, return_counts=True)
        counts[(marked & np.uint64(1)) == 1] = 0
        codes = marked >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.add.reduceat(counts, first).astype(np.uint32)
        codes = codes[first]
        for k, c, n in L.split_by(_gram_bucket(codes, n_buckets), n_buckets, codes, counts):
            yield "gram", k, L.pack(c.tobytes()), L.pack(n.tobytes())
        low, n = summed(codes & _mask(SHARED), counts.astype(np.int64))
        for k, c, x in L.split_by((low % np.uint64(n_buckets)).astype(np.int64), n_buckets, low, n.astype(np.uint32)):
            yield "low", k, L.pack(c.tobytes()), L.pack(x.tobytes())
        train: Counter = Counter()
        other: set = set()
        for w, h in zip(words, held.tolist(), strict=True):
            other.update(w) if h else train.update(w)
        other -= train.keys()
        values = np.fromiter(map(xxhash.xxh3_64_intdigest, [*train, *other]), np.uint64, len(train) + len(other))
        values = np.append(values, np.uint64(END_WORD))
        number = np.array([*train.values(), *[0] * len(other), int((~held).sum())], dtype=np.uint32)
        at = np.argsort(values)
        values, number = values[at], number[at]
        for k, c, x in L.split_by((values % np.uint64(n_buckets)).astype(np.int64), n_buckets, values, number):
            yield "word", k, L.pack(c.tobytes()), L.pack(x.tobytes())

    path = L.write_ledger(docs, keys, "ppm")

    def merge_low(rows: pd.DataFrame) -> pd.DataFrame:
        _, codes, counts = _concat(rows)
        codes, counts = summed(codes, counts)
        return pd.DataFrame({"a": [codes.tobytes()], "b": [counts.tobytes()]})

    merged = L.read_kind(spark, path, "low").groupBy("bucket").applyInPandas(merge_low, "a binary, b binary").collect()
    low = summed(
        np.concatenate([np.frombuffer(r["a"], np.uint64) for r in merged] + [np.empty(0, np.uint64)]),
        np.concatenate([np.frombuffer(r["b"], np.int64) for r in merged] + [np.empty(0, np.int64)]),
    )
    shared = spark.sparkContext.broadcast(low)

    def grams(rows: pd.DataFrame) -> pd.DataFrame:
        distinct, total = _merged(rows)
        trie = tables(distinct[total > 0], total[total > 0], order, shared.value)
        log_p = log_probabilities(distinct, trie).astype(np.float32)
        answers = [
            L.pack(log_p[np.searchsorted(distinct, np.frombuffer(L.unpack(a), dtype=np.uint64))].tobytes()) for a in rows["a"]
        ]
        return pd.DataFrame(
            {"kind": "gram", "batch": rows["batch"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "a": answers, "n": 0, "v": 0}
        )

    def vocabulary(rows: pd.DataFrame) -> pd.DataFrame:
        parts, values, counts = _concat(rows)
        distinct, at = np.unique(values, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        out = _answer(rows, parts, total[at], "word")
        out.iloc[0, out.columns.get_loc("n")] = int(total.sum())
        out.iloc[0, out.columns.get_loc("v")] = int((total > 0).sum())
        return out

    schema = "kind string, batch long, bucket int, a binary, n long, v long"
    answers = L.read_kind(spark, path, "gram").groupBy("bucket").applyInPandas(grams, schema)
    answers = answers.unionByName(L.read_kind(spark, path, "word").groupBy("bucket").applyInPandas(vocabulary, schema))
    answer_path = scratch_path(spark, "ppm-answers")
    answers.write.parquet(answer_path)
    answers = spark.read.parquet(answer_path)
    sums = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, n_kinds = int(sums["n"] or 0), int(sums["v"] or 0)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        text = rows[rows["kind"] == "text"].iloc[0]
        ids = np.frombuffer(text["ids"], dtype=np.int64)
        words = [tokens(t) for t in L.unpack_texts(text["a"])]

        def values(kind: str, dtype: type) -> np.ndarray:
            part = rows[rows["kind"] == kind].sort_values("bucket")
            return np.concatenate([np.frombuffer(L.unpack(a), dtype=dtype) for a in part["a"]])

        codes, starts = events(words, order)
        distinct, at = np.unique(codes, return_inverse=True)
        log_p = np.empty(len(distinct), np.float64)
        log_p[L.in_bucket_order(_gram_bucket(distinct, n_buckets))] = values("gram", np.float32)
        score = np.add.reduceat(log_p[at], starts)
        kinds = [*set().union(*words)]
        hashed = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds)), np.uint64(END_WORD))
        place = np.argsort(hashed)
        counts = np.empty(len(hashed), np.int64)
        counts[place[L.in_bucket_order((hashed[place] % np.uint64(n_buckets)).astype(np.int64))]] = values("word", np.int64)
        per_token = np.log10((counts + 0.5) / (n_train + 0.5 * (n_kinds + 1)))
        number = dict(zip(kinds, range(len(kinds)), strict=True))
        flat = np.fromiter((n for w in words for n in (*map(number.__getitem__, w), len(kinds))), np.int64)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x == L.NO_ID else int(x) for x in ids], dtype="Int64"),
                "held_out": [held_out(int(x)) for x in ids],
                "n_tokens": lengths,
                "n_known": np.add.reduceat((counts > 0).astype(np.int64)[flat], begin),
                "train_tokens": n_train,
                "base_score": np.add.reduceat(per_token[flat], begin),
                "score": score,
                "n_bytes": np.diff(np.append(starts, len(codes))),
            }
        )

    own = L.read_kind(spark, path, "text").select(F.lit("text").alias("kind"), "batch", "bucket", "ids", "a")
    both = own.unionByName(answers.select("kind", "batch", "bucket", F.lit(None).cast("binary").alias("ids"), "a"))
    return both.groupBy("batch").applyInPandas(
        gather,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, n_bytes long",
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))

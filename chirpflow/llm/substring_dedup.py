"""Substring dedup by super-k-mer partitioning.

Every run of 13 words (a window) that also starts in a document with a smaller doc_id
is repeated; each word under a repeated window is removed. A window's *minimiser* is
the smallest hash of its four-word pieces. Consecutive windows with one minimiser form
a *super-k-mer*, which travels as one packed string of words to the bucket of its
minimiser, so each bucket sees all copies of a window; there windows are sorted and
their smallest document found by comparing the words themselves.

Two steps keep the traffic small and even. First only the minimisers travel (packed
per batch of texts): one that occurs in a single document cannot hold a repeated
window. Then equal super-k-mers are reduced to one row with their smallest doc_id
before the buckets sort. A minimiser in more than ``HOT`` documents is dealt out window
by window (bucket = hash of the window), so no bucket holds a frequent passage's
surroundings from all documents; of such a window a batch sends its smallest document
once, however often it occurs there, and keeps the places to itself.

Defined results: null and blank texts have no words; words are kept as they are; rows
with the same doc_id count as one document (a window is repeated only if a *smaller*
doc_id has it); rows without doc_id come last in the order; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from chirpflow.llm import ledger as L
from chirpflow.session import read_table

WINDOW = 13
PIECE = 4
#: A minimiser in more documents than this is dealt out window by window.
HOT = 200
#: Windows per super-k-mer at most (repetitive texts give long runs).
LONGEST = 48
LAST = 2**63 - 1  # order of a missing doc_id
OWN = -1  # marks a frequent window: its places stay with the batch

_ODD = np.random.RandomState(7).randint(1, 2**62, size=PIECE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimisers(words: list[bytes]) -> np.ndarray:
    """Minimiser of each 13-word window, in order."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    m = len(words) - PIECE + 1
    pieces = np.zeros(m, dtype=np.uint64)
    for k in range(PIECE):
        pieces += L.mixed(h[k : k + m]) * _ODD[k]
    pieces = L.mixed(pieces)
    least = pieces[:n].copy()
    for k in range(1, WINDOW - PIECE + 1):
        np.minimum(least, pieces[k : k + n], out=least)
    return least


def runs(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, windows) of the super-k-mers: runs of one minimiser, cut at LONGEST."""
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(start, len(least)))
    if size.max() > LONGEST:
        parts = -(-size // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        full = np.repeat(size, parts)
        start = np.repeat(start, parts) + inner * LONGEST
        size = np.minimum(LONGEST, full - inner * LONGEST)
    return start, size


def _batch_minimisers(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minimisers of a batch, sorted, with the number of documents that have each."""
    per_doc = [np.unique(minimisers(t.split())) for t in texts]
    docs = np.repeat(ids, [len(x) for x in per_doc])
    values = np.concatenate([*per_doc, np.empty(0, np.uint64)])
    order = np.lexsort((docs, values))
    values, docs = values[order], docs[order]
    new_value = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    new_pair = new_value | np.concatenate([[True], docs[1:] != docs[:-1]]) if len(values) else new_value
    starts = np.flatnonzero(new_value)
    return values[starts], np.add.reduceat(new_pair.astype(np.int64), starts) if len(starts) else starts


def _cut(values: np.ndarray) -> bytes:
    """The top 40 bits of each value, packed."""
    return (values >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _uncut(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _spread(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """In one bucket of minimisers: tell each batch 0 (one document), 1 (several), 2 (hot)."""
        keys = [_uncut(a) for a in rows["a"]]
        docs = np.concatenate([np.frombuffer(L.unpack(b), dtype=np.uint8) for b in rows["b"]])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        # rows of one doc_id in two batches count twice: more travels then, nothing is lost
        total = np.bincount(at, weights=docs)[at]
        flag = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
        parts = np.split(flag, np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame(
            {"batch": rows["batch"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "a": [L.pack(p.tobytes()) for p in parts]}
        )

    return run


def _with_texts(texts: DataFrame, answers: DataFrame, *names: str) -> GroupedData:
    """Each batch's text row (bucket -1, with the columns ``names`` of the ledger) and its answers, by batch."""
    both = texts.select("batch", F.lit(-1).alias("bucket"), *names).unionByName(
        answers.select("batch", "bucket", "a"), allowMissingColumns=True
    )
    return both.groupBy("batch")


def _super_kmers(n_buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        text = rows[rows["bucket"] < 0].iloc[0]
        ids = np.frombuffer(text["ids"], dtype=np.int64)
        answers = rows[rows["bucket"] >= 0].sort_values("bucket")
        flags = np.concatenate([np.frombuffer(L.unpack(a), dtype=np.uint8) for a in answers["a"]] + [np.empty(0, np.uint8)])
        docs = [t.split() for t in L.unpack_texts(text["a"])]
        least = [minimisers(w) for w in docs]
        values = np.unique(np.concatenate([*least, np.empty(0, np.uint64)]))
        flag = np.zeros(len(values), np.uint8)
        flag[L.in_bucket_order((values % np.uint64(n_buckets)).astype(np.int64))] = flags
        places: dict[tuple[int, bytes], list[int]] = {}  # (key, packed string) -> doc, at, start, doc, ...
        frequent: dict[tuple[int, bytes], list[int]] = {}  # the same for windows under a hot minimiser
        for i, (words, mins) in enumerate(zip(docs, least, strict=True)):
            begin, size = runs(mins)
            if not len(begin):
                continue
            kind = flag[np.searchsorted(values, mins[begin])]
            shared = np.flatnonzero(kind)
            owner = LAST if ids[i] == L.NO_ID else int(ids[i])
            names = mins[begin].view(np.int64)
            for j in shared.tolist():
                s, n = int(begin[j]), int(size[j])
                if kind[j] == 1:
                    found = (int(names[j]), b" ".join(words[s : s + n + WINDOW - 1]))
                    places.setdefault(found, []).extend((owner, i, s))
                else:
                    for x in range(s, s + n):
                        w = b" ".join(words[x : x + WINDOW])
                        frequent.setdefault((xxhash.xxh3_64_intdigest(w) - 2**63, w), []).extend((owner, i, x))
        for number, (found, refs) in enumerate(frequent.items()):
            places[found] = [min(refs[::3]), OWN, number]
        dealt: dict[int, tuple[list[bytes], list[int], list[int]]] = {}
        for (key, packed), refs in places.items():
            strings, counts, flat = dealt.setdefault(key % (4 * n_buckets), ([], [], []))
            strings.append(packed)
            counts.append(len(refs) // 3)
            flat += refs
        a = [L.pack(b"\n".join(x[0])) for x in dealt.values()]
        b = [L.pack(np.array([len(x[1]), *x[1], *x[2]], np.int64).tobytes()) for x in dealt.values()]
        bucket = [*dealt]
        if frequent:  # the places pass the buckets in a group of the batch's own
            bucket.append(-1 - xxhash.xxh3_64_intdigest(int(text["batch"]).to_bytes(8, "little")) % (1 << 30))
            a.append(b"")
            b.append(_listed([np.array(x, np.int64) for x in frequent.values()]))
        return pd.DataFrame({"batch": int(text["batch"]), "bucket": np.array(bucket, np.int32), "a": a, "b": b})

    return run


def _listed(refs: list[np.ndarray]) -> bytes:
    """Lists of (document, at, start), packed."""
    return L.pack(np.concatenate([[len(refs)], [len(x) // 3 for x in refs], *refs]).astype(np.int64).tobytes())


def _unlisted(data: bytes) -> list[np.ndarray]:
    numbers = np.frombuffer(L.unpack(data), dtype=np.int64)
    n = int(numbers[0])
    return np.split(numbers[n + 1 :].reshape(-1, 3), np.cumsum(numbers[1 : n + 1])[:-1])


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """In one bucket: sort all windows of its super-k-mers with their document; the first
    copy of a window has the smallest. Returns per batch the places (at, start, mask of
    repeated windows) that stand in a larger document (at OWN: start is the number of a frequent window,
    all of whose places in the batch are repeated). Rows of places pass through (bucket 1)."""
    if int(rows["bucket"].iloc[0]) < 0:
        return pd.DataFrame({"batch": rows["batch"].to_numpy(), "bucket": 1, "a": rows["b"].to_numpy()})
    refs: list[np.ndarray] = []
    batches: list[int] = []
    windows: list[tuple[bytes, int, int, int]] = []
    mins: list[np.ndarray] = []
    for batch, strings, places in zip(rows["batch"], rows["a"], rows["b"], strict=True):
        for packed, place in zip(L.unpack(strings).split(b"\n"), _unlisted(places), strict=True):
            words = packed.split(b" ")
            r, low, size = len(refs), int(place[:, 0].min()), len(words) - WINDOW + 1
            refs.append(place)
            batches.append(int(batch))
            mins.append(np.empty(size, np.int64))
            windows += [(b" ".join(words[i : i + WINDOW]), low, r, i) for i in range(size)]
    windows.sort()
    last, low = None, 0
    for w, d, r, i in windows:
        if w != last:
            last, low = w, d
        mins[r][i] = low
    out: dict[int, list[np.ndarray]] = {}
    for batch, places, low in zip(batches, refs, mins, strict=True):
        if low[0] == low[-1] == places[0, 0] and len(places) == 1 and (low == low[0]).all():
            continue
        bits = (low[None, :] < places[:, :1]) @ (np.int64(1) << np.arange(len(low), dtype=np.int64))
        hit = bits != 0
        if hit.any():
            out.setdefault(batch, []).append(np.column_stack([places[hit, 1:], bits[hit]]))
    return pd.DataFrame(
        {"batch": np.array([*out], np.int64), "bucket": 0, "a": [L.pack(np.concatenate(x).tobytes()) for x in out.values()]}
    )


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _without(text: bytes, removed: np.ndarray) -> bytes:
    """The text without the removed words; where words stood, one space separates the rest."""
    if not removed.any():
        return text
    out, at, gap = [], 0, False
    for m, gone in zip(_WORD.finditer(text), removed.tolist(), strict=True):
        if gone:
            if not gap:
                out.append(text[at : m.start()])
            gap = True
        else:
            if gap:
                at = m.start()
                if out and out[-1] and not out[-1][-1:].isspace():
                    out.append(b" ")
            gap = False
        if gap:
            at = m.end()
    if not gap:
        out.append(text[at:])
    return b"".join(out)


def _decided(rows: pd.DataFrame) -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
    """(text, words, which of them are removed) of a batch's texts, in order."""
    text = rows[rows["bucket"] < 0].iloc[0]
    found = rows[rows["bucket"] >= 0]
    hits: dict[int, list] = {}
    for a in found.loc[found["bucket"] == 0, "a"]:
        for at, start, mask in np.frombuffer(L.unpack(a), dtype=np.int64).reshape(-1, 3).tolist():
            hits.setdefault(at, []).append((start, mask))
    whole = {number for number, _ in hits.pop(OWN, [])}
    for a in found.loc[found["bucket"] == 1, "a"]:
        for number, refs in enumerate(_unlisted(a)):
            later = refs if number in whole else refs[refs[:, 0] > refs[:, 0].min()]
            for at, start in later[:, 1:].tolist():
                hits.setdefault(at, []).append((start, 1))
    for i, t in enumerate(L.unpack_texts(text["a"])):
        words = t.split()
        removed = np.zeros(len(words), bool)
        if i in hits:
            mark = np.zeros(len(words) + 1, np.int64)
            for start, mask in hits[i]:
                at = start
                while mask:
                    if mask & 1:
                        mark[at] += 1
                        mark[at + WINDOW] -= 1
                    mask >>= 1
                    at += 1
            removed = np.cumsum(mark)[:-1] > 0
        yield t, words, removed


def _remove(with_text: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(rows[rows["bucket"] < 0].iloc[0]["ids"], dtype=np.int64)
        n_words, n_removed, sha, kept = [], [], [], []
        for t, words, removed in _decided(rows):
            n_words.append(len(removed))
            n_removed.append(int(removed.sum()))
            left = [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]
            sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            kept.append(_without(t, removed).decode("utf-8", "replace") if with_text else "")
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x == L.NO_ID else int(x) for x in ids], dtype="Int64"),
                "n_words": n_words, "n_removed": n_removed, "kept_sha256": sha, "kept": kept,
            }
        )

    return run


def _cut_rows(table: pa.Table) -> pa.Table:
    """In one batch: its carried columns, the texts without what is removed, and whether that is anything."""
    rows = table.to_pandas()
    carried = L.unpack_columns(rows[rows["bucket"] < 0].iloc[0]["b"])
    texts, changed = [], []
    for (t, _, removed), missing in zip(_decided(rows), carried.column("_no_text").to_pylist(), strict=True):
        changed.append(bool(removed.any()))
        if changed[-1]:
            t = _without(t, removed).decode("utf-8", "replace").encode()
        texts.append(None if missing else t)
    text = pa.array(texts, pa.binary()).view(pa.string())
    return carried.drop_columns("_no_text").append_column("_text", text).append_column("_changed", pa.array(changed, pa.bool_()))


def _found(docs: DataFrame, hot: int, carried: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The batches' text rows and what is removed from them."""
    spark = docs.sparkSession
    n_buckets = L.buckets(spark)

    def keys(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
        values, counts = _batch_minimisers(ids, texts)
        for k, v, c in L.split_by((values % np.uint64(n_buckets)).astype(np.int64), n_buckets, values, counts):
            yield "key", k, _cut(v), L.pack(np.minimum(c, 255).astype(np.uint8).tobytes())

    path = L.write_ledger(docs, keys, "dedup", carried)
    texts = L.read_kind(spark, path, "text")
    flags = L.read_kind(spark, path, "key").groupBy("bucket").applyInPandas(_spread(hot), "batch long, bucket int, a binary")
    rows = _with_texts(texts, flags, "ids", "a").applyInPandas(_super_kmers(n_buckets), "batch long, bucket int, a binary, b binary")
    return texts, rows.groupBy("bucket").applyInPandas(_repeated, "batch long, bucket int, a binary")


def remove_repeats(docs: DataFrame, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the text without repeated passages."""
    texts, hits = _found(docs, hot)
    return _with_texts(texts, hits, "ids", "a").applyInPandas(
        _remove(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def cut_documents(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of ``text`` (``n_chars`` follows, where there is such a column).

    The other columns travel with the texts of their batch, so a row keeps what is its own whatever its
    doc_id, and no join brings the cut texts back; a null text stays null."""
    names = [f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"]
    own = docs.toDF(*["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)])
    own = own.withColumns({"doc_id": F.col(f"_c{docs.columns.index('doc_id')}"), "_no_text": F.col("text").isNull()})
    texts, hits = _found(own, HOT, [*names, "_no_text"])
    schema = StructType([*own.select(*names).schema.fields, StructField("_text", StringType()), StructField("_changed", BooleanType())])
    out = _with_texts(texts, hits, "ids", "a", "b").applyInArrow(_cut_rows, schema)
    n_chars = F.char_length("_text")
    cols = []
    for i, f in enumerate(docs.schema.fields):
        kept = F.col("_text") if f.name == "text" else F.col(f"_c{i}")
        if f.name == "n_chars":
            kept = F.when(F.col("_changed"), n_chars).otherwise(kept)
        cols.append(kept.cast(f.dataType).alias(f.name))
    return out.select(*cols)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


OP5_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
p as (
  select doc_id, i, array_to_string(words[i:i + 12], ' ') as win
  from w, lateral (select unnest(range(1, greatest(len(words) - 11, 1))) as i) x),
m as (select win, min(doc_id) as low from p group by win),
h as (select p.doc_id, p.i from p join m on m.win = p.win where m.low < p.doc_id),
gone as (select distinct doc_id, i + k as pos from h, lateral (select unnest(range(0, 13)) as k) x),
g as (select doc_id, count(*) as n from gone group by doc_id),
e as (
  select w.doc_id, u.x, u.pos from w, lateral (select unnest(words) as x, unnest(range(1, len(words) + 1)) as pos) u),
k as (
  select e.doc_id, string_agg(e.x, ' ' order by e.pos) as kept
  from e anti join gone on gone.doc_id = e.doc_id and gone.pos = e.pos group by e.doc_id)
select w.doc_id, cast(len(w.words) as bigint) as n_words, coalesce(g.n, 0) as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from w left join g on g.doc_id = w.doc_id left join k on k.doc_id = w.doc_id
"""

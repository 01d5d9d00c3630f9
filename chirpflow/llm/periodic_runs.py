"""Periodic runs of words by longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q, at least
max(MIN_WORDS, 2 q) words long, that no neighbouring word extends with period q.

*Grid.* The words i with w[i] = w[i + p] of a run of period p form a stretch of at least
g = max(p, MIN_WORDS - p) places, so one of them is a multiple of g: for each p only
those places are looked at (n/g of them, harmonic in sum), and only where the two words
agree the extension of period p to both sides is asked for.

*Extensions.* Places whose number modulo 31 is in the difference cover are samples.
From any two places, fewer than 31 steps lead to two samples at once: that many words
are compared directly, and most questions end there. For the documents where one does
not, the suffixes at samples alone are sorted (31 words packed into a few keys, then
doubling of ranks), the common prefixes of neighbours are read off the ranks, and the
smallest of a range of them (sparse table) answers the rest. The same on the reversed
words gives the extension to the left.

Documents are handled many at a time in one array; equal words of two documents count
as different. A run found with a multiple of its period has the same ends, so the
smallest period found for two ends is its smallest period.

Defined results: a null, empty or blank text has no words and no runs; null doc_id: no
planted repetition (see ``repeated_tails``); repeated rows are treated alike; texts of
any length are handled whole, memory in proportion to the longest text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chirpflow.llm.common import bytes_list, rebatched
from chirpflow.session import read_table

#: Shortest run in words.
MIN_WORDS = 12
#: A perfect difference set modulo 31 (each difference occurs once).
COVER_MOD = 31
COVER = (1, 5, 11, 24, 25, 27)
BATCH_BYTES = 2 << 20
#: Questions answered at once.
QUESTIONS = 1 << 20


def _first_of_pair() -> np.ndarray:
    """For each difference d the sample class c such that c + d is a sample class too."""
    table = np.full(COVER_MOD, -1, dtype=np.int64)
    for a in COVER:
        for b in COVER:
            if a != b:
                table[(b - a) % COVER_MOD] = a
    assert (table[1:] >= 0).all()
    return table


FIRST = _first_of_pair()
#: Steps from a residue to the next sample class, and the number of a class inside its period.
TO_NEXT = np.array([min((c - r) % COVER_MOD for c in COVER) for r in range(COVER_MOD)], dtype=np.int64)
CLASS = np.full(COVER_MOD, -1, dtype=np.int64)
CLASS[list(COVER)] = np.arange(len(COVER))


def steps_to_samples(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Fewer than 31 steps that lead from both i and j to samples."""
    gap = (j - i) % COVER_MOD
    return np.where(gap == 0, TO_NEXT[i % COVER_MOD], (FIRST[gap] - i) % COVER_MOD)


def direct_extension(w: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Number of equal words from i < j on, at most ``limit`` (below 31) of them."""
    same = np.zeros(len(i), dtype=np.int64)
    live = np.arange(len(i))
    for t in range(COVER_MOD):
        live = live[(limit[live] > t) & (j[live] + t < len(w))]
        live = live[w[i[live] + t] == w[j[live] + t]]
        if not len(live):
            break
        same[live] += 1
    return same


class SampledSuffixes:
    """Extensions from sample to sample: sorted sample suffixes, their common prefixes, range minima."""

    def __init__(self, w: np.ndarray):
        """``w``: words as integers >= 1; no two suffixes may agree beyond the end."""
        self.n = len(w)
        periods = self.n // COVER_MOD + 1
        size = periods * len(COVER)
        bits = int(w.max(initial=1)).bit_length()
        per_key = 62 // bits
        padded = np.zeros((periods + 2) * COVER_MOD, dtype=np.int64)
        padded[: self.n] = w
        starts = (np.arange(periods)[:, None] * COVER_MOD + np.array(COVER)).ravel()
        keys = []
        for first in range(0, COVER_MOD, per_key):
            key = np.zeros(size, dtype=np.int64)
            for k in range(first, min(first + per_key, COVER_MOD)):
                key = (key << bits) | padded[starts + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(size, dtype=bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        ranks = [self._ranked(order, new, size)]
        width = 1
        while ranks[-1].max(initial=0) < size - 1 and width < periods:
            now = ranks[-1]
            later = np.zeros(size, dtype=np.int64)
            later[: size - width * len(COVER)] = now[width * len(COVER) :] + 1
            pair = now * (size + 1) + later
            order = np.argsort(pair, kind="stable")
            new = np.zeros(size, dtype=bool)
            new[1:] = np.diff(pair[order]) != 0
            ranks.append(self._ranked(order, new, size))
            width *= 2
        self.place = np.empty(size, dtype=np.int64)
        self.place[order] = np.arange(size)
        common = self._neighbours(ranks, order, padded, starts)
        self.minima = [common]
        while (half := 1 << (len(self.minima) - 1)) * 2 <= size:
            below = self.minima[-1]
            self.minima.append(np.minimum(below[:-half], below[half:]))

    @staticmethod
    def _ranked(order: np.ndarray, new: np.ndarray, size: int) -> np.ndarray:
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank

    @staticmethod
    def _neighbours(ranks: list[np.ndarray], order: np.ndarray, padded: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Common prefix, in words, of each suffix in sorted order with the one before it."""
        size = len(order)
        a, b = order[:-1].copy(), order[1:].copy()
        words = np.zeros(size - 1, dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            inside = (a < size) & (b < size)
            same = inside & (ranks[level][np.minimum(a, size - 1)] == ranks[level][np.minimum(b, size - 1)])
            jump = len(COVER) << level
            a, b = a + jump * same, b + jump * same
            words += (COVER_MOD << level) * same
        live = np.flatnonzero((a < size) & (b < size))
        at, bt = starts[a[live]], starts[b[live]]
        for t in range(COVER_MOD):
            ok = (padded[at + t] == padded[bt + t]) & (padded[at + t] > 0)
            live, at, bt = live[ok], at[ok], bt[ok]
            if not len(live):
                break
            words[live] += 1
        return np.concatenate([[0], words]).astype(np.int32)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at samples i and j (i differs from j)."""
        def sample(x):
            return self.place[x // COVER_MOD * len(COVER) + CLASS[x % COVER_MOD]]

        a, b = sample(i), sample(j)
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k) + 1])
        return out


def grid_matches(w: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid places whose word recurs a period later, some QUESTIONS at a time.

    ``w``: the documents' words one after another, the longest document first."""
    ends = np.cumsum(lengths)
    places: list[np.ndarray] = []
    periods: list[np.ndarray] = []
    held = 0
    for p in range(1, int(lengths.max(initial=0)) // 2 + 1):
        fitting = int(np.searchsorted(-lengths, -max(2 * p, MIN_WORDS), side="right"))
        if not fitting:
            break
        end = int(ends[fitting - 1])
        g = max(p, MIN_WORDS - p)
        hit = np.flatnonzero(w[: end - p : g] == w[p:end:g])
        if len(hit):
            places.append(hit * g)
            periods.append(np.full(len(hit), p, dtype=np.int64))
            held += len(hit)
        if held >= QUESTIONS:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


class Extensions:
    """Extensions to the right of two places of a word array, sorting no more documents than needed."""

    def __init__(self, w: np.ndarray, doc: np.ndarray):
        self.w, self.doc = w, doc
        self.starts = np.flatnonzero(np.diff(doc, prepend=-1))
        self.sorted = np.zeros(len(self.starts), dtype=bool)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i < j on."""
        steps = steps_to_samples(i, j)
        same = direct_extension(self.w, i, j, steps)
        rest = np.flatnonzero((same == steps) & (j + steps < len(self.w)))
        if len(rest):
            a, b = i[rest] + steps[rest], j[rest] + steps[rest]
            rest, a, b = (x[self.w[a] == self.w[b]] for x in (rest, a, b))
            if len(rest):
                same[rest] += self._between_samples(a, b)
        return same

    def _between_samples(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        needed = np.zeros(len(self.starts), dtype=bool)
        needed[self.doc[j]] = True
        if (needed & ~self.sorted).any():
            self._sort(needed | self.sorted)
        return self.index.extension(i + self.shift[self.doc[i]], j + self.shift[self.doc[j]])

    def _sort(self, chosen: np.ndarray) -> None:
        """Sort the samples of the chosen documents. Each is moved by a multiple of 31, so that samples
        stay samples; what lies between two documents agrees with no other place."""
        starts, n = self.starts, len(self.w)
        ends = np.append(starts[1:], n)
        blocks = np.where(chosen, -(-ends // COVER_MOD) - starts // COVER_MOD, 0)
        self.shift = (np.cumsum(blocks) - blocks - starts // COVER_MOD) * COVER_MOD
        at = np.flatnonzero(chosen[self.doc])
        _, dense = np.unique(self.w[at], return_inverse=True)
        total = int(blocks.sum())
        words = np.repeat(np.arange(total) + len(at) + 1, COVER_MOD)
        words[at + self.shift[self.doc[at]]] = dense + 1
        self.index, self.sorted = SampledSuffixes(words), chosen


def runs_of(w: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, places counted over the whole array, by start and period.

    ``w``: words as integers, different in different documents; the longest document first."""
    n = len(w)
    doc = np.repeat(np.arange(np.count_nonzero(lengths)), lengths[lengths > 0])
    if not n:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    forward, backward = Extensions(w, doc), Extensions(w[::-1].copy(), doc[-1] - doc[::-1])
    found = [np.empty((3, 0), dtype=np.int64)]
    for i, p in grid_matches(w, lengths):
        right = forward.right(i, i + p)
        left = backward.right(n - i - p, n - i)
        length = left + right + p
        good = length >= np.maximum(MIN_WORDS, 2 * p)
        found.append(np.unique(np.stack([(i - left)[good], length[good], p[good]]), axis=1))
    start, length, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[first], length[first], p[first]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def repeated_tails(ids: list[int | None], texts: list[list[bytes]]) -> list[list[bytes]]:
    """Every tenth document by crc32(doc_id): its words from a on repeat the p words found there."""
    out = []
    for i, words in zip(ids, texts, strict=True):
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            cycle = words[a : a + p]
            words = words[:a] + (cycle * ((n - a) // p + 1))[: n - a]
        out.append(words)
    return out


def batch_runs(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of the runs of every document, and for each word of the
    documents (one after another) whether it is kept."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(x, len(number)) for k in order.tolist() for x in texts[k]), np.int64, int(lengths.sum()))
    sorted_lengths = lengths[order]
    w = word + np.repeat(np.arange(len(order), dtype=np.int64), sorted_lengths) * max(len(number), 1)
    start, length, period = runs_of(w, sorted_lengths)
    begins = np.cumsum(sorted_lengths) - sorted_lengths
    at = np.searchsorted(np.cumsum(sorted_lengths), start, side="right")
    doc, local = order[at], start - begins[at]
    begins_in = np.cumsum(lengths) - lengths
    change = np.zeros(int(lengths.sum()) + 1, dtype=np.int64)
    np.add.at(change, begins_in[doc] + local + period, 1)
    np.add.at(change, begins_in[doc] + local + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    back = np.lexsort((period, local, doc))
    return doc[back], local[back], length[back], period[back], kept


NAMES = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def run_digests(docs: DataFrame, edit=repeated_tails) -> DataFrame:
    """Number of runs, the longest run, and digests of all runs and of the words that stay.

    ``edit(ids, word lists)`` gives the words to look at (None: the texts as they are)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_BYTES, 1):
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").split() for t in bytes_list(batch.column(1))]
            texts = edit(ids, texts) if edit else texts
            doc, start, length, period, kept = batch_runs(texts)
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            # of each document's runs the longest; lexsort lists ties by start, then period
            best = np.lexsort((period, start, -length, doc))[edges[:-1][np.diff(edges) > 0]]
            some = np.diff(edges) > 0
            rows: dict[str, list] = {k: [None] * len(texts) for k in ("start", "length", "period", "exponent")}
            for k, b in zip(np.flatnonzero(some).tolist(), best.tolist(), strict=True):
                rows["start"][k], rows["length"][k], rows["period"][k] = int(start[b]), int(length[b]), int(period[b])
                rows["exponent"][k] = 1000 * int(length[b]) // int(period[b])
            every = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
            listed = [_sha(b"".join(b"%d,%d,%d\n" % r for r in every[edges[k] : edges[k + 1]])) for k in range(len(texts))]
            ends = np.cumsum([len(t) for t in texts])
            collapsed = []
            for k, t in enumerate(texts):
                if some[k]:
                    t = [x for x, ok in zip(t, kept[ends[k] - len(t) : ends[k]].tolist(), strict=True) if ok]
                collapsed.append(_sha(b" ".join(t)))
            longs = [[len(t) for t in texts], np.diff(edges).tolist(), rows["start"], rows["length"], rows["period"], rows["exponent"]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in longs], pa.array(listed), pa.array(collapsed)], NAMES
            )

    schema = ", ".join([f"doc_id {id_type}", *[f"{n} long" for n in NAMES[1:7]], *[f"{n} string" for n in NAMES[7:]]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def document_runs(docs: DataFrame) -> DataFrame:
    """All runs of the texts as they are: doc_id, start, length, period (word numbers from 0)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_BYTES, 1):
            doc, start, length, period, _ = batch_runs([(t or b"").split() for t in bytes_list(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *[pa.array(x) for x in (start, length, period)]],
                ["doc_id", "start", "length", "period"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, start long, length long, period long")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"))


# every pair of equal words a period apart; stretches of such pairs are runs
OP12_SQL = r"""
with t as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint)) as digits
  from documents),
c as (
  select r, doc_id, words, cast(len(words) as bigint) as n,
         xor(list_reduce(list_concat([cast(4294967295 as bigint)], digits), lambda c, b:
           list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as h
  from t),
g as (
  select *, doc_id is not null and h % 10 = 0 and n > 0 as edited, (h // 10) % greatest(n, 1) as a,
         1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) as p
  from c),
e as (
  select r, n, u.i, case when edited and u.i >= a then words[1 + a + (u.i - a) % p] else words[1 + u.i] end as word
  from g, lateral (select unnest(range(0, n)) as i) u),
m as (
  select x.r, y.i - x.i as p, x.i, x.i - row_number() over (partition by x.r, y.i - x.i order by x.i) as island
  from e x join e y on y.r = x.r and y.word = x.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
s as (select r, p, min(i) as start, count(*) + p as length from m group by r, p, island),
runs as (select r, start, length, min(p) as period from s where length >= greatest(12, 2 * p) group by r, start, length),
best as (
  select r, count(*) over (partition by r) as n_runs, start, length, period from runs
  qualify row_number() over (partition by r order by length desc, start, period) = 1),
listed as (
  select r, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by r),
gone as (select distinct r, u.i from runs, lateral (select unnest(range(start + period, start + length)) as i) u),
k as (select e.r, string_agg(e.word, ' ' order by e.i) as kept from e anti join gone on gone.r = e.r and gone.i = e.i group by e.r)
select g.doc_id, g.n as n_words, coalesce(best.n_runs, 0) as n_runs, best.start, best.length, best.period,
       1000 * best.length // best.period as exponent_milli, sha256(coalesce(listed.lines, '')) as runs_sha256,
       sha256(coalesce(k.kept, '')) as collapsed_sha256
from g left join best on best.r = g.r left join listed on listed.r = g.r left join k on k.r = g.r
"""

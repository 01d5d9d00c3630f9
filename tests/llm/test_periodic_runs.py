"""op12 against brute force: all periods, all stretches."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chirpflow.llm import periodic_runs as pr
from chirpflow.session import read_table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Maximal stretches with w[i] = w[i+p] for every p; the smallest p of two ends."""
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.empty(0)
    ends = {}
    for p in range(len(words) // 2, 0, -1):
        same = np.concatenate([[False], ids[:-p] == ids[p:], [False]])
        edge = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + p >= max(12, 2 * p):
                ends[a, b - a + p] = p
    return sorted((a, n, p) for (a, n), p in ends.items())


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {x for a, n, p in runs for x in range(a + p, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
        sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def check(table):
    want = Counter(brute_row(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    got = pr.run_digests(table).drop("n_words")
    assert got.columns == [n for n in pr.NAMES if n != "n_words"]
    assert Counter(tuple(r) for r in got.collect()) == want
    return want


def test_query_equals_brute_force(spark):
    want = check(read_table(spark, SF, "documents"))
    assert any(r[1] for r in want) and pr.op12_periodic_runs(spark, SF).count() == sum(want.values())


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(7))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (4, "a " * 12), (5, "a " * 13), (None, (base + " ") * 20), (None, (base + " ") * 20)]
    rows += [(6, "x " + (base + "\n") * 3 + "y"), (7, ("a b " * 30 + "c ") * 5), (8, "é 漢 " * 9 + " "), (9, ("lo " * 40 + base + " ") * 200)]
    rows += [(10 + k, " ".join(f"v{i % (50 + k)}" for i in range(900))) for k in range(30)]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], "doc_id long, text string, start int, period string")
    check(df)
    assert pr.run_digests(df.where("false")).collect() == []
    spans = {tuple(r) for r in pr.document_runs(df.where("doc_id = 6")).collect()}
    assert spans == {(6, 1, 21, 7)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=4), st.integers(1, 60), st.integers(0, 5))
def test_small_alphabets(parts, period, copies):
    texts = [[b"%d" % x for x in part] for part in parts]
    texts += [t[:period] * copies + t for t in texts]
    doc, start, length, p, kept = pr.batch_runs(texts)
    got = [[] for _ in texts]
    for d, *r in zip(doc.tolist(), start.tolist(), length.tolist(), p.tolist(), strict=True):
        got[d].append(tuple(r))
    assert got == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]
    want = [i not in {x for a, n, q in runs for x in range(a + q, a + n)} for t, runs in zip(texts, got, strict=True) for i in range(len(t))]
    assert kept.tolist() == want


def test_sampled_extensions_equal_counting():
    rng = np.random.default_rng(1)
    for alphabet, n in ((1, 500), (2, 700), (50, 900)):
        w = np.concatenate([rng.integers(0, alphabet, n), np.tile(rng.integers(0, alphabet, 90), 6)])
        ext = pr.Extensions(w, np.zeros(len(w), dtype=np.int64))
        i = rng.integers(0, len(w) - 1, 4000)
        j = i + 1 + rng.integers(0, len(w), 4000) % (len(w) - i - 1).clip(1)
        ok = j < len(w)
        i, j = i[ok], j[ok]
        want = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            k = 0
            while b + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            want.append(k)
        assert ext.right(i, j).tolist() == want

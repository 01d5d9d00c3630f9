"""The forest of op8: depth choice, large nodes, rows that share a doc_id."""

import random

import numpy as np

from chirpflow.llm import jaccard_join as jj


def brute(rows):
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := t.split()) else frozenset() for _, t in rows]
    links = [[b for b in range(len(rows)) if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9] for a in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[a], *[group[b] for b in links[a]]]) for a in range(len(rows))]
    return links, group


def near_copies(n, seed=1):
    """Copies of one text with a few words changed, more and more: some pairs are linked, some are not."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w[: 150 - rng.randrange(40)]))
    return out


def test_one_large_node(spark, monkeypatch):
    """A node of near copies above one block: dealt out by set size and hash, no link is lost or counted twice."""
    texts = near_copies(90) + [" ".join(f"o{k}x{i}" for i in range(30)) for k in range(10)]
    rows = list(enumerate(texts))
    links, group = brute(rows)
    assert 500 < sum(map(len, links)) < 90 * 89
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1500, 8):
        monkeypatch.setattr(jj, "BLOCK", block)
        got = {r["doc_id"]: (r["n_links"], r["group_id"]) for r in jj.jaccard_join(df).collect()}
        missed = sum(len(links[i]) - got[i][0] for i in got)
        assert 0 <= missed <= 0.002 * sum(map(len, links)), block
        assert all(got[i][0] <= len(links[i]) for i in got)
        assert {i: g for i, (_, g) in got.items()} == dict(enumerate(group))


def test_depth_follows_the_similarities():
    bins = np.zeros(jj.SIMILARITY_BINS)
    assert jj.next_depth(bins, 8, 16, 0.9995) == 8  # nothing found, nothing missed
    bins[int(0.97 * jj.SIMILARITY_BINS)] = 1000
    assert jj.next_depth(bins, 8, 16, 0.9995) == 8  # close copies meet at the deepest prefix
    bins[int(0.8 * jj.SIMILARITY_BINS)] = 1000
    depth = jj.next_depth(bins, 8, 16, 0.9995)
    assert depth < 6 and jj.estimated_recall(bins, 8, depth, 16) >= 0.9995 > jj.estimated_recall(bins, 8, depth + 1, 16)
    assert abs(jj.met(0.8, 8, 16) - (1 - (1 - 0.8**8) ** 16)) < 1e-12


def test_node_keys_are_prefixes():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2, size=(200, 3, 4), dtype=np.uint32)
    for depth in (1, 2, 4):
        keys = jj.node_keys(sig, depth)
        same = (sig[:, None, :, :depth] == sig[None, :, :, :depth]).all(axis=3)
        assert ((keys[:, None] == keys[None]) == same).all()
        assert len(np.unique(keys)) == sum(len(np.unique(keys[:, t])) for t in range(3))


def test_rows_that_share_or_lack_a_doc_id(spark):
    a, b = near_copies(1)[0], " ".join(f"b{i}" for i in range(60))
    rows = [(9, a), (9, b), (9, b), (None, a + " tail"), (None, a + " tail"), (None, None), (12, b + " end"), (13, "")]
    df = spark.createDataFrame([(*r, "e", f"s{k}") for k, r in enumerate(rows)], "doc_id long, text string, digest string, group string")
    got = sorted((str(r["doc_id"]), r["n_links"], str(r["group_id"])) for r in jj.jaccard_join(df).collect())
    assert got == sorted([("9", 2, "9"), ("9", 2, "9"), ("9", 2, "9"), ("None", 2, "9"), ("None", 2, "9"), ("None", 0, "None"), ("12", 2, "9"), ("13", 0, "13")])
    kept = jj.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("9", a), ("9", b), ("None", "None"), ("13", "")])
    nobody = spark.createDataFrame([(None, a), (None, a + " tail")], "doc_id long, text string")
    assert [(r["class_id"], r["group_id"], r["n_links"]) for r in jj.jaccard_join(nobody).collect()] == [(None, None, 1)] * 2
    assert jj.one_per_group(nobody).count() == 1

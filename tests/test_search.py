"""Vector top-k, BM25 and hybrid search against brute-force NumPy / Python."""

import math

import numpy as np
import pytest

from chirpflow.operators import search

DIM = 8


def corpus(spark, n=60, seed=7, extra=()):
    rng = np.random.default_rng(seed)
    rows = [(f"d{i:03d}", [float(x) for x in rng.normal(size=DIM)]) for i in range(n)]
    rows += list(extra)
    return spark.createDataFrame(rows, "tweet_id string, full_text_vector array<float>")


def queries(spark, n=4, seed=11):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(
        [(q, [float(x) for x in rng.normal(size=DIM)]) for q in range(n)], "query_id int, query_vector array<double>"
    )


def brute(c_rows, q_rows, k, metric):
    out = {}
    for qid, qv in q_rows:
        q = np.array(qv, dtype=np.float64)
        scored = []
        for cid, cv in c_rows:
            if cv is None or len(cv) != DIM:
                continue
            x = np.array(cv, dtype=np.float32).astype(np.float64)
            if metric == "cosine":
                d = np.linalg.norm(x) * np.linalg.norm(q)
                s = float(x @ q / d) if d > 0 else 0.0
            else:
                s = 1.0 / (1.0 + float(((x - q) ** 2).sum()))
            scored.append((-round(s, 9), cid, s))
        scored.sort()
        out[qid] = [(cid, s) for _, cid, s in scored[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_topk_matches_brute_force(spark, metric):
    extra = [("zero", [0.0] * DIM), ("short", [1.0] * (DIM - 1)), ("none", None)]
    c, q = corpus(spark, extra=extra), queries(spark)
    got = {}
    for r in search.vector_topk(c, q, k=7, metric=metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = brute([(r[0], r[1]) for r in c.collect()], [(r[0], r[1]) for r in q.collect()], 7, metric)
    assert set(got) == set(want)
    for qid in want:
        assert [i for i, _ in got[qid]] == [i for i, _ in want[qid]]
        assert all(math.isclose(a, b, abs_tol=1e-9) for (_, a), (_, b) in zip(got[qid], want[qid]))


def test_zero_vector_scores_zero_and_ties_break_by_id(spark):
    c = spark.createDataFrame(
        [("b", [0.0, 0.0]), ("a", [0.0, 0.0]), ("c", [1.0, 0.0])], "tweet_id string, full_text_vector array<float>"
    )
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, query_vector array<double>")
    got = [(r.id, r.score) for r in search.vector_topk(c, q, k=3, metric="cosine").orderBy("rank").collect()]
    assert got == [("a", 0.0), ("b", 0.0), ("c", 0.0)]


def test_many_query_passes_equal_one_pass(spark, monkeypatch):
    c, q = corpus(spark), queries(spark, n=9)
    one = sorted(tuple(r) for r in search.vector_topk(c, q, k=3).collect())
    monkeypatch.setattr(search, "MAX_QUERY_BYTES", 8 * DIM * 2)  # two queries per pass
    many = sorted(tuple(r) for r in search.vector_topk(c, q, k=3).collect())
    assert len(one) == len(many) == 27
    assert [r[:3] for r in one] == [r[:3] for r in many]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(one, many))


def test_l2_order_equals_cosine_order_on_unit_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, DIM))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = spark.createDataFrame([(f"d{i}", [float(x) for x in r]) for i, r in enumerate(v)],
                              "tweet_id string, full_text_vector array<double>")
    q = spark.createDataFrame([(0, [float(x) for x in v[0] + 0.1])], "query_id int, query_vector array<double>")
    a = [r.id for r in search.vector_topk(c, q, 10, "cosine").orderBy("rank").collect()]
    b = [r.id for r in search.vector_topk(c, q, 10, "l2").orderBy("rank").collect()]
    assert a == b


def test_knn_size_and_defaults(spark):
    c, q = corpus(spark), queries(spark, n=2)
    assert search.knn(c, q, k=10, size=5).count() == 10
    assert search.knn(c, q, k=3, size=5).count() == 6  # min(k, size) per query
    assert search.knn(c, q, k=0, size="x").count() == 10  # fall back to 10 / 5


def py_bm25(docs, query, k1=1.2, b=0.75):
    toks = {d: t.lower().split() for d, t in docs.items()}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    out = {}
    for term in query.split():
        df = sum(1 for t in toks.values() if term in t)
        if df == 0:
            continue
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for d, t in toks.items():
            tf = t.count(term)
            if tf:
                out[d] = out.get(d, 0.0) + idf * tf / (tf + k1 * (1 - b + b * len(t) / avgdl))
    return out


def test_bm25_matches_formula(spark):
    docs = {"1": "the cat sat", "2": "the dog", "3": "cat cat cat dog bird", "4": "nothing relevant here at all"}
    c = spark.createDataFrame(list(docs.items()), "tweet_id string, full_text string")
    q = spark.createDataFrame([(1, "cat dog"), (2, "zzzz")], "query_id int, query_text string")
    got = {r.id: r.score for r in search.bm25(c, q, size=10).collect() if r.query_id == 1}
    want = py_bm25(docs, "cat dog")
    assert got.keys() == want.keys()
    assert all(math.isclose(got[d], want[d], rel_tol=1e-12) for d in want)
    assert search.bm25(c, q).where("query_id = 2").count() == 0


def test_hybrid_fuses_and_falls_back(spark):
    c = spark.createDataFrame(
        [("a", "red apple", [1.0, 0.0]), ("b", "green apple", [0.0, 1.0]), ("c", "blue sky", [0.7, 0.7])],
        "tweet_id string, full_text string, full_text_vector array<float>",
    )
    q = spark.createDataFrame(
        [(1, "green", [1.0, 0.0]), (2, "zzzz", [1.0, 0.0])], "query_id int, query_text string, query_vector array<double>"
    )
    rows = {(r.query_id, r.id): r for r in search.hybrid(c, q, k=1, size=3).collect()}
    # query 1: 'a' only from the vector list, 'b' only from the keyword list
    assert rows[(1, "a")].text_score == 0.0 and rows[(1, "a")].knn_score == 1.0
    assert rows[(1, "b")].knn_score == 0.0 and rows[(1, "b")].text_score > 0
    assert math.isclose(rows[(1, "b")].score, 0.3 * rows[(1, "b")].text_score)
    # query 2 has no matching word: pure vector search
    assert [k for k in rows if k[0] == 2] == [(2, "a")]
    for fusion in ("minmax", "rrf"):
        assert search.hybrid(c, q, k=2, size=3, fusion=fusion).count() > 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_ivf_exact_equals_exhaustive_and_approx_recall(spark, tmp_dir, metric):
    from chirpflow.operators import ann

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, DIM)) * 4
    rows = [(f"d{i:03d}", [float(x) for x in centers[i % 6] + rng.normal(size=DIM)]) for i in range(240)]
    rows.append(("zero", [0.0] * DIM))
    c = spark.createDataFrame(rows, "tweet_id string, full_text_vector array<float>")
    q = queries(spark, n=5)
    path = ann.build_ivf_index(c, tmp_dir + "/ivf", n_cells=6, metric=metric)
    exact = sorted((r.query_id, r.rank, r.id) for r in search.vector_topk(c, q, 10, metric).collect())
    pruned = sorted((r.query_id, r.rank, r.id) for r in ann.ivf_search(spark, path, q, k=10, nprobe=1).collect())
    assert pruned == exact
    approx = ann.ivf_search(spark, path, q, k=10, nprobe=2, exact=False).collect()
    want = {(a, i) for a, _, i in exact}
    recall = len(want & {(r.query_id, r.id) for r in approx}) / len(want)
    assert recall >= 0.5


def test_bm25_large_vocabulary_path_same_scores(spark, monkeypatch):
    docs = {"1": "the cat sat", "2": "the dog", "3": "cat cat cat dog bird", "4": "bird"}
    c = spark.createDataFrame(list(docs.items()), "tweet_id string, full_text string")
    q = spark.createDataFrame([(1, "cat dog"), (2, "bird the")], "query_id int, query_text string")
    small = sorted(tuple(r) for r in search.bm25(c, q).collect())
    monkeypatch.setattr(search, "MAX_QUERY_TERMS", 1)
    large = sorted(tuple(r) for r in search.bm25(c, q).collect())
    assert [r[:3] for r in small] == [r[:3] for r in large]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(small, large))


def test_running_topk_across_many_batches(spark):
    c, q = corpus(spark, n=80).coalesce(1), queries(spark, n=3)
    want = sorted((r.query_id, r.rank, r.id) for r in search.vector_topk(c, q, k=6).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.query_id, r.rank, r.id) for r in search.vector_topk(c, q, k=6).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    ref = brute([(r[0], r[1]) for r in c.collect()], [(r[0], r[1]) for r in q.collect()], 6, "cosine")
    assert [(a, i + 1, cid) for a in sorted(ref) for i, (cid, _) in enumerate(ref[a])] == got


def test_lookup_large_hit_set_path(spark, monkeypatch):
    c = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(20)], "tweet_id string, full_text string")
    hits = spark.createDataFrame([(1, f"d{i}") for i in range(0, 20, 2)], "query_id int, id string")
    small = sorted(tuple(r) for r in search.lookup(c, hits, "tweet_id", ["full_text"]).collect())
    monkeypatch.setattr(search, "MAX_LOOKUP_IDS", 3)
    large = sorted(tuple(r) for r in search.lookup(c, hits, "tweet_id", ["full_text"]).collect())
    assert small == large and len(small) == 10


def test_search_dispatch_modes_and_encoder_check(spark):
    import datetime as dt

    from chirpflow.operators.embed import embed, hashing_encoder

    enc = hashing_encoder(16)
    posts = spark.createDataFrame(
        [("1", "red apple pie " * 20, "u1", dt.datetime(2020, 1, 1), 1, 2),
         ("2", "green apple", "u2", dt.datetime(2021, 1, 1), 3, 4),
         ("3", "blue sky", "u3", None, 5, 6)],
        "tweet_id string, full_text string, username string, created_at timestamp, retweet_count int, favorite_count int",
    )
    corpus = embed(posts, enc)
    q = spark.createDataFrame([(1, "apple")], "query_id int, query_text string")
    knn_rows = search.search(corpus, q, mode="knn", size=2, k=3, encoder=enc).orderBy("rank").collect()
    assert [r.tweet_id for r in knn_rows] == ["2", "1"]
    assert knn_rows[1].snippet.endswith("...") and len(knn_rows[1].snippet) == 153
    by_date = search.search(corpus, q, mode="by_date", size=3, k=3, encoder=enc).orderBy("rank").collect()
    assert [r.tweet_id for r in by_date] == ["2", "1", "3"] and by_date[0].date == "2021-01-01"
    with pytest.raises(ValueError):
        search.search(corpus, q, mode="knn", encoder=hashing_encoder(8))
    with pytest.raises(ValueError):
        search.search(corpus, q, mode="nope", encoder=enc)


def test_ties_at_the_cut_keep_smallest_ids(spark):
    rows = [(f"d{i:02d}", [1.0, 1.0]) for i in range(30)] + [("z", [0.0, 1.0])]
    c = spark.createDataFrame(rows, "tweet_id string, full_text_vector array<float>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, query_vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = [r.id for r in search.vector_topk(c, q, k=5).orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == ["d00", "d01", "d02", "d03", "d04"]


def test_not_finite_vectors_are_skipped_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_BLOCK_CELLS", 2)
    rows = [(f"g{i}", [float(i), 1.0]) for i in range(8)] + [(f"n{i}", [float("nan"), 1.0]) for i in range(3)]
    rows.append(("inf", [float("inf"), 1.0]))
    corpus = spark.createDataFrame(rows, "tweet_id string, full_text_vector array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, query_vector array<double>")
    for metric in ("l2", "cosine", "dot"):
        got = [r.id for r in search.vector_topk(corpus, q, k=3, metric=metric).orderBy("rank").collect()]
        assert got == ["g0", "g1", "g2"], metric


def test_query_vectors_of_two_lengths_raise(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0])], "tweet_id string, full_text_vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    with pytest.raises(ValueError):
        search.vector_topk(corpus, q, k=1)


def test_minmax_gives_a_missing_side_nothing(spark):
    corpus = spark.createDataFrame(
        [("a", [1.0, 0.0], "cat"), ("b", [0.9, 0.1], "dog"), ("c", [0.5, 0.5], "dog")],
        "tweet_id string, full_text_vector array<float>, full_text string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "cat")], "query_id int, query_vector array<double>, query_text string")
    got = {r.id: r.score for r in search.hybrid(corpus, q, k=3, size=3, fusion="minmax").collect()}
    assert got["a"] == pytest.approx(1.3) and got["c"] == pytest.approx(0.0)


@pytest.mark.parametrize("fusion", ["weighted_sum", "minmax", "rrf"])
@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_hybrid_scores_the_words_of_every_vector_hit(spark, fusion, metric):
    """The vector hits rank far down among the matches: their exact BM25 and rank still count."""
    k, size = 6, 5
    texts = {f"t{i:02d}": " ".join(["cat"] * (1 + i % 4) + ["dog"] * (i % 3) + [f"w{n}" for n in range(i)]) for i in range(30)}
    texts |= {f"v{i}": " ".join(["cat"] + [f"x{n}" for n in range(40 + 9 * (i % 4))]) for i in range(5)} | {"v5": "bird"}
    near = {f"v{i}": [1.0 - i / 50, i / 50] for i in range(6)}
    vecs = {d: near.get(d, [-3.0 - int(d[1:]), 1.0]) for d in texts}
    c = spark.createDataFrame(
        [(d, t, vecs[d]) for d, t in texts.items()], "tweet_id string, full_text string, full_text_vector array<double>")
    q = spark.createDataFrame(
        [(1, "cat dog", [1.0, 0.0]), (2, "zzzz", [1.0, 0.0])], "query_id int, query_text string, query_vector array<double>")
    sim = {d: v[0] if metric == "dot" else 1 / (1 + (v[0] - 1) ** 2 + v[1] ** 2) for d, v in vecs.items()}
    knn = sorted(sim.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    want = {}
    for query, words in ((1, "cat dog"), (2, "zzzz")):
        text = py_bm25(texts, words)
        order = sorted(text, key=lambda d: (-round(text[d], 9), d))
        kr, tr = {d: r for r, (d, _) in enumerate(knn, 1)}, {d: r for r, d in enumerate(order, 1)}
        ks = dict(knn)

        def scaled(side, d):
            if d not in side:
                return 0.0
            lo, hi = min(side.values()), max(side.values())
            return (side[d] - lo) / (hi - lo) if hi > lo else 1.0

        score = {
            "weighted_sum": lambda d: ks.get(d, 0) + 0.3 * text.get(d, 0),
            "minmax": lambda d: scaled(ks, d) + 0.3 * scaled(text, d),
            "rrf": lambda d: sum(1 / (60 + r[d]) for r in (kr, tr) if d in r),
        }[fusion]
        full = {d: score(d) for d in ks.keys() | text.keys()}
        best = sorted(full, key=lambda d: (-round(full[d], 9), d))[:size]
        for r, d in enumerate(best, 1):
            want[(query, r)] = (d, pytest.approx(full[d]), pytest.approx(ks.get(d, 0.0)), pytest.approx(text.get(d, 0.0)))
    got = {(r.query_id, r.rank): (r.id, r.score, r.knn_score, r.text_score) for r in search.hybrid(c, q, k=k, size=size, fusion=fusion, metric=metric).collect()}
    assert got == want


def test_keyword_cost_does_not_depend_on_the_vocabulary(spark):
    """Ten query terms or 100,000: the same matches, and no list of terms in the plan."""
    import time

    corpus = spark.createDataFrame([(f"d{i}", " ".join(f"w{(i * k) % 997}" for k in range(60))) for i in range(20000)],
                                   "tweet_id string, full_text string").repartition(4)
    few = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(10)))], "query_id int, query_text string")
    many = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(10)))] + [(2 + j, " ".join(f"z{j}x{k}" for k in range(1000))) for j in range(100)],
                                 "query_id int, query_text string")
    took, hits = {}, {}
    for _ in range(2):
        for name, q in (("few", few), ("many", many)):
            t = time.perf_counter()
            hits[name] = sorted((r.id, round(r.score, 9)) for r in search.bm25(corpus, q, size=50).collect())
            took[name] = time.perf_counter() - t
    assert hits["few"] == hits["many"] and len(hits["few"]) == 50
    assert took["many"] < 2 * took["few"] + 2


def test_index_in_many_blocks_and_query_blocks(spark, tmp_dir, monkeypatch):
    import numpy as np

    from chirpflow.operators import ann

    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "PENDING_BYTES", 2000)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    monkeypatch.setattr(ann, "MAX_PROBE_BYTES", 0)
    rng = np.random.default_rng(5)
    hot = [[1.0, 0.0, 0.0, 0.0]] * 60
    vecs = hot + rng.normal(size=(140, 4)).tolist() + [[0.0] * 4, None, [1.0], [float("nan")] * 4]
    c = spark.createDataFrame([(f"d{i:03d}", v) for i, v in enumerate(vecs)], "tweet_id string, full_text_vector array<double>")
    q = spark.createDataFrame([(f"q{i}", rng.normal(size=4).tolist()) for i in range(9)] + [("none", None)], "query_id string, query_vector array<double>")
    for metric in ("cosine", "l2"):
        path = ann.build_ivf_index(c, f"{tmp_dir}/{metric}", n_cells=5, metric=metric, target_recall=0.9)
        want = sorted((r.query_id, r.rank, r.id) for r in search.vector_topk(c, q, k=6, metric=metric).collect())
        assert sorted((r.query_id, r.rank, r.id) for r in ann.ivf_search(spark, path, q, k=6).collect()) == want
        assert ann.ivf_search(spark, path, q, k=500).count() == 9 * 201
        per = ann.recall(ann.ivf_search(spark, path, q, k=6, exact=False), search.vector_topk(c, q, k=6, metric=metric)).collect()
        assert len(per) == 9 and all(0 <= r.recall <= 1 and r.k == 6 for r in per)
    with pytest.raises(Exception, match="query vector"):
        ann.ivf_search(spark, path, spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<double>")).collect()
    empty = ann.build_ivf_index(c.where("false"), f"{tmp_dir}/empty", n_cells=3)
    assert ann.ivf_search(spark, empty, q).collect() == []


def test_sentence_encoder_slot_with_a_stand_in_package(spark, tmp_dir):
    """The real encoder's factory against a package of its name: the model is built on the workers with the
    given name, fed whole chunks, and its vectors arrive unchanged."""
    import zipfile

    from chirpflow.operators.embed import embed, encoder_of, sentence_transformer_encoder

    source = (
        "import numpy as np\n"
        "class SentenceTransformer:\n"
        "    def __init__(self, name, device=None):\n"
        "        self.name = name\n"
        "    def encode(self, texts, batch_size, show_progress_bar):\n"
        "        assert 1 <= batch_size <= 32 and not show_progress_bar and len(texts) <= 256\n"
        "        return np.array([[len(t), t.count('a'), len(self.name)] for t in texts], dtype=np.float32)\n"
    )
    with zipfile.ZipFile(f"{tmp_dir}/stand_in.zip", "w") as z:
        z.writestr("sentence_transformers/__init__.py", source)
    spark.sparkContext.addPyFile(f"{tmp_dir}/stand_in.zip")
    df = spark.createDataFrame([(i, "a" * (i % 5) + "b" * i if i % 7 else None) for i in range(600)], "id int, full_text string")
    out = embed(df, sentence_transformer_encoder("m-1"))
    assert encoder_of(out, "full_text_vector") == "m-1"
    for r in out.collect():
        t = "" if r.id % 7 == 0 else "a" * (r.id % 5) + "b" * r.id
        assert r.full_text_vector == [len(t), t.count("a"), 3]

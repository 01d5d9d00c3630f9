"""op13: statistics, kernel, normal equations and calibration against plain computations; held-out labels."""

import zlib

import numpy as np
import pytest

from chirpflow.llm import quality_classifier as qc
from chirpflow.session import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    label = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    rows = [r.asDict() for r in qc.op13_quality_classifier(spark, SF).collect()]
    docs = {r["doc_id"] for r in read_table(spark, SF, "documents").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == docs and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s < 0.3 for s in bad]) > 0.8


def test_equals_a_plain_fit(spark):
    """The whole query against one dense fit on the driver."""
    docs, labels = read_table(spark, SF, "documents").collect(), read_table(spark, SF, "labels").collect()
    label = {r["doc_id"]: float(r["quality"]) for r in labels}
    x = np.array([qc.statistics(r["text"].encode()) for r in docs])
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in docs])
    teach = np.array([r["doc_id"] in label for r in docs]) & (fold != 0)
    y = np.array([label.get(r["doc_id"], 0.0) for r in docs])
    features = qc.FourierFeatures(x[teach].mean(axis=0), x[teach].std(axis=0))
    z = features(x)
    held = np.diag([qc.RIDGE] * qc.FEATURES + [0.0])

    def weights(at):
        return np.linalg.lstsq(z[at].T @ z[at] + held * at.sum(), z[at].T @ y[at], rcond=None)[0]

    raw = np.zeros(len(y))
    for k in range(1, 5):
        raw[fold == k] = z[fold == k] @ weights(teach & (fold != k))
    bins = qc.bin_of(raw[teach])
    steps = qc.pooled(*[np.bincount(bins, v, qc.SCORE_BINS) for v in (np.ones(teach.sum()), raw[teach], y[teach])])
    want = np.clip(np.interp(z @ weights(teach), *steps), 0, 1)
    got = {r["doc_id"]: r["score"] for r in qc.op13_quality_classifier(spark, SF).collect()}
    diff = np.array([abs(got[r["doc_id"]] - s) for r, s in zip(docs, want, strict=True)])
    assert np.quantile(diff, 0.99) < 1e-3  # a raw score at the edge of a bin may fall into the next one


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5))
    z = qc.FourierFeatures(np.zeros(5), np.ones(5), features=20000)(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-gap / (2 * qc.WIDTH**2))).max() < 0.04


def test_pooling_is_the_best_monotone_fit():
    rng = np.random.default_rng(4)
    n, y = rng.integers(0, 5, 40).astype(float), rng.random(40)
    score, value = qc.pooled(n, n * np.arange(40), n * y)
    assert (np.diff(value) > 0).all() and (np.diff(score) > 0).all()
    at = np.flatnonzero(n)
    # min-max formula of isotonic regression
    mean = lambda a, b: (n[a : b + 1] * y[a : b + 1]).sum() / n[a : b + 1].sum()
    want = {round(max(min(mean(a, b) for b in at if b >= i) for a in at if a <= i), 12) for i in at}
    assert want == {round(v, 12) for v in value}


def test_statistics():
    s = dict(zip(qc.STATISTICS, qc.statistics("A B c! c!\n12 éé".encode()), strict=True))
    assert s["words"] == pytest.approx(np.log(7)) and s["word_length"] == pytest.approx(12 / 6)
    assert s["loud"] == pytest.approx((2 / 12) ** 0.5) and s["capital_words"] == pytest.approx(2 / 6)
    assert s["digits"] == pytest.approx((2 / 12) ** 0.5) and s["repeated_lines"] == 0 and s["longest_repeat"] == pytest.approx(np.log(2))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (None, "no id " * 30), (None, None), (5, "long text, " * 50000), (6, "a b"), (6, "a b")]
    df = spark.createDataFrame([(i, t, 0, 1.0, "") for i, t in rows], "doc_id long, text string, label int, score double, fold string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r["score"] for r in qc.score_documents(df, none).collect()) == [0.5] * len(rows)
    labels = spark.createDataFrame([(i, 1, 7) for i in range(1, 9)] + [(1, 1, 7), (2, None, 7), (None, 0, 7)], "doc_id long, quality int, doc int")
    got = qc.score_documents(df, labels).collect()
    assert len(got) == len(rows) and all(r["score"] == pytest.approx(1.0) and r["predicted"] == 1 and r["held_out"] is not None for r in got)
    assert qc.score_documents(df.where("false"), labels).collect() == []

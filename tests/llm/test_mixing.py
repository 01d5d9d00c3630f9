"""op3: targets against a plain rule, overlaps, many sources, rows that are alike."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chirpflow.llm import mixing


def plain_targets(sizes, weights):
    """The rule of the targets in a few lines: fill and share again until no source is above."""
    full, rest, free = {}, float(sum(sizes.values())), dict(sizes)
    while True:
        total = sum(weights[s] for s in free)
        above = [s for s in free if rest * weights[s] / total > 3 * free[s]] if total else []
        if not above:
            return {**full, **{s: rest * weights[s] / total for s in free}}
        for s in above:
            full[s] = 3.0 * free[s]
        rest -= sum(full[s] for s in above)
        for s in above:
            del free[s]


@pytest.mark.parametrize("sizes", [[1, 100, 5], [0, 0, 7], [10] * 9, [1, 2, 4, 8, 16, 32, 64, 5000], [0]])
def test_targets(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes))]
    got = {r["tag"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "tag string, size long"), sum(sizes)).collect()}
    want = plain_targets(dict(zip(names, sizes)), {n: 1 + i % 3 for i, n in enumerate(names)})
    assert got == pytest.approx(want)


def test_many_sources(spark):
    """300,000 sources, each a pattern of its own: nothing of them is collected."""
    n = 300_000
    docs = spark.range(n + 4).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("http://site"), F.col("id") % n).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text")
    )
    got = mixing.mix(docs, F.array("source"))
    r = got.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).first()
    assert r["n"] == n + 4 and r["most"] <= 3 and abs(r["taken"] / r["size"] - 1) < 0.2
    assert got.where("abs(taken - target) > size").count() <= 8


def test_overlapping_sources_beside_single_ones(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 else ["a", "b"]) for i in range(60)] + [(100 + i, "w " * 5, ["c"]) for i in range(40)]
    rows += [(200, "w w", [None, "x\x00y"]), (201, "w w", []), (202, None, ["c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(docs, F.col("sources")).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = Counter()
    for r in got:
        by[r["pattern"]] += r["taken"]
    assert set(by) == {'["sa"]', '["sa","sb"]', '["sc"]', '["sx\\u0000y","t"]', "[]"}
    assert by["[]"] == 0 and next(r for r in got if r["doc_id"] == 202)["taken"] == 0
    total = sum(r["size"] for r in got)
    assert abs(sum(by.values()) - total) <= 40


def test_alike_rows_are_documents_of_their_own(spark):
    """Rows without doc_id, with one doc_id and different texts, and repeated rows: the mix has as many words
    as were taken."""
    rows = [(None, "a b c d", "s1")] * 5 + [(9, "one two three", "s1"), (9, "other text of five words", "s1")] + [(7, "w " * 30, "s2")] * 4 + [(None, None, "s2"), (3, "", None)]
    docs = spark.createDataFrame([(*r, "en", k) for k, r in enumerate(rows)], "doc_id long, text string, source string, key string, copies int")
    got = mixing.mix(docs, F.array("source")).collect()
    assert len(got) == len(rows) and len({r["key"] for r in got}) == len(rows)
    mixed = mixing.mixed_documents(docs, F.array("source"))
    assert mixed.columns == docs.columns
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    have = Counter()
    for r in mixed.collect():
        have[r["doc_id"]] += len((r["text"] or "").split())
    assert +have == +want and sum(have.values()) > 0
    again = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs.repartition(5), F.array("source")).collect())
    assert again == Counter((r["doc_id"], r["text"]) for r in mixed.collect())


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 3)
    docs = spark.createDataFrame([(None, "a b", "s1")] * 40 + [(1, "c d e", "s2")], "doc_id long, text string, source string")
    taken = sum(r["copies"] for r in mixing.mix(docs, F.array("source")).collect())
    assert mixing.mixed_documents(docs, F.array("source")).count() == taken > 10

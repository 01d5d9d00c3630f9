"""The pipeline, stage by stage, against brute force on rows without doc_id, with a shared one, and repeated."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [
    (1, PASSAGE + " first document with words of its own", "s1"), (None, "lead one " + PASSAGE + " and a tail " + "x y z " * 9, "s1"),
    (None, "another beginning of a text " + "k l " * 20 + PASSAGE, "s2"), (None, "another beginning of a text " + "k l " * 20 + PASSAGE, "s2"),
    (9, "one text of document nine " + " ".join(f"n{i}" for i in range(30)), "s1"), (9, "quite another text " + " ".join(f"m{i}" for i in range(30)), None),
    (10, "one text of document nine " + " ".join(f"n{i}" for i in range(30)) + " end", "s2"), (11, None, "s1"), (12, "", "s2"), (12, "", "s2"),
    (13, " \t\n", None), (14, "a b", "s1"), (15, PASSAGE, "s3"), (16, "word " * 50, "s3"), (16, "word " * 50, "s3"),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def first_of_groups(rows):
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := words(t)) else None for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[b] for b in range(len(rows)) if a == b or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))) for a in range(len(rows))]
    best = {}
    for a, (i, t, _) in enumerate(rows):
        rank = (i is None, i or 0, hashlib.md5((t or "").encode()).digest())
        if group[a] not in best or rank < best[group[a]][0]:
            best[group[a]] = (rank, a)
    return Counter((rows[a][0], rows[a][1]) for _, a in best.values())


def cut(rows):
    low = {}
    order = [2**63 if i is None else i for i, _, _ in rows]
    for o, (_, t, _) in zip(order, rows, strict=True):
        w = words(t)
        for k in range(len(w) - 12):
            low[tuple(w[k : k + 13])] = min(o, low.get(tuple(w[k : k + 13]), o))
    out = Counter()
    for o, (i, t, _) in zip(order, rows, strict=True):
        w = words(t)
        gone = {x for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < o for x in range(k, k + 13)}
        out[(i, t if not gone else " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    from chirpflow.llm import bpe, mixing

    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((i, t) for i, t, _ in ROWS)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == first_of_groups(ROWS)
    # the cut of all rows, so that repeated and shared ids take part
    passages = corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()
    plain = Counter((r["doc_id"], r["text"] if r["text"] in {t for _, t, _ in ROWS} else " ".join(words(r["text"]))) for r in passages)
    assert plain == cut(ROWS) and any(r["doc_id"] is None and "p7" not in words(r["text"]) for r in passages)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in passages)
    taken = Counter()
    for r in mixing.mix(docs, F.array("source")).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    have = Counter()
    for r in mixed.collect():
        have[r["doc_id"]] += len(words(r["text"]))
    assert +have == +taken
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.encode(spark, docs, SF).collect()) == want


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter(map(tuple, docs.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_cut_rows_keep_their_columns_without_a_join(spark):
    """The whole rows are neither joined nor shuffled to get their cut texts back."""
    rows = [(i, t, None if n % 3 == 0 else f"l{n}", [n, None], n) for n, (i, t, _) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, extra array<int>, n_chars int")
    out = corpus_pipeline.cut_repeated_passages(spark, docs, SF)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["extra"][0]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t, lang, extra, n in rows:
        r = got[n]
        assert (r["doc_id"], r["lang"], r["extra"]) == (i, lang, extra)
        assert r["n_chars"] == (n if r["text"] == t else len(r["text"]))
    assert Counter((r["doc_id"], r["text"] if r["text"] in {t for _, t, _ in ROWS} else " ".join(words(r["text"]))) for r in got.values()) == cut(ROWS)

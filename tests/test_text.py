"""Tokenizers, cleaning and text helpers on hand-made samples."""

import re

import pytest

from chirpflow.functions import text as T
from chirpflow.operators import clean

SAMPLES = [
    "École elections élection, don't stop",
    "Check http://x.co/a?b=1 now! Don't stop—go a-b café bar",
    "ELECTION election-2020 elections re-election",
    "tabs\tand\nnewlines  x2 a_b",
    "",
]


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


CLEANED = [
    ["cole", "elections", "lection", "dont", "stop"],
    ["check", "now", "dont", "stopgo", "ab", "caf", "bar"],
    ["election", "election", "elections", "reelection"],
    ["tabs", "and", "newlines", "x", "ab"],
    [],
]


def py_word_tokens(s):
    return re.findall(r"\b\w+\b", s.lower())


def test_clean_split_of_the_samples(spark):
    got = {r.i: r.w for r in rows(spark, SAMPLES).select("i", T.clean_split("t").alias("w")).collect()}
    assert [got[i] for i in range(len(SAMPLES))] == CLEANED


def test_clean_split_details(spark):
    (r,) = rows(spark, ["Don't a-b café bar http://t.co/x y"]).select(T.clean_split("t").alias("w")).collect()
    # apostrophes and hyphens are deleted (words fuse), accents vanish, NBSP separates
    assert r.w == ["dont", "ab", "caf", "bar", "y"]


def test_word_tokens_match_spec(spark):
    got = {r.i: r.w for r in rows(spark, SAMPLES).select("i", T.word_tokens("t").alias("w")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == py_word_tokens(s), s


def test_whole_word_count(spark):
    df = rows(spark, SAMPLES)
    got = {r.i: r.n for r in df.select("i", T.whole_word_count("t", "election").alias("n")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == len(re.findall(r"\belection\b", s.lower())), s


def test_whole_word_count_quotes_regex_chars(spark):
    df = rows(spark, ["a.b axb a.b"])
    assert df.select(T.whole_word_count("t", "a.b").alias("n")).first().n == 2


def test_strip_like_python(spark):
    vals = ["  hi \t\n", "  ", " x　", "plain"]
    got = [r.s for r in rows(spark, vals).orderBy("i").select(T.strip("t").alias("s")).collect()]
    assert got == [v.strip() for v in vals]


@pytest.mark.parametrize("n,cut", [(10000, False), (10001, True)])
def test_long_text_cut(spark, n, cut):
    text = "  " + "a" * n
    df = spark.createDataFrame([("1", text)], "tweet_id string, full_text string")
    (r,) = clean.clean_posts(df, max_chars=clean.MAX_TEXT_CHARS).collect()
    stripped = text.strip()
    if len(stripped) > 10000:
        assert r.full_text == stripped[:10000]
    else:
        assert r.full_text == text  # shorter text keeps its whitespace
    assert cut == (len(stripped) > 10000)


def test_clean_posts_drops_blank_and_null_keeps_na(spark):
    df = spark.createDataFrame(
        [("1", None), ("2", "   "), ("3", "NA"), ("4", " \t"), ("5", "ok")], "tweet_id string, full_text string"
    )
    kept = sorted(r.tweet_id for r in clean.clean_posts(df).collect())
    assert kept == ["3", "5"]
    kept_na = sorted(r.tweet_id for r in clean.clean_posts(df, na_strings=["NA"]).collect())
    assert kept_na == ["5"]


def test_snippet(spark):
    df = rows(spark, ["x" * 150, "y" * 151])
    got = [r.s for r in df.orderBy("i").select(T.snippet("t").alias("s")).collect()]
    assert got == ["x" * 150, "y" * 150 + "..."]


def test_standard_tokens_keep_inner_apostrophes(spark):
    (r,) = rows(spark, ["Don't U.S.A. l’homme end."]).select(T.standard_tokens("t").alias("w")).collect()
    assert r.w == ["don't", "u.s.a", "l’homme", "end"]


def test_clean_posts_whole_texts(spark):
    text = "b" * 12000
    df = spark.createDataFrame([("1", text)], "tweet_id string, full_text string")
    assert clean.clean_posts(df, max_chars=None).first().full_text == text


BREAKS = {
    "it's 3.14 and 1,234.5": ["it's", "3.14", "and", "1,234.5"],          # mid-letter, mid-number
    "a.1 1.a 1a2b a,b 3;4": ["a", "1", "1", "a", "1a2b", "a", "b", "3;4"],  # a mid character between kinds breaks
    "..a..b.. 'q' x:y": ["a", "b", "q", "x:y"],                            # at an end or doubled it breaks
    "foo_bar __ _x_ カ_a": ["foo_bar", "_x_", "カ_a"],                      # connectors join, alone they are no token
    "漢字かな カタカナー ﾃｽﾄ": ["漢", "字", "か", "な", "カタカナー", "ﾃｽﾄ"],
    "한국어 ภาษาไทย": ["한국어", "ภาษาไทย"],
    "été x‍y abc漢def": ["été", "x‍y", "abc", "漢", "def"],
    "user@host.com http://x.y/z?q=1": ["user", "host.com", "http", "x.y", "z", "q", "1"],
    "İ ÉCOLE l’homme": ["i̇", "école", "l’homme"],
    "a" * 600: ["a" * 255, "a" * 255, "a" * 90],
    " \t…—": [],
}


def test_standard_word_breaks(spark):
    df = rows(spark, list(BREAKS))
    got = {r.i: r.w for r in df.select("i", T.standard_tokens("t").alias("w")).collect()}
    assert {s: got[i] for i, s in enumerate(BREAKS)} == BREAKS
    chain = rows(spark, [".".join(["ab"] * 30000), None])
    got = {r.i: r.w for r in chain.select("i", T.standard_tokens("t").alias("w")).collect()}
    assert max(map(len, got[0])) <= 255 and "".join(got[0]).replace(".", "") == "ab" * 30000 and got[1] is None


def test_token_counts_inside_the_row(spark):
    df = rows(spark, ["b a b", "", None, "a", "c c c"])
    got = sorted(tuple(r) for r in T.with_token_counts(df, "t", "word", [T.F.col("i")]).collect())
    assert got == [(0, "a", 1), (0, "b", 2), (3, "a", 1), (4, "c", 3)]

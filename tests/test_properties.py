"""Property tests: Spark expressions against plain-Python specifications."""

import datetime as dt
import re
from string import ascii_lowercase

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chirpflow.functions import text as T
from chirpflow.operators import search, trends

ALPHABET = list("abcxyzABCXYZ019_ -'’.,!?\t\n") + ["é", "É", "ç", "ü", "ß", " ", "　", "http://a.b/c ", "don't "]
pieces = st.lists(st.sampled_from(ALPHABET), max_size=40)
texts = pieces.map("".join)
SETTINGS = dict(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**SETTINGS)
@given(st.lists(pieces, min_size=1, max_size=8))
def test_clean_split_keeps_the_letters_outside_links(spark, values):
    df = spark.createDataFrame([(i, "".join(v)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: (r.c, r.again) for r in df.withColumn("c", T.clean_split("t")).withColumn("s", F.array_join("c", " ")).select(
        "i", "c", T.clean_split("s").alias("again")).collect()}
    for i, v in enumerate(values):
        letters = "".join(ch for piece in v if "://" not in piece for ch in piece.lower() if ch in ascii_lowercase)
        words, again = got[i]
        assert "".join(words) == letters, repr(v)
        assert all(words) and again == words


@settings(**SETTINGS)
@given(st.lists(texts, min_size=1, max_size=8))
def test_word_tokenizers_match_python(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = {r.i: (r.w, r.n) for r in df.select(
        "i", T.word_tokens("t").alias("w"), T.whole_word_count("t", "ab").alias("n")
    ).collect()}
    for i, s in enumerate(values):
        assert got[i][0] == re.findall(r"\b\w+\b", s.lower()), repr(s)
        assert got[i][1] == len(re.findall(r"\bab\b", s.lower())), repr(s)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 3), texts), min_size=1, max_size=10))
def test_term_series_equals_daily_word_count(spark, rows):
    data = [(str(i), dt.datetime(2020, 1, 1 + d), t) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "tweet_id string, created_at timestamp, full_text string")
    a = {r.day: r.matches for r in trends.daily_word_count(df, "ab").collect()}
    b = {r.day: r.n for r in trends.term_totals(df, term="ab", grain="date").collect()}
    assert a == b


def test_by_date_puts_missing_dates_last(spark):
    c = spark.createDataFrame(
        [("a", [1.0, 0.0], None), ("b", [0.9, 0.1], dt.datetime(2020, 1, 1)), ("c", [0.8, 0.2], dt.datetime(2021, 1, 1))],
        "tweet_id string, full_text_vector array<float>, created_at timestamp",
    )
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    got = [r.id for r in search.knn_by_date(c, q, k=3, size=3).orderBy("rank").collect()]
    assert got == ["c", "b", "a"]

"""Daily series, monthly counts, top words and spikes on hand-made posts."""

import datetime as dt

from chirpflow.operators import trends

COLS = "tweet_id string, created_at timestamp, full_text string"


def posts(spark, rows):
    return spark.createDataFrame(rows, COLS)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_daily_word_count_keeps_zero_days(spark):
    df = posts(spark, [
        ("1", ts("2020-01-01 10:00:00"), "Election day, election!"),
        ("2", ts("2020-01-01 12:00:00"), "elections"),
        ("3", ts("2020-01-02 09:00:00"), "nothing here"),
        ("4", None, "election"),
        ("5", ts("2020-01-03 09:00:00"), None),
    ])
    got = {r.day.isoformat(): r.matches for r in trends.daily_word_count(df, "election").collect()}
    assert got == {"2020-01-01": 2, "2020-01-02": 0}
    clipped = trends.daily_word_count(df, "election", start="2020-01-02", end="2020-01-02").collect()
    assert [(r.day.isoformat(), r.matches) for r in clipped] == [("2020-01-02", 0)]


def test_term_series_equals_date_grain_totals(spark):
    df = posts(spark, [
        ("1", ts("2020-01-01 10:00:00"), "a b a"),
        ("2", ts("2020-01-01 10:00:00"), "b"),
        ("3", ts("2020-01-02 10:00:00"), "c"),
    ])
    series = {r.day: r.n for r in trends.term_totals(df, term="a", grain="date").collect()}
    totals = {r.day: r.n for r in trends.term_totals(df, grain="date").where("term = 'a'").collect()}
    assert series == {**{d: 0 for d in series}, **totals}
    assert sum(series.values()) == 2 and len(series) == 2
    per_ts = trends.term_totals(df).where("term = 'b'").collect()
    assert [(r.n) for r in per_ts] == [2]


def test_doc_term_counts_sum_equals_token_count(spark):
    df = posts(spark, [("1", ts("2020-01-01 00:00:00"), "x y x Z z"), ("2", ts("2020-01-01 00:00:00"), "")])
    tf = {(r.doc_id, r.term): r.tf for r in trends.doc_term_counts(df).collect()}
    assert tf == {("1", "x"): 2, ("1", "y"): 1, ("1", "z"): 2}


def test_monthly_posts_fills_gaps(spark):
    df = posts(spark, [
        ("1", ts("2020-01-05 00:00:00"), "a"), ("2", ts("2020-03-01 00:00:00"), "b"), ("3", None, "c"),
    ])
    got = [(r.month, r.n_posts) for r in trends.monthly_posts(df).orderBy("month").collect()]
    assert got == [("2020-01", 1), ("2020-02", 0), ("2020-03", 1)]


def test_top_words_document_frequency_and_tie_break(spark):
    df = posts(spark, [
        ("1", ts("2020-01-01 00:00:00"), "a a a b"),
        ("2", ts("2020-01-02 00:00:00"), "a c"),
        ("3", ts("2020-01-03 00:00:00"), "b c d"),
    ])
    top = trends.top_words(df, top_n=3).orderBy("rank").collect()
    # a:2 docs, b:2, c:2, d:1 -> ties broken by word
    assert [(r.word, r.doc_count, r.rank) for r in top] == [("a", 2, 1), ("b", 2, 2), ("c", 2, 3)]


def test_spikes_factor_and_month_gap(spark):
    rows = []
    n = 0

    def add(month, text, times):
        nonlocal n
        for _ in range(times):
            n += 1
            rows.append((str(n), ts(f"{month}-10 00:00:00"), text))

    add("2020-01", "x y", 1)
    add("2020-01", "y", 1)
    add("2020-02", "x", 10)        # x: 1 -> 10, spike at factor 10
    add("2020-02", "y", 19)        # y: 2 -> 19, no spike at 10
    add("2020-04", "x", 50)        # 2020-03 is empty: previous month reads 0
    top = trends.top_words(posts(spark, rows), top_n=1000)
    got = [(r.month, r.word, r.prev_count, r.cur_count, r.ratio) for r in trends.word_spikes(top, 10).collect()]
    assert got == [("2020-02", "x", 1, 10, 10.0)]


def test_spike_needs_word_in_previous_top_list(spark):
    rows = [(str(i), ts("2020-01-10 00:00:00"), "common") for i in range(3)]
    rows += [("r", ts("2020-01-10 00:00:00"), "rare")]
    rows += [(f"f{i}", ts("2020-02-10 00:00:00"), "rare") for i in range(30)]
    top = trends.top_words(posts(spark, rows), top_n=1)  # 'rare' misses January's top-1
    assert trends.word_spikes(top, 10).count() == 0
    top2 = trends.top_words(posts(spark, rows), top_n=2)
    assert [(r.word, r.ratio) for r in trends.word_spikes(top2, 10).collect()] == [("rare", 30.0)]


def test_monthly_posts_without_gap_fill_and_sorted_vocabulary(spark):
    df = posts(spark, [
        ("1", ts("2020-01-05 00:00:00"), "Beta alpha"), ("2", ts("2020-03-01 00:00:00"), "alpha Zeta"),
    ])
    got = sorted((r.month, r.n_posts) for r in trends.monthly_posts(df, fill_gaps=False).collect())
    assert got == [("2020-01", 1), ("2020-03", 1)]
    assert [r.term for r in trends.vocabulary(df).collect()] == ["alpha", "beta", "zeta"]

"""Thread roots, thread text and thread word counts on hand-made archives."""

from chirpflow.operators import threads

COLS = "account_id string, pos long, id string, full_text string, created_at string, in_reply_to_user_id string, in_reply_to_status_id string"
DATE = "Sun Jan 05 10:00:00 +0000 2020"


def archive_rows():
    a = "A"
    rows = [
        (a, 0, "1", "Root post http://x.y", DATE, None, None),
        (a, 1, "2", "reply one", DATE, a, "1"),
        (a, 2, "3", "reply two", DATE, a, "2"),
        (a, 3, "4", "orphan reply", "Mon Feb 03 10:00:00 +0000 2020", a, "99"),  # parent missing
        (a, 4, "5", "null parent", DATE, a, None),
        (a, 5, "6", "answers someone else", DATE, "B", "1"),  # not a self-reply
        (a, 6, "2", "reply one edited", DATE, a, "1"),  # duplicate id, last wins
        (a, 7, "8", "cycle a", DATE, a, "9"),
        (a, 8, "9", "cycle b", DATE, a, "8"),
        (a, 9, "10", "short date root", "Jan 2020", None, None),
        (a, 10, "11", "under short", DATE, a, "10"),
        (a, 11, "12", "no date root", "", None, None),
        (a, 12, "13", "under no date", DATE, a, "12"),
    ]
    # chain of 150 replies
    rows.append((a, 20, "c0", "chain start", DATE, None, None))
    for i in range(1, 151):
        rows.append((a, 20 + i, f"c{i}", f"chain {i}", DATE, a, f"c{i - 1}"))
    # another account with the same ids (accounts are independent)
    rows.append(("Z", 0, "1", "other account root", DATE, None, None))
    rows.append(("Z", 1, "2", "other account reply", DATE, "Z", "1"))
    return rows


def expected_roots(in_archive):
    """The roots of ``archive_rows``, worked out by hand: (account, id) -> (root, is_cycle)."""
    want = {("A", "1"): ("1", False), ("A", "2"): ("1", False), ("A", "3"): ("1", False)}
    want[("A", "4")] = ("4" if in_archive else "99", False)  # its parent is not in the archive
    want |= {("A", "5"): ("5", False), ("A", "6"): ("6", False)}  # null parent; answer to another account
    want |= {("A", "8"): (None, True), ("A", "9"): (None, True)}
    want |= {("A", "10"): ("10", False), ("A", "11"): ("10", False)}
    want |= {("A", "12"): ("12", False), ("A", "13"): ("12", False)}
    want |= {("A", f"c{i}"): ("c0", False) for i in range(151)}
    want |= {("Z", "1"): ("1", False), ("Z", "2"): ("1", False)}
    return want


def test_roots_both_variants(spark):
    tw = spark.createDataFrame(archive_rows(), COLS)
    for in_archive in (True, False):
        got = {(r.account_id, r.id): (r.root_id, r.is_cycle)
               for r in threads.thread_roots(tw, in_archive=in_archive).collect()}
        assert got == expected_roots(in_archive)


def test_dedup_last(spark):
    tw = spark.createDataFrame(archive_rows(), COLS)
    d = {r.id: r.full_text for r in threads.dedup_last(tw).where("account_id = 'A'").collect()}
    assert d["2"] == "reply one edited"


def test_thread_text_order_and_duplicates(spark):
    tw = spark.createDataFrame(archive_rows(), COLS)
    roots = threads.thread_roots(tw, True)
    t = {(r.account_id, r.root_id): (r.text, r.n_posts) for r in threads.thread_text(tw, roots, chunk=4).collect()}
    assert t[("A", "1")] == ("Root post http://x.y reply one reply two reply one edited", 4)
    chain = t[("A", "c0")][0].split(" ")
    assert chain[:2] == ["chain", "start"] and chain[-2:] == ["chain", "150"]
    assert ("A", "8") not in t  # cycles are not assembled


def test_word_counts_at_the_root_date(spark):
    tw = spark.createDataFrame(archive_rows(), COLS)
    roots = threads.thread_roots(tw, True)
    stop = spark.createDataFrame([("the",), ("don't",), ("one",)], "word string")
    got = {}
    for r in threads.thread_word_counts(tw, roots, stop).collect():
        got.setdefault(r.date_key, {})[r.word] = r.n
    # "one" is a stopword, the link and the digits vanish; cycles and undated roots give nothing
    assert got == {
        "Jan052020": {
            "root": 2, "post": 1, "reply": 4, "two": 1, "edited": 1,  # threads of A/1 and Z/1
            "other": 2, "account": 2,
            "null": 1, "parent": 1, "answers": 1, "someone": 1, "else": 1,
            "chain": 151, "start": 1,
        },
        "Feb032020": {"orphan": 1, "reply": 1},
        "UnknownDate": {"short": 2, "date": 1, "root": 1, "under": 1},
    }


def test_word_series_sorted_and_absent_word(spark):
    tw = spark.createDataFrame(archive_rows(), COLS)
    counts = threads.thread_word_counts(tw, threads.thread_roots(tw, True), spark.createDataFrame([], "word string"))
    s = threads.word_series(counts, "reply").collect()
    assert [r.date for r in s] == sorted(r.date for r in s) and all(r.date is not None for r in s)
    assert threads.word_series(counts, "absentword").count() == 0


def test_hot_key_path_gives_same_answers(spark, monkeypatch):
    from chirpflow.operators import joins

    rows = archive_rows()
    # a hot root: 30 direct replies to tweet 1
    rows += [("A", 300 + i, f"h{i}", f"hot reply {i}", DATE, "A", "1") for i in range(30)]
    tw = spark.createDataFrame(rows, COLS)
    stop = spark.createDataFrame([("the",)], "word string")
    base_roots = sorted(tuple(r) for r in threads.thread_roots(tw, True).collect())
    base_words = sorted(tuple(r) for r in threads.thread_word_counts(tw, threads.thread_roots(tw, True), stop).collect())
    monkeypatch.setattr(joins, "HOT_KEY_ROWS", 2)
    assert sorted(tuple(r) for r in threads.thread_roots(tw, True).collect()) == base_roots
    got_words = sorted(tuple(r) for r in threads.thread_word_counts(tw, threads.thread_roots(tw, True), stop).collect())
    assert got_words == base_words
    assert dict(((r[0], r[1]), r[2]) for r in base_roots)[("A", "h7")] == "1"


def test_rounds_read_fewer_rows_than_climb(spark):
    """A deep chain among many shallow threads: leaves never take part, and a round reads of the
    finished rows at most as many as still climb."""
    rows = [("A", i, f"c{i}", "t", DATE, "A" if i else None, f"c{i - 1}" if i else None) for i in range(200)]
    rows += [("A", 1000 + i, f"s{i}", "t", DATE, "A", "c0" if i % 3 else f"s{i - i % 3 - 3}") for i in range(3, 600)]
    tw = spark.createDataFrame(rows, COLS)
    edges = threads.reply_edges(tw)
    seen = []
    got = {r.id: r.root_id for r in threads.resolve_roots(edges, rounds=seen).collect()}
    assert all(v in ("c0", "s0") for v in got.values()) and len(got) == edges.count()
    climbing = [n for n, _ in seen]
    assert climbing == sorted(climbing, reverse=True) and climbing[0] < edges.count() and climbing[-1] < climbing[0]
    assert all(frontier <= n for n, frontier in seen)


def test_threads_by_date_in_parts(spark):
    a = "A"
    rows = [(a, 0, "1", "root", "Wed Jan 08 10:00:00 +0000 2020", None, None)]
    stamps = ["Mon Jan 06 10:00:00 +0000 2020", "Fri Jan 10 10:00:00 +0000 2020", "", None, "bad", "Wed Jan 08 09:00:00 -0200 2020"]
    rows += [(a, i, str(i + 1), f"r{i}", s, a, "1") for i, s in enumerate(stamps, 1)]
    tw = spark.createDataFrame(rows, COLS)
    roots = threads.thread_roots(tw, True)
    (r,) = threads.thread_text(tw, roots, order_by="created_at").collect()
    assert r.text == "r1 root r6 r2 r3 r4 r5" and r.n_posts == 7
    parts = sorted((p.part, p.text, p.n_posts) for p in threads.thread_parts(tw, roots, "created_at", part_posts=3).collect())
    assert parts == [(0, "r1 root r6", 3), (1, "r2 r3 r4", 3), (2, "r5", 1)]


def test_word_counts_of_one_word(spark):
    tw = spark.createDataFrame(archive_rows(), COLS)
    roots, stop = threads.thread_roots(tw, True), spark.createDataFrame([("one",)], "word string")
    whole = {tuple(r) for r in threads.thread_word_counts(tw, roots, stop).where("word = 'reply'").collect()}
    assert {tuple(r) for r in threads.thread_word_counts(tw, roots, stop, "reply").collect()} == whole and whole
    assert threads.thread_word_counts(tw, roots, stop, "one").count() == 0

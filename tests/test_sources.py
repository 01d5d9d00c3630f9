"""Readers: account archives, posts CSV, stopwords."""

import json
import os

from chirpflow.sources.archives import read_archives
from chirpflow.sources.posts import read_posts_csv, read_stopwords, type_posts


def test_read_archives(spark, tmp_dir):
    doc = {
        "account": [{"account": {"accountId": "42"}}],
        "tweets": [
            {"retweeted": False, "tweet": {"id": "1", "full_text": "hello", "created_at": "Sun Jan 05 10:00:00 +0000 2020"}},
            {"retweeted": True, "tweet": {"id": "2", "full_text": "rt"}},
            {"tweet": {"id": "3", "full_text": "reply", "in_reply_to_user_id": "42", "in_reply_to_status_id": "1",
                       "retweeted": True}},
        ],
    }
    empty = {"account": [], "tweets": [{"tweet": {"id": "9", "full_text": "x"}}]}
    for name, d in (("a.json", doc), ("b.json", empty)):
        with open(os.path.join(tmp_dir, name), "w") as f:
            json.dump(d, f, indent=2)
    rows = {r.id: r for r in read_archives(spark, tmp_dir).collect()}
    assert set(rows) == {"1", "3", "9"}  # wrapper-level retweet flag only
    assert rows["3"].pos == 2 and rows["3"].account_id == "42" and rows["9"].account_id is None
    inner = {r.id for r in read_archives(spark, tmp_dir, retweeted_path="inner").collect()}
    assert inner == {"1", "2", "9"}


def test_read_posts_csv_quoted_newlines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "post.csv")
    with open(path, "w") as f:
        f.write("tweet_id,account_id,created_at,full_text,retweet_count,favorite_count,"
                "reply_to_tweet_id,reply_to_user_id,reply_to_username,username\n")
        f.write('1,a,2020-01-05 10:00:00+00:00,"line one\nline ""two""",3,4,,,,u\n')
        f.write("2,a,not a date,NA,x,1,,,,u\n")
    df = read_posts_csv(spark, path)
    rows = {r.tweet_id: r for r in df.collect()}
    assert rows["1"].full_text == 'line one\nline "two"' and rows["2"].full_text == "NA"
    assert read_posts_csv(spark, path, na_strings=["NA"]).where("tweet_id = '2'").first().full_text is None
    typed = {r.tweet_id: r for r in type_posts(df, on_invalid_date="null").collect()}
    assert typed["1"].retweet_count == 3 and typed["2"].retweet_count is None and typed["2"].created_at is None
    assert [r.tweet_id for r in type_posts(df).collect()] == ["1"]


def test_read_stopwords(spark, tmp_dir):
    path = os.path.join(tmp_dir, "stop.txt")
    with open(path, "w") as f:
        f.write("the\nand\nthe\n\ndon't\n")
    assert sorted(r.word for r in read_stopwords(spark, path).collect()) == ["and", "don't", "the"]


def test_large_archives_are_split_inside_the_document(spark, tmp_dir):
    """Texts full of commas, brackets, quotes and escapes; any member order and white space; blocks of a
    few bytes, so that every document is read by many tasks."""
    import json
    import os

    from chirpflow.sources import archives

    nasty = ['a, b, c', '"quoted", [x], {y}', "back\\slash\\", 'end\\"', "]}],[{", "", "é, 漢\n,", ',"tweets":[{"tweet"', "\\\\,", "plain"]
    docs = {}
    for k, acc in enumerate(["1", "22", "333"]):
        tweets = [{"retweeted": i % 4 == 3, "tweet": {"id": f"{acc}-{i}", "full_text": nasty[(i + k) % len(nasty)], "created_at": "d, e",
                                                     "in_reply_to_user_id": None, "entities": {"urls": [{"u": [1, 2]}, {"v": "],"}]}}} for i in range(12 * k)]
        members = {"account": [{"account": {"accountId": acc, "name": "n, ]"}}], "profile": [{"a": [[1, 2], [3]]}, {"b": ","}], "tweets": tweets, "like": []}
        docs[acc] = dict(reversed(members.items())) if k == 1 else members
    for acc, doc in docs.items():
        with open(os.path.join(tmp_dir, f"{acc}.json"), "w") as f:
            json.dump(doc, f, indent=None if acc == "1" else 2, ensure_ascii=acc == "22")
    want = sorted(map(str, archives.read_archives(spark, tmp_dir).collect()))
    assert len(want) == 27
    for size in ("64", "1000", str(128 << 20)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = archives.read_large_archives(spark, tmp_dir)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(map(str, got.collect())) == want, size


def test_the_driver_renames_no_file_of_a_document(spark, tmp_dir, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from chirpflow.plans import registry

    seen = {}

    def options(self, get=DataFrameWriter.options, **given):
        seen.update(given)
        return get(self, **given)

    monkeypatch.setattr(DataFrameWriter, "options", options)
    monkeypatch.setattr(registry.archives, "read_large_archives", lambda spark, path: spark.read.text(path).selectExpr("value", "_metadata.file_path as file"))
    rows = [(c, t, "user", f"text {t}") for c in range(6) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    spark.sql("select 1L as o_orderkey, date'2024-01-01' as o_orderdate").write.parquet(f"{tmp_dir}/orders.parquet")
    files = [r["file"] for r in registry.q_archive_large(spark, tmp_dir).collect()]
    assert len(files) == len(set(files)) == 6  # one document in a file of its own
    assert seen["mapreduce.fileoutputcommitter.algorithm.version"] == 2

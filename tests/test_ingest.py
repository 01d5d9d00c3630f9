"""JSON-lines ingest: parse, validation reasons, reject guard, sink and streaming."""

import json
import os

import pytest

from chirpflow.operators import ingest
from chirpflow.streaming.ingest_stream import ingest_stream


def line(i, rt="5", vec=(1, 2, 3), created="2020-01-05 10:00:00+05:30"):
    d = {"tweet_id": str(i), "account_id": "a", "created_at": created, "full_text": f"t{i}",
         "favorite_count": 1, "username": "u", "full_text_vector": list(vec)}
    d["retweet_count"] = rt if rt == "many" else int(rt)
    return json.dumps(d)


def lines_df(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line_id long, value string")


def test_validation_reasons(spark):
    vals = [line(1), line(2)[:-1], line(3, rt="many"), line(4, vec=(1, 2)), line(5, created="not a date"), "   "]
    acc, rej = ingest.validate_posts(ingest.parse_json_lines(lines_df(spark, vals)), dim=3)
    reasons = {r.line_id: r.reject_reason for r in rej.collect()}
    assert reasons == {1: "malformed", 2: "bad_retweet_count", 3: "bad_vector"}
    a = {r.tweet_id: r for r in acc.collect()}
    assert set(a) == {"1", "5"}
    assert a["5"].created_at is None  # unparsable date: kept, null
    assert a["1"].retweet_count == 5 and a["1"].full_text_vector == [1.0, 2.0, 3.0]
    iso = ingest.created_at_iso(acc).where("tweet_id = '1'").first().created_at
    assert iso == "2020-01-05T04:30:00.000Z"


def test_reject_guard_boundary():
    ingest.check_reject_rate(10, 5)  # exactly half passes
    with pytest.raises(RuntimeError):
        ingest.check_reject_rate(10, 6)


def test_ingest_end_to_end_and_guard(spark, tmp_dir):
    good = [line(i) for i in range(4)]
    bad = [line(10 + i, rt="many") for i in range(4)]
    table, quarantine = os.path.join(tmp_dir, "posts"), os.path.join(tmp_dir, "quarantine")
    stats = ingest.ingest(ingest.parse_json_lines(lines_df(spark, good + bad)), table, quarantine, dim=3)
    assert stats == {"total": 8, "accepted": 4, "rejected": 4, "written": 4}
    with pytest.raises(RuntimeError):
        ingest.ingest(ingest.parse_json_lines(lines_df(spark, good[:1] + bad)), table, quarantine, dim=3)
    assert ingest.read_posts_table(spark, table).count() == 4  # the failing batch wrote nothing to the table
    assert ingest.read_quarantine(spark, table, quarantine).count() == 4  # nor to the quarantine: a retry doubles nothing
    stats = ingest.ingest(ingest.parse_json_lines(lines_df(spark, good)), table, quarantine, dim=3, mode="dedup")
    assert stats["written"] == 4  # re-ingest of the same ids adds nothing


def test_jsonl_file_and_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "part-0.jsonl"), "w") as f:
        f.write("\n".join([line(1), "", line(2)[:-1], line(3)]) + "\n")
    df = ingest.read_posts_jsonl(spark, src)
    acc, rej = ingest.validate_posts(df, dim=3)
    assert acc.count() == 2 and [r.reject_reason for r in rej.collect()] == ["malformed"]
    q = ingest_stream(spark, src, os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "q"),
                      os.path.join(tmp_dir, "ckpt"), dim=3)
    q.awaitTermination(120)
    table = os.path.join(tmp_dir, "t")
    assert ingest.read_posts_table(spark, table).count() == 2
    assert ingest.read_quarantine(spark, table, os.path.join(tmp_dir, "q")).count() == 1


def test_embed_ingest_search_jobs(spark, tmp_dir):
    from chirpflow.operators.embed import hashing_encoder
    from chirpflow.plans import jobs

    csv = os.path.join(tmp_dir, "post.csv")
    with open(csv, "w") as f:
        f.write("tweet_id,account_id,created_at,full_text,retweet_count,favorite_count,"
                "reply_to_tweet_id,reply_to_user_id,reply_to_username,username\n")
        f.write("1,a,2020-01-05 10:00:00+00:00,red apple pie,3,4,,,,u1\n")
        f.write("2,a,2020-02-05 10:00:00+00:00,green apple,1,1,,,,u2\n")
        f.write('3,a,2020-03-05 10:00:00+00:00,"   ",1,1,,,,u3\n')
        f.write("4,b,bad date,blue sky,x,1,,,,u4\n")
    enc = hashing_encoder(16)
    out = os.path.join(tmp_dir, "vectors")
    c = jobs.embed_posts_job(spark, csv, out, encoder=enc)
    assert c == {"total_rows": 4, "blank": 1, "processed_rows": 3}
    stats = jobs.ingest_job(spark, out, os.path.join(tmp_dir, "posts"), os.path.join(tmp_dir, "q"), dim=16)
    assert stats["accepted"] == 2 and stats["rejected"] == 1  # 'x' is not a number
    q = spark.createDataFrame([(1, "apple")], "query_id int, query_text string")
    rows = jobs.search_job(spark, os.path.join(tmp_dir, "posts"), q, mode="hybrid", size=2, k=2, encoder=enc).collect()
    assert {r.tweet_id for r in rows} == {"1", "2"} and all(r.snippet for r in rows)


def test_create_posts_table_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "posts")
    assert ingest.create_posts_table(spark, path) is True
    assert ingest.create_posts_table(spark, path) is False
    table = ingest.read_posts_table(spark, path)  # readable while it holds no file
    assert table.count() == 0 and table.columns[-1] == "month"


def test_dedup_inside_a_batch_and_without_ids(spark, tmp_dir):
    import json

    no_id = [json.dumps({"full_text": t, "full_text_vector": [1, 2, 3]}) for t in ("x", "x", "y")]
    lines = [line(1), line(1), line(2), *no_id]
    for _ in range(2):
        stats = ingest.ingest(ingest.parse_json_lines(lines_df(spark, lines)), os.path.join(tmp_dir, "posts"),
                              os.path.join(tmp_dir, "quarantine"), dim=3, mode="dedup")
        assert stats["written"] == 4  # ids 1 and 2, and two different rows without an id


def test_preview_is_ordered(spark):
    from chirpflow.operators.profile import preview

    df = spark.createDataFrame([(i, str(i)) for i in (5, 3, 9, 1)], "k int, v string")
    assert [r.k for r in preview(df, 2).collect()] == [1, 3]


def test_stream_batch_rerun_is_idempotent(spark, tmp_dir):
    from chirpflow.streaming.ingest_stream import _batch_writer

    batch = ingest.read_posts_jsonl(spark, _write_lines(tmp_dir, [line(1), line(2), line(3, rt="many")]))
    tagged = batch.withColumn("reject_reason", ingest.reject_reason(3))
    table, quarantine = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "q")
    write = _batch_writer(table, quarantine, 0.5)
    write(tagged, 0)
    write(tagged, 0)  # the same micro-batch again, as after a failure
    write(tagged.where("tweet_id = '1'"), 1)
    assert ingest.read_posts_table(spark, table).count() == 3
    assert ingest.read_quarantine(spark, table, quarantine).count() == 1


@pytest.mark.parametrize("mode", ["append", "dedup", "overwrite"])
@pytest.mark.parametrize("dies_in", ["_write_rejects", "commit"])
def test_a_batch_that_dies_between_its_writes_doubles_nothing(spark, tmp_dir, monkeypatch, mode, dies_in):
    table, quarantine = os.path.join(tmp_dir, "posts"), os.path.join(tmp_dir, "quarantine")
    ingest.ingest(ingest.parse_json_lines(lines_df(spark, [line(0)])), table, quarantine, dim=3)
    lines = ingest.parse_json_lines(lines_df(spark, [line(1), line(2), line(3, rt="many")]))

    def dies(*args, **kwargs):
        raise OSError("executor and driver lost")

    with monkeypatch.context() as m:
        m.setattr(ingest if dies_in == "_write_rejects" else ingest.manifest, dies_in, dies)
        with pytest.raises(OSError):
            ingest.ingest(lines, table, quarantine, dim=3, mode=mode, batch_id="b1")
    assert [r.tweet_id for r in ingest.read_posts_table(spark, table).collect()] == ["0"]
    assert ingest.read_quarantine(spark, table, quarantine).count() == 0
    for _ in range(2):  # the retry, and a retry of what succeeded
        stats = ingest.ingest(lines, table, quarantine, dim=3, mode=mode, batch_id="b1")
        assert stats == {"total": 3, "accepted": 2, "rejected": 1, "written": 2 if mode == "overwrite" else 3}
    assert ingest.read_quarantine(spark, table, quarantine).count() == 1
    assert [(r.batch_id, r.stored) for r in ingest.ingest_counters(spark, table).collect()][-1] == ("b1", 2)


def test_a_version_taken_by_another_writer_is_passed_over(spark, tmp_dir):
    m = ingest.manifest
    assert m.commit(spark, tmp_dir, {"batch_id": "a", "part": "a-1", "mode": "append"})["version"] == 1
    os.makedirs(f"{tmp_dir}/_manifest/v000000002")  # begun by a writer that died
    assert m.commit(spark, tmp_dir, {"batch_id": "b", "part": "b-1", "mode": "append"})["version"] == 3
    assert m.commit(spark, tmp_dir, {"batch_id": "b", "part": "b-2", "mode": "append"})["part"] == "b-1"
    assert m.visible_parts(spark, tmp_dir) == ["a-1", "b-1"]


def test_compaction_keeps_the_rows(spark, tmp_dir):
    table, quarantine = os.path.join(tmp_dir, "posts"), os.path.join(tmp_dir, "quarantine")
    months = ["2020-01-05 10:00:00+00:00", "2020-02-05 10:00:00+00:00", "not a date"]
    for k in range(3):
        lines = [line(10 * k + i, created=c) for i, c in enumerate(months)]
        ingest.ingest(ingest.parse_json_lines(lines_df(spark, lines)), table, quarantine, dim=3)
    before = sorted(map(str, ingest.read_posts_table(spark, table).collect()))
    assert ingest.compact_posts(spark, table) == 3
    after = ingest.read_posts_table(spark, table)
    assert sorted(map(str, after.collect())) == before and len(before) == 9
    assert after.select("_metadata.file_path").distinct().count() <= 3
    assert ingest.compact_posts(spark, table) == 0


def test_the_same_file_delivered_twice_adds_nothing(spark, tmp_dir):
    src, table, quarantine = (os.path.join(tmp_dir, n) for n in ("in", "t", "q"))
    os.makedirs(src)
    values = [line(1), line(2)[:-1], line(1, vec=(1, 2)), line(3), json.dumps({"full_text": "no id", "full_text_vector": [1, 2, 3]})]
    for k, extra in enumerate(([], [line(4)], [])):
        with open(os.path.join(src, f"part-{k}.jsonl"), "w") as f:
            f.write("\n".join([*values, *extra]) + "\n")
        ingest_stream(spark, src, table, quarantine, os.path.join(tmp_dir, "c"), dim=3, max_reject_rate=1.0, compact_every=1).awaitTermination()
    got = sorted(str(r.tweet_id) for r in ingest.read_posts_table(spark, table).collect())
    assert got == ["1", "3", "4", "None"]  # the bad line of id 1 does not stand in for the good one
    reasons = sorted(r.reject_reason for r in ingest.read_quarantine(spark, table, quarantine).collect())
    assert reasons == ["bad_vector", "malformed"]


def _write_lines(tmp_dir, values):
    src = os.path.join(tmp_dir, "lines")
    os.makedirs(src, exist_ok=True)
    with open(os.path.join(src, "part.jsonl"), "w") as f:
        f.write("\n".join(values) + "\n")
    return src


def test_iso_dates_do_not_depend_on_session_zone(spark):
    from chirpflow.functions.times import iso_utc, parse_timestamp

    df = spark.createDataFrame([("2020-01-05 10:00:00+05:30",), ("garbage",)], "s string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Kolkata", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r.x for r in df.select(iso_utc(parse_timestamp("s")).alias("x")).collect()]
            assert got == ["2020-01-05T04:30:00.000Z", None], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_second_stream_keeps_the_rows_of_the_first(spark, tmp_dir):
    import json

    from chirpflow.streaming.ingest_stream import ingest_stream

    base = {"account_id": "a", "full_text": "t", "retweet_count": 1, "favorite_count": 1, "full_text_vector": [0.5, 1.0]}
    for k, ids in ((1, "abcd"), (2, "e")):
        os.makedirs(f"{tmp_dir}/in{k}")
        with open(f"{tmp_dir}/in{k}/x.json", "w") as f:
            f.writelines(json.dumps({"tweet_id": i, **base}) + "\n" for i in ids)
        ingest_stream(spark, f"{tmp_dir}/in{k}", f"{tmp_dir}/t", f"{tmp_dir}/q", f"{tmp_dir}/c{k}", dim=2).awaitTermination()
    assert sorted(r.tweet_id for r in ingest.read_posts_table(spark, f"{tmp_dir}/t").collect()) == list("abcde")


def test_parsers_agree_and_vectors_are_finite(spark, tmp_dir):
    lines = ["{'tweet_id': 'q'}", '{"tweet_id": "n", "full_text_vector": [NaN, 1.0]}', '{"tweet_id": "s", "full_text_vector": ["NaN", 1.0]}', '{"tweet_id": "ok", "full_text_vector": [1.0, 2.0]}']
    with open(f"{tmp_dir}/l.json", "w") as f:
        f.write("\n".join(lines))
    from chirpflow.operators import ingest

    by_file = ingest.read_posts_jsonl(spark, f"{tmp_dir}/l.json")
    by_column = ingest.parse_json_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    for df in (by_file, by_column):
        reasons = sorted(str(r[0]) for r in df.select(ingest.reject_reason(2)).collect())
        assert reasons == ["None", "bad_vector", "malformed", "malformed"]


def test_killed_embed_job_resumes(spark, tmp_dir, monkeypatch):
    from chirpflow.operators.embed import hashing_encoder
    from chirpflow.plans import jobs
    from chirpflow.sources import posts

    rows = [(str(i), "a", "2020-01-05 10:00:00", f"text {i} " * (i % 7 + 1) if i % 9 else "  ", "1", "2", None, None, None, "u") for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in posts.POSTS_CSV.fieldNames()))
    posts.write_posts_csv(df, f"{tmp_dir}/csv")
    enc = hashing_encoder(8)
    whole = jobs.resumable_embed_job(spark, f"{tmp_dir}/csv", f"{tmp_dir}/whole", enc, waves=5)
    assert whole == {"total_rows": 60, "processed_rows": 53, "waves_run": 5}
    commit = jobs.manifest.commit

    def dies_in_the_third_wave(spark, path, new):
        if new["batch_id"] == "wave-2":
            raise OSError("killed")
        return commit(spark, path, new)

    with monkeypatch.context() as m:
        m.setattr(jobs.manifest, "commit", dies_in_the_third_wave)
        with pytest.raises(OSError):
            jobs.resumable_embed_job(spark, f"{tmp_dir}/csv", f"{tmp_dir}/out", enc, waves=5)
    assert jobs.read_embedded(spark, f"{tmp_dir}/out").count() < 53
    again = jobs.resumable_embed_job(spark, f"{tmp_dir}/csv", f"{tmp_dir}/out", enc, waves=5)
    assert again == {"total_rows": 60, "processed_rows": 53, "waves_run": 3}  # two waves were finished
    rows_of = lambda p: sorted(map(str, jobs.read_embedded(spark, p).collect()))
    assert rows_of(f"{tmp_dir}/out") == rows_of(f"{tmp_dir}/whole")
    assert jobs.resumable_embed_job(spark, f"{tmp_dir}/csv", f"{tmp_dir}/out", enc, waves=5)["waves_run"] == 0


def test_a_delivery_comes_in_few_files_whatever_the_shuffle_partitions(spark, tmp_dir, monkeypatch):
    from chirpflow.plans import registry
    from chirpflow.sources import fixtures as fx

    events = spark.range(400).selectExpr(
        "id as event_id", "timestamp'2024-01-01' as ts", "id % 7 as user_id", "'view' as event_type", "1.5D as value"
    )
    events.write.parquet(f"{tmp_dir}/events.parquet")
    monkeypatch.setattr(spark.conf, "get", lambda key, *a, get=spark.conf.get: "64" if key == "spark.sql.shuffle.partitions" else get(key, *a))
    fx.write_ingest_lines(spark, tmp_dir, f"{tmp_dir}/in")
    files = [n for n in os.listdir(f"{tmp_dir}/in") if n.startswith("part-")]
    assert len(files) <= fx.LEAST_FILES
    want = sorted(r["value"] for r in fx.ingest_lines(spark, tmp_dir).collect())
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_dir}/in").collect()) == want and len(want) == 400
    monkeypatch.setattr(fx, "LINES_PER_FILE", 10)
    fx.write_ingest_lines(spark, tmp_dir, f"{tmp_dir}/more")
    assert len([n for n in os.listdir(f"{tmp_dir}/more") if n.startswith("part-")]) >= 40  # larger deliveries: more files
    root = registry._streamed(spark, tmp_dir, 1).removeprefix("file:")
    assert len([n for n in os.listdir(f"{root}/in") if n.startswith("part-")]) >= 40
    assert ingest.read_posts_table(spark, f"{root}/posts").count() + ingest.read_quarantine(spark, f"{root}/posts", f"{root}/quarantine").count() == 400


def test_rejects_are_stored_in_few_files(spark, tmp_dir):
    lines = ingest.parse_json_lines(lines_df(spark, [line(i) for i in range(40)] + [line(40 + i, rt="many") for i in range(40)]).repartition(40))
    ingest.ingest(lines, f"{tmp_dir}/posts", f"{tmp_dir}/quarantine", dim=3)
    rejects = ingest.read_quarantine(spark, f"{tmp_dir}/posts", f"{tmp_dir}/quarantine")
    assert rejects.count() == 40 and rejects.select("_metadata.file_path").distinct().count() <= 2

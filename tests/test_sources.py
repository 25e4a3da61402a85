"""Sources, documents, pages and the streaming ingest."""

import os
import subprocess

from pyspark.sql import functions as F

from forumlake.operators import holes, merge
from forumlake.sources import documents, lines, topic_pages, topic_parsers
from forumlake.sources.git_log import GitLogSource, commits, decode
from forumlake.streaming import ingest as stream

DOC = """{"id": 7, "uid": null, "title": "t", "dateline": 5, "display": true, "topPostPid": 71, "state": 0,
 "space": {"type": "BLOG", "name": null, "tags": ["x", "y", "x"], "relatedSubjectIds": [3],
  "meta": {"data_likes_list": {"7": {"0": {"main_id": 7, "value": "0", "total": "2", "users": [{"username": "a"}, {"username": "b"}]}}, "72": [{"main_id": 7, "value": 79, "total": 1}]}}},
 "postList": [{"id": 71, "user": {"id": 9, "username": "u9", "nickname": "N"}, "mid": 7, "state": 2, "dateline": 5,
   "subFloorList": [{"id": 72, "user": {"username": "boring"}, "mid": 7, "state": 4, "dateline": 6}]},
  {"id": 73, "user": null, "mid": 7, "state": 1, "dateline": 7}, {"id": 74, "user": {"id": 0, "username": "_pseudo_writer"}, "mid": 7, "state": 0, "dateline": 8}]}"""


def topics(spark, *bodies):
    return documents.read_topics(spark.createDataFrame([(b,) for b in bodies], "body string"))


def test_documents(spark):
    t = topics(spark, DOC, "[]", "{broken", "", None)
    assert t.where("topic is not null").count() == 1 and documents.dead_letters(t).count() == 2
    assert sorted(map(tuple, documents.post_rows(t).collect())) == [(21, 71, 7, 9, 5, 2), (21, 72, 7, -148452161, 6, 4), (21, 73, 7, 0, 7, 1)]
    assert tuple(documents.topic_rows(t).first()) == (21, 7, 9, None, 5, 0, 71, 74, "t")
    assert documents.topic_state(t).first().state == 6
    assert sorted(map(str, documents.user_rows(t).collect()))[0] is not None and documents.user_rows(t).count() == 3
    assert sorted(r.tag for r in documents.blog_tags(t).collect()) == ["x", "y"] and documents.blog_subjects(t).first().subject_id == 3
    assert tuple(documents.naming_rows(t).first()) == (21, 9, "u9", "N")
    assert sorted(map(tuple, documents.like_rows(t).collect())) == [(21, 7, -7, 0, 2), (21, 7, 72, 79, 1)]
    assert sorted(map(tuple, documents.like_given_rows(t).collect())) == [(21, 7, -7, 0, "a"), (21, 7, -7, 0, "b")]


def test_bad_reaction_voids_its_topic(spark):
    bad = DOC.replace('"value": "0"', '"value": "zero"').replace('"id": 7,', '"id": 8,', 1)
    assert {r.mid for r in documents.like_rows(topics(spark, DOC, bad)).collect()} == {7}


def test_documents_round_trip(spark, tmp_path):
    documents.write_topics(topics(spark, DOC).where("topic is not null"), str(tmp_path / "d"))
    again = documents.read_topics(spark.read.text(str(tmp_path / "d")).select(F.col("value").alias("body")))
    assert documents.all_posts(again).count() == 4


def test_line_files(spark, tmp_path):
    l = spark.createDataFrame([("a", "5"), ("a", "x"), ("a", "9"), ("b", "12"), ("b", "3"), ("b", "3")], "repo string, value string")  # noqa: E741
    assert [r.id for r in lines.fullest_list(l).collect()] == [3, 12]
    ts = spark.createDataFrame([(0, "1:100"), (1, "1:200"), (2, "bad"), (3, "2:3:4"), (4, "x:1")], "line_no int, value string")
    assert [tuple(r) for r in lines.timestamps(ts).collect()] == [(1, 200)]
    words = holes.words(spark.createDataFrame([(8, 1), (8, 64), (10, 5)], "type int, id bigint"))
    lines.write_words(words, str(tmp_path / "w"))
    back = holes.lines_to_words(lines.read_words(spark, str(tmp_path / "w")))
    assert sorted((r.type, r.id) for r in holes.word_ids(back).collect()) == [(8, 1), (8, 64), (10, 5)]
    (tmp_path / "t" / "a").mkdir(parents=True)
    (tmp_path / "t" / "a" / "1.json").write_text("{}")
    (tmp_path / "t" / "a" / "1.txt").write_text("{}")
    assert [r.body for r in lines.tree(spark, str(tmp_path / "t")).collect()] == ["{}"]
    lines.write_scores(spark.createDataFrame([("b", "a", 0.5), ("c", "a", 1.5)], "a string, b string, score double"), str(tmp_path / "s"))
    assert [r[2] for r in spark.read.csv(str(tmp_path / "s")).collect()] == ["1.5", "0.5"]


PAGE = """<html><head><link href="/css?r430"></head><body><div id="pageHeader"><h1>A &amp; B</h1></div>
<div class="postTopic" id="post_1"><small>#1 - 2023-3-7 00:34</small><strong><a href="/user/u1">One</a></strong><div class="topic_content">Hello<br> <b>you</b></div></div>
<div id="comment_list"><div class="row_reply" id="post_2"><small>#2 - 2023-3-7 01:00</small><strong><a href="/user/u2">Two</a></strong>
<div class="message"><span class="tip_collapsed">删除了回复</span></div>
<div class="sub_reply" id="post_3"><small>#2-1 - 2023-3-7 02:00</small><a href="/user/u3">Three</a><div class="cmt_sub_content">sub</div></div></div></div></body></html>"""


def test_topic_pages(spark):
    rows = {r.id: r for r in topic_pages.parse_pages(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<div id=post_x>")], "page_id bigint, contentHtml string")).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].heading == "A &amp; B" and rows[1].html == "Hello<br> <b>you</b>"
    assert (rows[1].username, rows[1].nickname, rows[1].floor, rows[1].dateline, rows[1].state) == ("u1", "One", 1, 1678120440, 0)
    assert rows[2].state == 1 and (rows[3].username, rows[3].floor, rows[3].sub) == ("u3", 2, 1)


GROUP = """<html><body><div id="pageHeader"><h1><span><a class="avatar" href="/group/g5">Space</a></span> A &amp; B</h1></div>
<div class="postTopic" id="post_1" data-item-user="u1"><div class="re_info"><small>#1 - 2023-3-7 00:34</small></div><a class=avatar href=/user/u1><span style="background:url('//x/l/000/12_a.jpg')"></span></a>
<div class="inner"><strong><a href="/user/u1">One</a></strong><span class="tip_j">(hi)</span><div class="topic_content">Hello<br> <b>you</b></div></div></div>
<div id="comment_list"><div class="row_reply" id="post_2" data-item-user="77"><div class="re_info"><small>#2 - 2023-3-7 01:00</small></div><div class="inner"><strong><a>Two</a></strong>
<div class="reply_content"><div class="message"><span class="tip_collapsed">删除了回复</span></div><div class="topic_sub_reply">
<div class="sub_reply" id="post_3" data-item-user="u3"><div class="re_info"><small>#2-1 - 2023-3-7 02:00</small></div><div class="inner"><div class="cmt_sub_content">sub</div></div></div><div>folded</div></div></div></div></div>
<div id="post_4" class="row_reply"><div><span class="tip_j">2023-3-7 03:00</span></div><a class="avatar" href="/user/mod"></a><div class="inner"><strong><a>Mod</a></strong><span class="badgeStateSilent">x</span></div></div>
<div id="post_5"><div class="inner">nobody</div></div></div></body></html>"""


def test_topic_parsers(spark):
    pages = [
        (1, 8, 7, GROUP), (2, 10, 7, GROUP), (3, 8, 7, None), (4, 99, 7, GROUP), (5, 8, 7, ""), (6, 21, 7, "<div id=colunmNotice><div><p class=text>no</p></div></div>"),
        (7, 21, 7, '<div id="column_container"><div><h1>moved</h1></div></div>'), (8, 21, 7, '<div id="wrapperClub"><div class="clubMain"></div></div>'),
        (9, 11, 7, '<div id="headerSubject"><h1><a href="/subject/3">Work</a></h1></div><div id="columnEpA"><h2>ep.1 First <small><a href="/ep/70">x</a></small></h2><div class="epDesc">told <span class="tip">首播:2024-02-30</span></div></div>'),
        (10, 200, 7, '<div id="headerSubject"><h1><a href="/person/9">Name</a></h1></div>'), (11, 300, 7, "<div" * 2000 + "<p>" * 3000), (12, 21, 7, '<h1 class="title">T</h1><div id="entry_content">e</div>'),
    ]
    rows = {r.page_id: r for r in topic_parsers.parse_topics(spark.createDataFrame(pages, "page_id bigint, type int, id int, contentHtml string")).collect()}
    assert set(rows) == set(range(1, 13)) - {3, 4} and {k: r.status for k, r in rows.items()} == dict.fromkeys((1, 2, 9, 10, 12), "ok") | {5: "unparsed", 6: "deleted", 7: "redirect", 8: "club", 11: "unparsed"}
    assert [rows[k].state for k in (6, 7, 8)] == [1, 32, 64]
    r = rows[1]
    assert (r.title, r.space, r.space_name, r.uid, r.top_post_pid, r.dateline, r.state, r.display) == ("A & B", "g5", "Space", 12, 1, 1678120440, 4, False)
    assert [(p.id, p.floor, p.sub, p.related, p.uid, p.username, p.state, p.dateline) for p in r.posts] == [
        (1, 1, None, None, 12, "u1", 0, 1678120440), (2, 2, None, None, 77, "77", 1, 1678122000), (3, 2, 1, 2, None, "u3", 0, 1678125600), (4, 3, None, None, None, "mod", 4, 1678129200),
    ]
    assert (r.posts[0].html, r.posts[0].sign, r.posts[0].nickname) == ("Hello<br> <b>you</b>", "hi", "One")
    assert (rows[9].id, rows[9].title, rows[9].space, rows[9].top_post_pid, rows[9].dateline, rows[9].posts[0].dateline) == (70, "ep.1 First", "3", -70, None, 0)
    assert (rows[10].id, rows[10].title, [(p.id, p.username, p.html) for p in rows[10].posts]) == (9, "Name", [(-9, "_pseudo_writer", "")])
    assert [(p.id, p.username, p.html, p.dateline) for p in rows[12].posts] == [(-7, None, "e", None)]


def git(repo, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}
    subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env)


def commit(repo, msg, **files):
    for name, text in files.items():
        p = repo / name.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text) if text is not None else p.unlink()
    git(repo, "add", "-A")
    git(repo, "commit", "-m", msg)


def test_git_log(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    git(repo, "init")
    commit(repo, "META: Init.", group__1="one")
    commit(repo, 'GROUP TOPIC: "quotes" 😀 | 1700000000000', group__1="two", group__ünï="x")
    commit(repo, "gone", group__1=None)
    spark.dataSource.register(GitLogSource)
    rows = spark.read.format("git_log").option("path", str(repo)).option("batch_commits", "1").load().orderBy("seq", "path").collect()
    assert [(r.seq, r.path, r.content) for r in rows] == [(0, "group/1", "one"), (1, "group/1", "two"), (1, "group/ünï", "x")]
    assert "😀" in rows[1].msg and rows[0].committed % 1000 == 0
    source = spark.readStream.format("git_log").option("path", str(repo)).load()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        # a source with its own stream reader is drained by processing what there is
        q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()

    drain()
    assert spark.read.parquet(out).count() == 3
    commit(repo, "more", blog__2="b")
    drain()
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["blog/2", "group/1", "group/1", "group/ünï"]
    # options: one file, from a commit on, after a commit; and a history that is rewritten under the stream
    ids = commits(str(repo))
    load = lambda **o: sorted((r.seq, r.path) for r in spark.read.format("git_log").options(path=str(repo), **o).load().collect())
    assert load(file="group/1", content="false") == [(0, "group/1"), (1, "group/1")] and load(first=ids[1])[0] == (0, "group/1") and load(since=ids[2]) == [(0, "blog/2")]
    git(repo, "checkout", "-q", "--detach", ids[1])
    git(repo, "checkout", "-q", "-B", "other")
    commit(repo, "instead", ep__3="e")
    commit(repo, "and more", ep__4="e")
    drain()
    assert sorted(r.path for r in spark.read.parquet(out).collect())[1:3] == ["ep/3", "ep/4"]


def test_texts_of_any_charset():
    for text, charset in (("abc é", "utf-8"), ("茶话会，你好", "gb18030"), ("abc", "utf-16"), ("﻿x", "utf-8")):
        assert decode(text.encode(charset)) == text.lstrip("﻿")
    assert decode(b"") == "" and decode(bytes(range(256)))


def test_stream_ingest(spark, tmp_path):
    schema = "seq bigint, type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint"
    src = str(tmp_path / "src")
    target = stream.SnapshotTable(spark, str(tmp_path / "t"), schema.replace("seq bigint, ", ""), ["type", "id", "mid"])
    assert target.read().count() == 0
    spark.createDataFrame([(1, 8, 1, 1, 5, 100, 0, None)], schema).write.mode("append").parquet(src)
    run = lambda: stream.ingest(stream.parquet_stream(spark, src, schema), target, merge.upsert_posts, str(tmp_path / "c"))
    run()
    spark.createDataFrame([(2, 8, 1, 1, 6, 200, 1, 7), (2, 8, 2, 1, 6, 200, 1, 7)], schema).write.mode("append").parquet(src)
    run()
    want = [(8, 1, 1, 5, 100, 1, 7), (8, 2, 1, 6, 200, 1, 7)]
    assert sorted(map(tuple, target.read().collect())) == want
    (tmp_path / "t" / "_versions" / "00000099.json").touch()  # a writer that died
    assert sorted(map(tuple, target.read().collect())) == want
    stream.reset(spark, str(tmp_path / "c"))
    run()  # all deliveries again: the same rows
    assert sorted(map(tuple, target.read().collect())) == want


def test_a_batch_applied_twice_changes_nothing(spark, tmp_path):
    """For the rules of all tables, also those that count versions."""
    topics = "type int, id int, uid bigint, sid bigint, dateline bigint, state int, top_post_pid bigint, last_post_pid bigint, title string"
    cases = {
        "topics": (topics, ["type", "id"], merge.upsert_topics, [(8, i, None, 1, 5, i % 2, 1, None, "t") for i in range(6)]),
        "posts": ("type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint", ["type", "id", "mid"], merge.upsert_posts, [(8, i, 1, None, 5, i % 2, None) for i in range(6)]),
        "users": ("id bigint, username string, nickname string", ["id"], merge.upsert_users, [(i, f"u{i}", None) for i in range(6)]),
        "naming": ("type int, sid bigint, name string, display_name string", ["type", "sid"], merge.upsert_naming, [(8, i, "n", None) for i in range(6)]),
    }
    for name, (schema, keys, rule, rows) in cases.items():
        target = stream.SnapshotTable(spark, str(tmp_path / name), schema, keys, buckets=3)
        run = stream.merge_batch(target, rule, stream="s")
        batches = [spark.createDataFrame([(k, *r) for r in rows[: 3 + 2 * k]], "seq bigint, " + schema) for k in (0, 1)]
        run(batches[0], 0)
        run(batches[1], 1)
        once = sorted(map(str, target.read().collect()))
        for k in (0, 1):
            run(batches[k], k)
        assert sorted(map(str, target.read().collect())) == once and len(once) == 5, name
    assert {r.last_post_pid for r in stream.SnapshotTable(spark, str(tmp_path / "topics"), topics, ["type", "id"], 3).read().where("id < 3").collect()} == {-1}
    assert {r.last_post_pid for r in stream.SnapshotTable(spark, str(tmp_path / "topics"), topics, ["type", "id"], 3).read().where("id > 2").collect()} == {None}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    target = stream.SnapshotTable(spark, str(tmp_path / "t"), "id bigint, username string, nickname string", ["id"], buckets=4)
    run = stream.merge_batch(target, merge.upsert_users)
    run(spark.range(40).selectExpr("0L as seq", "id", "'a' as username", "'b' as nickname"), 0)
    first = target.version()["gens"]
    run(spark.range(1).selectExpr("1L as seq", "id", "'c' as username", "'d' as nickname"), 1)
    second = target.version()["gens"]
    assert sum(first[b] != second[b] for b in first) == 1 and target.read().count() == 40 and target.read().where("username = 'c'").count() == 1


def test_documents_are_ingested_with_tombstones_and_dead_letters(spark, tmp_path):
    src, check = str(tmp_path / "src"), str(tmp_path / "c")
    tables = stream.DocumentTables(spark, str(tmp_path / "t"), buckets=2)

    def deliver(*rows):
        spark.createDataFrame(rows, "body string, at bigint").coalesce(1).write.mode("append").parquet(src)
        stream.ingest_documents(stream.parquet_stream(spark, src, "body string, at bigint", 1), tables, check)

    deliver((DOC, 1), ("{broken", 1), (DOC.replace('"state": 4', '"state": 5'), 0))
    assert [r.body for r in tables.dead_letters().collect()] == ["{broken"]
    assert sorted(map(tuple, tables.posts.read().collect())) == [(21, 71, 7, 9, 5, 2), (21, 72, 7, -148452161, 6, 4), (21, 73, 7, 0, 7, 1)]
    assert sorted(map(tuple, tables.likes.read().collect())) == [(21, 7, -7, 0, 2), (21, 7, 72, 79, 1)]
    later = DOC.replace(', "72": [{"main_id": 7, "value": 79, "total": 1}]', "").replace('{"id": 72, "user": {"username": "boring"}, "mid": 7, "state": 4, "dateline": 6}', "").replace('"state": 2', '"state": 0')
    deliver((later, 2))
    posts, likes = sorted(map(tuple, tables.posts.read().collect())), sorted(map(tuple, tables.likes.read().collect()))
    assert posts == [(21, 71, 7, 9, 5, 0), (21, 72, 7, -148452161, 6, 1), (21, 73, 7, 0, 7, 1)] and likes == [(21, 7, -7, 0, 2), (21, 7, 72, 79, 0)]
    name = stream.stream_name(spark, check)
    batch = spark.createDataFrame([(DOC, 1), ("{broken", 1)], "body string, at bigint")
    stream.document_batch(tables, stream=name)(batch, 0)  # the first batch again, after a failure
    assert sorted(map(tuple, tables.posts.read().collect())) == posts and sorted(map(tuple, tables.likes.read().collect())) == likes and tables.dead_letters().count() == 1


def test_stream_ingest_in_batches(spark, tmp_path, monkeypatch):
    """More files than a batch takes, the deliveries in no order across them: the same as the SQL over all."""
    import os

    from forumlake.plans import forum
    from tests.oracle import assert_same, connect

    src = tmp_path / "in" / "ba_post_snapshot.parquet"
    src.mkdir(parents=True)
    schema = "snap_ts bigint, type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint"
    deliveries = [7, 3, 9, 1, 8, 2, 6, 4, 5, 0, 9, 0]  # the last two are split over two files, and so over two batches
    for k, n in enumerate(deliveries):
        rows = [(n, 8, i, 1, None if n == 1 else 10 * n + i, 100 + n, n % 3, None if i == 2 or k == 2 else n) for i in range(1, 4) if i < 3 or n > 2]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "one" / str(k)))
        (part,) = (tmp_path / "one" / str(k)).glob("*.parquet")
        part.rename(src / f"part-{k:05d}.parquet")
        os.utime(src / f"part-{k:05d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    batches = []
    replace = stream.SnapshotTable.replace
    monkeypatch.setattr(stream.SnapshotTable, "replace", lambda self, *a: (batches.append(1), replace(self, *a))[1])
    assert assert_same(spark, connect(str(tmp_path / "in")), str(tmp_path / "in"), forum.QUERIES["stream_ingest"], forum.ORACLES["stream_ingest"]) == 3
    assert len(batches) > 1

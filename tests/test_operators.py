"""Forum operators on small inline cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from forumlake.functions import scalars as S
from forumlake.operators import history, holes, identity, merge
from forumlake.operators.relatedness import relatedness
from forumlake.operators.user_stats import user_stats
from forumlake.plans import model


def one(spark, expr, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize(
    ("name", "want"),
    [("lumen", -677341953), ("harbor9", -781441753), ("Ａ", -65313), ("123", 123), ("-5", -5), ("007", -232241559), ("", 0), ("茶话会", -341817533), ("a😀b", -902471888)],
)
def test_string_hash(spark, name, want):
    assert one(spark, S.string_hash("s"), s=name) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<span class="tip_collapsed">删除了回复</span>', 1), ('<span class="tip_collapsed">因违反「…」已被删除</span>', 16),
        ('<span class="post_content_collapsed">…因含有「…」不提倡的内容被折叠…', 128), ('<span class="post_content_collapsed">…回复被折叠…', 256),
        ('<span class="tip_collapsed">回复违反「…」被删除</span>', 16), ("回复被折叠", 0), ("", 0),
    ],
)
def test_post_state(spark, html, want):
    assert one(spark, S.post_state("s"), s=html) == want


def test_scalars(spark):
    assert one(spark, S.id_path("i"), i=123456) == "12/34/123456" and one(spark, S.id_path("i"), i=7) == "00/00/7"
    with pytest.raises(Exception, match="negative"):
        one(spark, S.id_path("i"), i=-1)
    assert one(spark, S.timestamp_hint("m", "a", "b"), m="GROUP TOPIC: … | 1700000000000", a=5, b=4) == 1700000000000
    assert one(spark, S.timestamp_hint("m", "a", "b"), m="META: Init.", a=5, b=4) == 4
    assert one(spark, S.timestamp_hint("m", "a", "b", strict=True), m="Init.", a=5, b=4) == 4
    with pytest.raises(Exception, match="no timestamp"):
        one(spark, S.timestamp_hint("m", "a", "b", strict=True), m="GROUP TOPIC: x", a=5, b=4)
    assert one(spark, S.uid_from_style("s"), s="background-image:url('//x/000/00/01/10001.jpg')") == 10001
    assert one(spark, S.uid_from_style("s"), s="none") is None
    assert one(spark, S.style_revision("s"), s='<link href="/min/g=css?r412">') == 412 and one(spark, S.style_revision("s"), s="") == 398
    assert one(spark, S.user_sign("s"), s="(hello)") == "hello" and one(spark, S.user_sign("s"), s="hello") is None
    assert one(spark, S.guess_uid("s"), s="123") == 123 and one(spark, S.guess_uid("s"), s="99999999999") is None and one(spark, S.guess_uid("s"), s="a1") is None
    assert one(spark, S.post_second("s"), s="2023-3-7 00:34") == 1678120440 and one(spark, S.post_second("s"), s="x") is None
    assert one(spark, S.on_air_second("s"), s="首播:2020-01-02") == (date(2020, 1, 2) - date(1970, 1, 1)).days * 86400
    assert one(spark, S.path_topic("s"), s="group/12/34/123456.html") == 123456 and one(spark, S.path_space("s"), s="group/1.html") == "group"
    assert one(spark, S.message_space("s"), s="group TOPIC: x") == "GROUP"
    assert one(spark, S.human_bytes("i"), i=999) == "999 B" and one(spark, S.human_bytes("i"), i=1_500_000) == "1.5 MB"
    assert one(spark, S.human_duration("i"), i=93_784_000) == "+1d 2h 3m 4s" and one(spark, S.human_duration("i"), i=-4000) == "-4s"
    assert one(spark, S.human_moment("i"), i=0) == "1970-01-01 08:00:00"
    assert one(spark, S.likes_script("s"), s='x\n var data_likes_list = {"1":{}};\n') == '{"1":{}}'
    assert one(spark, S.is_empty_topic("a", "b", "c"), a=1, b=1, c=5) and not one(spark, S.is_empty_topic("a", "b", "c"), a=16, b=1, c=5)


def versions(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq bigint, " + schema)


def test_upserts(spark):
    t = "type int, id int, uid bigint, sid bigint, dateline bigint, state int, top_post_pid bigint, last_post_pid bigint, title string"
    got = merge.upsert_topics(versions(spark, [(8, 1, 5, -9, 100, 0, 11, 12, "a"), (8, 1, None, None, None, 1, None, None, None), (8, 2, 1, 1, 1, None, 1, None, "b"), (8, 2, 1, 1, 1, None, 1, None, "b"), (8, 3, 1, 1, 1, 0, 1, None, "c")], t)).collect()
    rows = {r["id"]: r.asDict() for r in got}
    assert rows[1] == {"type": 8, "id": 1, "uid": 5, "sid": -9, "dateline": 100, "state": 1, "top_post_pid": 11, "last_post_pid": 12, "title": "a"}
    assert rows[2]["last_post_pid"] == -1 and rows[2]["state"] is None and rows[3]["last_post_pid"] is None
    p = merge.upsert_posts(versions(spark, [(8, 11, 1, 5, 100, 0, -9), (8, 11, 1, 6, 200, 1, None)], "type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint")).first()
    assert (p.uid, p.dateline, p.state, p.sid) == (5, 100, 1, 0)
    u = merge.upsert_users(versions(spark, [(5, "a", "nick"), (5, "b", None)], "id bigint, username string, nickname string")).first()
    assert (u.username, u.nickname) == ("b", "nick")
    n = merge.upsert_naming(versions(spark, [(8, -9, "x", "X"), (8, -9, "y", "Y")], "type int, sid bigint, name string, display_name string")).first()
    assert (n.name, n.display_name) == ("x", "Y")
    k = merge.upsert_totals(versions(spark, [("k", "1"), ("k", None)], "k string, v string"), ["k"]).first()
    assert tuple(k) == ("k", None)


def test_upsert_twice_is_once(spark):
    rows = versions(spark, [(8, 11, 1, 5, 100, 0, -9), (8, 11, 1, 6, 200, 1, None), (8, 12, 1, None, 3, 2, 4)], "type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint")
    first = merge.upsert_posts(rows)
    again = merge.upsert_posts(first.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(rows.select(*first.columns, "seq")))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_tombstones(spark):
    like = "type int, mid int, pid bigint, value int, total bigint"
    stored = spark.createDataFrame([(8, 1, 1, 0, 3), (8, 1, 1, 79, 1), (8, 2, 5, 0, 2)], like)
    snap, seen = spark.createDataFrame([(8, 1, 1, 0, 4)], like), spark.createDataFrame([(8, 1)], "type int, mid int")
    assert sorted(map(tuple, merge.like_tombstones(stored, snap, seen).collect())) == [(8, 1, 1, 0, 4), (8, 1, 1, 79, 0), (8, 2, 5, 0, 2)]
    assert sorted(map(tuple, merge.like_tombstones(stored, snap.where("false"), seen.where("false")).collect())) == sorted(map(tuple, stored.collect()))
    post = "type int, mid int, id int, state int"
    p = spark.createDataFrame([(21, 7, -7, 0), (21, 7, 71, 0), (21, 7, 72, 0), (21, 8, 81, 0), (8, 7, 72, 0)], post)
    got = merge.blog_post_tombstones(p, spark.createDataFrame([(21, 7, 71, 0)], post)).collect()
    assert {(r.type, r.mid, r.id): r.state for r in got} == {(21, 7, -7): 0, (21, 7, 71): 0, (21, 7, 72): 1, (21, 8, 81): 0, (8, 7, 72): 0}
    assert merge.recode_type(spark.createDataFrame([(100,), (8,)], "type int")).agg(F.sum("type")).first()[0] == 29


def test_identity_merge(spark):
    users = spark.createDataFrame([(5, "a"), (-8, "a"), (6, "b"), (-9, "c"), (1, "d"), (2, "d"), (-3, "d"), (7, None), (-7, None)], "id bigint, username string")
    pairs = identity.identity_pairs(users)
    assert [tuple(r) for r in pairs.collect()] == [(-8, 5)]
    topics = spark.createDataFrame([(21, 1, -8, -8), (8, 2, -8, -8), (8, 3, None, 4)], "type int, id int, uid bigint, sid bigint")
    assert sorted((r.id, r.uid) for r in identity.repoint(topics, pairs).collect()) == [(1, 5), (2, 5), (3, None)]
    assert sorted((r.id, r.sid) for r in identity.repoint_blog_spaces(topics, pairs).collect()) == [(1, 5), (2, -8), (3, 4)]
    like = "type int, mid int, pid bigint, value int, uid bigint, total bigint"
    given = spark.createDataFrame([(8, 1, 1, 0, 5, 1), (8, 1, 1, 0, -8, 1), (8, 1, 2, 0, 5, 1), (8, 1, 2, 0, -8, 0), (8, 1, 3, 0, -8, 1), (8, 1, 4, 0, 6, 1)], like)
    assert sorted((r.pid, r.uid, r.total) for r in identity.merge_likes_given(given, pairs).collect()) == [(1, 5, 1), (2, -8, 0), (2, 5, 1), (3, 5, 1), (4, 6, 1)]
    assert sorted(r.pid for r in identity.likes_conflicts(given, pairs).collect()) == [1, 2]
    assert sorted(r.id for r in identity.merge_users(users, pairs).where("username is not null").collect()) == [-9, -3, 1, 2, 5, 6]
    hashed = spark.createDataFrame([("a", -1), ("c", -1), ("z", -77), ("e", -5)], "username string, uid bigint")
    more = users.unionByName(spark.createDataFrame([(-4, "e"), (-6, "e")], "id bigint, username string"))
    wanted = spark.createDataFrame([("a",), ("c",), ("z",), ("e",)], "username string")
    assert sorted(map(tuple, identity.username_ids(wanted, more, hashed).collect())) == [("a", 5), ("c", -9), ("z", -77)]
    names = spark.createDataFrame([(21, -8, "a", "A"), (21, 6, "b", "B"), (8, -8, "g", "G")], "type int, sid bigint, name string, display_name string")
    assert sorted((r.type, r.sid) for r in identity.promote_blog_names(names, pairs).collect()) == [(8, -8), (21, 5), (21, 6)]


def ids(spark, xs, t=8):
    return spark.createDataFrame([(t, x) for x in xs], "type int, id bigint")


def test_masks(spark):
    w = holes.words(ids(spark, range(0, 127, 7)))
    assert [(r.word_idx, r.word) for r in w.orderBy("word_idx").collect()] == [(0, -9150747060186627967), (1, 4647998506761461824)]
    assert sorted(r.id for r in holes.word_ids(w).collect()) == list(range(0, 127, 7))
    old, new, seen = (holes.words(ids(spark, x)) for x in ([2, 3], [1], [0, 1, 2]))
    assert sorted(r.id for r in holes.word_ids(holes.merge_masks(old, new, seen)).collect()) == [1, 3]
    far = holes.words(ids(spark, [70]))
    assert holes.word_ids(holes.merge_masks(far, new, seen)).count() == 1  # old bits beyond the visited words are lost
    text = spark.createDataFrame([(8, 0, "2"), (8, 1, "no"), (8, 2, "1")], "type int, line_no int, text string")
    assert sorted(r.id for r in holes.word_ids(holes.lines_to_words(text)).collect()) == [1, 64]
    assert holes.words(ids(spark, [])).count() == 0


def test_holes_and_ranges(spark):
    got = holes.ranges(ids(spark, [1, 2, 3, 5, 7, 8, 8])).orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in got] == [(1, 3), (5, 5), (7, 8)]
    far = [3, 5, holes.SLOT - 1, holes.SLOT, 3 * holes.SLOT + 2]
    want = sorted(set(range(1, max(far) + 1)) - set(far))
    assert sorted(r.id for r in holes.holes(ids(spark, far)).collect()) == want
    assert [(r.lo, r.hi) for r in holes.ranges(ids(spark, [holes.SLOT - 1, holes.SLOT, holes.SLOT + 1])).collect()] == [(holes.SLOT - 1, holes.SLOT + 1)]
    assert holes.holes(ids(spark, [])).count() == 0


def test_recent_window_holes(spark):
    assert holes.recent_window_holes(ids(spark, range(1, 11))).count() == 0
    assert holes.recent_window_holes(ids(spark, [])).count() == 0 and holes.recent_window_holes(ids(spark, range(2, 53, 2), 11)).count() == 0
    even = ids(spark, range(2, 53, 2), 10)
    first = holes.recent_window_holes(even)
    assert sorted(r.id for r in first.collect()) == [47, 49, 51]
    assert sorted(r.id for r in holes.recent_window_holes(even, first).collect()) == [41, 43, 45]


def test_big_holes_and_sample(spark):
    normal = [1, 2, 5, 300]
    got = {r.id for r in holes.big_hole_mask(ids(spark, normal), spark.createDataFrame([(8, 300)], "type int, top bigint")).collect()}
    assert got == {0, 302, *range(6, 300)}
    s = holes.spot_check_sample(ids(spark, range(10_000)), 35, seed=1)
    a, b = sorted(r.id for r in s.collect()), sorted(r.id for r in s.repartition(7).collect())
    assert a == b and len(a) == 35 and a != sorted(r.id for r in holes.spot_check_sample(ids(spark, range(10_000)), 35, seed=2).collect())
    assert holes.spot_check_sample(ids(spark, range(10_000)), 1).count() == 10 and holes.spot_check_sample(ids(spark, range(10_000)), 500).count() == 80
    assert holes.spot_check_sample(ids(spark, range(3)), 50).count() == 3


def test_history(spark):
    rows = [(1, 10, 0, "a"), (1, 20, 0, "b"), (1, 30, 1, "gone"), (2, 10, 1, "gone"), (3, 10, 0, "x"), (4, 10, 16, "g"), (4, 20, None, "y"), (4, 30, 16, "g")]
    v = spark.createDataFrame(rows, "id int, ts bigint, state int, content_html string")
    assert sorted(map(tuple, history.recover_deleted(v, ["id"]).collect())) == [(1, 20, "b"), (4, 20, "y")]
    r = spark.createDataFrame([(1, 5), (1, 20), (1, 25), (1, 99)], "id int, at bigint")
    assert [x.ts for x in history.asof_floor(r, v, ["id"]).orderBy("at").collect()] == [10, 20, 20, 30]
    assert [x.ts for x in history.asof_ceiling(r, v, ["id"]).orderBy("at").collect()] == [10, 20, 30, 10]
    assert history.drop_blocked(v, spark.createDataFrame([(15, 20)], "lo bigint, hi bigint")).where("id = 1").count() == 2
    cut = history.cut_at_block(v.where("id = 1"), ["id"], F.col("ts").isin(10, 30))
    assert sorted(x.ts for x in cut.collect()) == [10, 20]
    assert history.cut_at_block(v.where("id = 3"), ["id"], F.lit(True)).count() == 0
    assert history.first_true(v, ["id"], F.col("state") == 1).where("id = 1").first().ts == 30
    assert history.last_true(v, ["id"], F.col("state") == 0).where("id = 1").first().ts == 20


def test_relatedness_small(spark):
    f = [("t", 1, None, "a"), ("t", 2, None, "b"), ("t", 2, 1, "c"), ("t", 3, None, "a")]
    got = {(r.a, r.b): r.score for r in relatedness(spark.createDataFrame(f, "topic string, floor int, sub int, username string")).collect()}
    # b-a: to the post .6, floors 2 x 2 x .2; c-a: to the post .4, other floors 2 x .2; c-b: to its floor .8
    assert got == {("b", "a"): 1.4, ("c", "a"): 0.8, ("c", "b"): 0.8}


def test_user_stats_nested(spark, sf):
    m = {k: getattr(model, k)(spark, sf) for k in ("posts", "topics", "likes_received", "likes_given", "users", "spaces")}
    some = m["users"].select("username").where("username is not null").orderBy("username").limit(20)
    out = user_stats(m["posts"], m["topics"], m["likes_received"], m["likes_given"], m["users"], m["spaces"], model.AS_OF, some).collect()
    assert out and all(len(r.replies or []) <= 10 and len(r.spaces or []) <= 5 for r in out) and len({r.username for r in out}) <= 20


def test_mask_merge_whole(spark, tmp_path):
    from forumlake.plans import forum

    spark.createDataFrame([(8, 1), (8, 9000), (10, 4), (10, 130)], "type int, id int").write.parquet(str(tmp_path / "ba_topic.parquet"))
    held = {8: {1, 9000}, 10: {4, 130}}
    want = [(t, i) for t, s in held.items() for i in range(1, max(s)) if i not in s and (i % 3 == 0 if i % 5 else i % 2 == 0)]
    assert (8, 8997) in want  # far above the 4,000 at which mask_merge ends its visited mask
    assert sorted(map(tuple, forum.QUERIES["mask_merge_whole"](spark, str(tmp_path)).collect())) == sorted(want)

"""Queries over documents, line files, timelines and scalar functions; with their SQL.

Documents are made from posts and read again: one per post, so that no document grows with a topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.functions import scalars as S
from forumlake.operators import counts, history, holes, identity, merge, user_stats
from forumlake.plans import forum
from forumlake.plans import model as M
from forumlake.plans.model import AS_OF, SQL
from forumlake.schema import DAY, SPACE_TYPES
from forumlake.session import scratch, table
from forumlake.sources import documents, lines, topic_parsers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def hashed(column: str) -> str:
    """The SQL of `string_hash` for a column; a column name stands for itself in the shared text."""
    number = f"try_cast({column} as integer)"
    return f"cast(case when {number} is not null and cast({number} as varchar) = {column} then {number} else {forum._HASHED.replace('username', column)} end as bigint)"


# -- documents ---------------------------------------------------------------
def made_documents(sp: SparkSession, d: str) -> DataFrame:
    """A topic document of each post: with authors known by id, by name alone (every seventh) or not at all, names of spaces, tags, reactions."""
    p = M.posts(sp, d).select("type", "id", "mid", "uid", "dateline", "state", "sid")
    kinds = F.create_map(*[F.lit(x) for k, v in SPACE_TYPES.items() for x in (v, k.upper())])
    blog = F.col("type") == SPACE_TYPES["blog"]
    name = F.concat(F.lit("u"), F.col("uid"))
    user = F.when(F.col("uid").isNotNull(), F.struct(F.when(F.col("id") % 7 != 0, F.col("uid")).alias("id"), name.alias("username"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), F.col("uid"))).alias("nickname")))
    own = F.when(blog & (F.col("id") == -F.col("mid")), F.col("mid")).otherwise(F.col("id")).cast("string")
    who = F.array(F.struct(F.lit("a").alias("username")), F.struct(F.concat(F.lit("b"), F.col("mid") % 5).alias("username")))
    like = F.struct(F.col("mid").alias("main_id"), F.lit("79").alias("value"), (F.col("id") % 4).alias("total"), who.alias("users"))
    space = F.struct(
        F.try_element_at(kinds, F.col("type")).alias("type"), F.concat(F.lit("s"), F.col("sid")).alias("name"), F.concat(F.lit("S"), F.col("sid") % 9).alias("displayName"),
        F.when(blog, F.array(F.lit("all"), F.concat(F.lit("g"), F.col("mid") % 5), F.lit("all"))).alias("tags"), F.when(blog, F.array((F.col("mid") % 11).cast("int"))).alias("relatedSubjectIds"),
        F.struct(F.when(F.col("id") % 2 == 0, F.create_map(own, F.array(like))).alias("data_likes_list")).alias("meta"),
    )
    post = F.struct("id", user.alias("user"), "mid", "state", "dateline")
    doc = F.struct(
        F.col("mid").alias("id"), F.when(F.col("mid") % 3 == 0, F.col("uid")).alias("uid"), F.concat(F.lit("t"), F.col("mid")).alias("title"), "dateline", F.lit(True).alias("display"),
        F.col("id").alias("topPostPid"), "state", space.alias("space"), F.array(post).alias("postList"),
    )
    return documents.read_topics(p.select(F.to_json(doc).alias("body")))


# names are hashed once each
_DOCS = SQL + f""", q0 as (select *, 'u' || uid as nm, 's' || sid as sn from p), hn as (select nm, {hashed("nm")} as hu from (select distinct nm from q0 where nm is not null)),
    hm as (select sn, {hashed("sn")} as hs from (select distinct sn from q0 where sn is not null)), q as (select q0.*, hu, hs from q0 left join hn using (nm) left join hm using (sn)) """
_AUTHOR = "case when id % 7 <> 0 then uid else hu end"


@query("document_post_rows", _DOCS + f"select type, id, mid, case when uid is null then 0 else {_AUTHOR} end as uid, dateline, state from q where uid is null or uid <> 0 or id % 7 = 0")
def document_post_rows(sp: SparkSession, d: str) -> DataFrame:
    return documents.post_rows(made_documents(sp, d))


_SID = "case when type = 21 then case when mid % 3 = 0 then uid end else hs end"


@query("document_topic_rows", _DOCS + f"""select type, mid as id, case when mid % 3 = 0 and uid is not null then uid else {_AUTHOR} end as uid, {_SID} as sid, dateline, state, cast(id as bigint) as top_post_pid,
    cast(id as bigint) as last_post_pid, 't' || mid as title from q""")  # fmt: skip
def document_topic_rows(sp: SparkSession, d: str) -> DataFrame:
    return documents.topic_rows(made_documents(sp, d))


@query("document_users", _DOCS + "select distinct cast(case when id % 7 <> 0 then uid end as integer) as id, nm as username, case when id % 2 = 0 then 'n' || uid end as nickname from q where uid is not null")
def document_users(sp: SparkSession, d: str) -> DataFrame:
    return documents.user_rows(made_documents(sp, d))


@query("document_spaces", _DOCS + f""", r as (select type, case when type = 21 then coalesce({_SID}, case when id % 7 <> 0 then uid end) else {_SID} end as sid, case when type = 21 then nm else sn end as name,
    case when type = 21 then coalesce(case when id % 2 = 0 then 'n' || uid end, '') else 'S' || sid % 9 end as display_name from q)
    select distinct * from r where sid is not null and name is not null and display_name is not null""")  # fmt: skip
def document_spaces(sp: SparkSession, d: str) -> DataFrame:
    return documents.naming_rows(made_documents(sp, d))


@query("blog_tags", SQL + "select distinct mid as blog_topic_id, unnest(['all', 'g' || mid % 5]) as tag from p where type = 21")
def blog_tags(sp: SparkSession, d: str) -> DataFrame:
    return documents.blog_tags(made_documents(sp, d))


@query("blog_subjects", SQL + "select distinct mid as blog_topic_id, mid % 11 as subject_id from p where type = 21")
def blog_subjects(sp: SparkSession, d: str) -> DataFrame:
    return documents.blog_subjects(made_documents(sp, d))


@query("document_likes", SQL + "select type, mid, id as pid, 79 as value, id % 4 as total from p where id % 2 = 0")
def document_likes(sp: SparkSession, d: str) -> DataFrame:
    return documents.like_rows(made_documents(sp, d))


@query("document_likes_given", SQL + "select type, mid, id as pid, 79 as value, unnest(['a', 'b' || mid % 5]) as username from p where id % 2 = 0")
def document_likes_given(sp: SparkSession, d: str) -> DataFrame:
    return documents.like_given_rows(made_documents(sp, d))


# -- identity and merges -----------------------------------------------------
@query("username_ids", SQL + forum._PAIRS + f""", w as (select distinct username from u where username is not null union select 'nobody' || id % 50 from u),
    k as (select username, count(*) as n, max(id) as top from us group by username)
    select w.username, case when k.n = 1 or k.top > 0 then cast(k.top as bigint) else {hashed('w.username')} end as uid from w left join k using (username) where k.n is null or k.n = 1 or k.top > 0""")  # fmt: skip
def username_ids(sp: SparkSession, d: str) -> DataFrame:
    u = M.users(sp, d)
    wanted = u.where("username is not null").select("username").union(u.select(F.concat(F.lit("nobody"), F.col("id") % 50)))
    names = wanted.distinct().select("username", S.string_hash("username").alias("uid"))
    return identity.username_ids(wanted, forum._surrogates(sp, d), names)


def _blog_spaces(sp: SparkSession, d: str) -> DataFrame:
    """Blogs are named after their authors, under both ids of an author who has two."""
    return forum._surrogates(sp, d).where("username is not null").select(F.lit(21).alias("type"), F.col("id").alias("sid"), F.col("username").alias("name"))


_BLOGS = ", bs as (select 21 as type, id as sid, username as name from us where username is not null)"


@query("duplicate_blog_names", SQL + forum._PAIRS + _BLOGS + " select type, name, count(*) as n from bs group by type, name having count(*) > 1")
def duplicate_blog_names(sp: SparkSession, d: str) -> DataFrame:
    return identity.duplicate_blog_names(_blog_spaces(sp, d))


@query("promote_blog_names", SQL + forum._PAIRS + _BLOGS + " select distinct bs.type, coalesce(pr.pos, bs.sid) as sid, bs.name from bs left join pr on pr.neg = bs.sid")
def promote_blog_names(sp: SparkSession, d: str) -> DataFrame:
    return identity.promote_blog_names(_blog_spaces(sp, d), identity.identity_pairs(forum._surrogates(sp, d)))


@query("blog_space_merge", SQL + forum._PAIRS + """, b as (select type, id, case when uid > 0 and id % 2 = 0 then -uid else uid end as sid from t where type in (8, 21))
    select b.type, b.id, case when b.type = 21 then coalesce(pr.pos, b.sid) else b.sid end as sid from b left join pr on pr.neg = b.sid""")  # fmt: skip
def blog_space_merge(sp: SparkSession, d: str) -> DataFrame:
    sid = F.when((F.col("uid") > 0) & (F.col("id") % 2 == 0), -F.col("uid")).otherwise(F.col("uid"))
    t = M.topics(sp, d).where("type in (8, 21)").select("type", "id", sid.alias("sid"))
    return identity.repoint_blog_spaces(t, identity.identity_pairs(forum._surrogates(sp, d)))


@query("like_given_tombstones", SQL + """, sn as (select type, mid, pid, value, uid, 1 as total from lr where pid % 3 <> 0 and mid % 2 = 0), seen as (select distinct type, mid from lr where mid % 2 = 0)
    select type, mid, pid, value, uid, 1 as total from sn
    union all select type, mid, pid, value, uid, 0 from lr semi join seen using (type, mid) anti join sn using (type, mid, pid, value, uid)
    union all select type, mid, pid, value, uid, total from lr anti join seen using (type, mid)""")  # fmt: skip
def like_given_tombstones(sp: SparkSession, d: str) -> DataFrame:
    stored = M.likes_given(sp, d)
    seen = stored.where("mid % 2 = 0").select("type", "mid")
    snapshot = stored.where("pid % 3 <> 0 and mid % 2 = 0").withColumn("total", F.lit(1).cast("bigint"))
    return merge.like_tombstones(stored.withColumn("total", F.col("total").cast("bigint")), snapshot, seen, ["type", "mid", "pid", "value", "uid"])


@query("upsert_totals", forum._PV + " select type, mid, id, arg_max(struct_pack(x := state), seq).x as state from v group by 1, 2, 3")
def upsert_totals(sp: SparkSession, d: str) -> DataFrame:
    return merge.upsert_totals(forum._post_versions(sp, d).select("type", "mid", "id", "seq", "state"), ["type", "mid", "id"])


@query("insert_new", "select distinct type, mid, uid from ba_post_snapshot")
def insert_new(sp: SparkSession, d: str) -> DataFrame:
    return merge.insert_new(table(sp, d, "ba_post_snapshot").select("type", "mid", "uid"), ["type", "mid", "uid"])


@query("recode_type", SQL + " select case when type = 300 then 21 else type end as type, id from t")
def recode_type(sp: SparkSession, d: str) -> DataFrame:
    return merge.recode_type(M.topics(sp, d).select("type", "id"), old=300)


# -- nested statistics, spelled out -------------------------------------------
def _nested(sp: SparkSession, d: str) -> DataFrame:
    return user_stats.user_stats(M.posts(sp, d), M.topics(sp, d), M.likes_received(sp, d), M.likes_given(sp, d), M.users(sp, d), M.spaces(sp, d), AS_OF)


_BASE = ", base as (select distinct type, username from (select p.type, u.username from p join u on u.id = p.uid union select t.type, u.username from t join u on u.id = t.uid))"


@query("user_stats_faces", SQL + _BASE + """, r as (select lk.type, lk.value as face_key, u.username, cast(sum(lk.total) as bigint) as cnt
    from lk join t on lk.type = t.type and lk.mid = t.id and t.state <> 1 join p on p.id = lk.pid and p.type = lk.type and p.state <> 1 join u on u.id = p.uid group by all having sum(lk.total) > 0),
    g as (select lr.type, lr.value as face_key, u.username, cast(sum(lr.total) as bigint) as cnt
    from u join lr on lr.uid = u.id join t on lr.type = t.type and lr.mid = t.id and t.state <> 1 join p on p.id = lr.pid and p.type = lr.type and p.state <> 1 group by all having sum(lr.total) > 0)
    select 'received' as side, type, username, face_key, cnt from r semi join base using (type, username) union all select 'given', type, username, face_key, cnt from g semi join base using (type, username)""")  # fmt: skip
def user_stats_faces(sp: SparkSession, d: str) -> DataFrame:
    n = _nested(sp, d)
    sides = [n.select(F.lit(s).alias("side"), "type", "username", F.explode(f"likes_{s}").alias("face_key", "cnt")) for s in ("received", "given")]
    return sides[0].unionByName(sides[1])


@query("user_stats_spaces", SQL + forum._SPACE + "select type, username, name, post_total, topic_total, given from a qualify row_number() over (partition by type, username order by post_total + given desc, name) <= 5")
def user_stats_spaces(sp: SparkSession, d: str) -> DataFrame:
    return _nested(sp, d).select("type", "username", F.explode("spaces").alias("s")).select("type", "username", "s.name", "s.post_total", "s.topic_total", "s.given")


@query("user_stats_replies", SQL + forum._REPLIES + """ select type, username, title, mid, id as pid, dateline, space_display_name from r
    where title is not null and state & 1 = 0 and topic_state & 1 = 0 qualify row_number() over (partition by type, username order by dateline desc nulls last, id desc) <= 10""")  # fmt: skip
def user_stats_replies(sp: SparkSession, d: str) -> DataFrame:
    return _nested(sp, d).select("type", "username", F.explode("replies").alias("s")).select("type", "username", "s.title", "s.mid", "s.pid", "s.dateline", "s.space_display_name")


# a user's request names at most 200 users
@query("user_stats_of_some", SQL + """, wanted as (select distinct username from u where username is not null order by username limit 200), v as (select * from u semi join wanted using (username)),
    ps as (select p.type, v.username, count(*) as post_total from p join v on v.id = p.uid group by 1, 2), ts as (select t.type, v.username, count(*) as topic_total from t join v on v.id = t.uid group by 1, 2)
    select type, username, post_total, topic_total from ps full join ts using (type, username)""")  # fmt: skip
def user_stats_of_some(sp: SparkSession, d: str) -> DataFrame:
    u = M.users(sp, d)
    names = u.where("username is not null").select("username")
    s = user_stats.user_stats(M.posts(sp, d), M.topics(sp, d), M.likes_received(sp, d), M.likes_given(sp, d), u, M.spaces(sp, d), AS_OF, names)
    return s.select("type", "username", "post_total", "topic_total")


def _side(t: str, flags: dict[str, str], prefix: str) -> str:
    bits = ", ".join(f"count(*) filter (x.state & {S.STATE[f]} = {S.STATE[f]}) as {prefix}_{n}" for n, f in flags.items())
    return f"""select x.type, u.username, s.name, count(*) as {prefix}_total, count(*) filter (x.dateline >= {AS_OF - 7 * DAY}) as {prefix}_r7d, count(*) filter (x.dateline >= {AS_OF - 30 * DAY}) as {prefix}_r30d, {bits}
        from {t} x join u on u.id = x.uid join s on s.type = x.type and s.sid = x.sid group by 1, 2, 3"""


@query("space_stat_full", SQL + f""", ps as ({_side('p', counts.POST_FLAGS, 'post')}), ts as ({_side('t', counts.TOPIC_FLAGS, 'topic')}),
    g0 as (select lr.type, u.username, s.sid, s.name, sum(lr.total) as n from u join lr on lr.uid = u.id join t on lr.type = t.type and lr.mid = t.id and t.state <> 1 join s on s.type = t.type and s.sid = t.sid
      group by all having sum(lr.total) > 0), gs as (select type, username, name, cast(sum(n) as bigint) as likes_given from g0 group by 1, 2, 3),
    r0 as (select lk.type, u.username, s.sid, s.name, sum(lk.total) as n {forum._RECEIVED} where t.state <> 1 and p.state <> 1 group by all having sum(lk.total) > 0),
    rs as (select type, username, name, cast(sum(n) as bigint) as likes_received from r0 group by 1, 2, 3)
    select * from ps full join ts using (type, username, name) full join gs using (type, username, name) full join rs using (type, username, name)""")  # fmt: skip
def space_stat_full(sp: SparkSession, d: str) -> DataFrame:
    return user_stats.space_stat_full(M.posts(sp, d), M.topics(sp, d), M.likes_received(sp, d), M.likes_given(sp, d), M.users(sp, d), M.spaces(sp, d), AS_OF)


@query("mask_xor", SQL + forum._HOLES + " select type, id from h where (id % 2 = 0) <> (id % 3 = 0)")
def mask_xor(sp: SparkSession, d: str) -> DataFrame:
    h = holes.holes(forum._ids(sp, d))
    return holes.word_ids(holes.xor_masks(holes.words(h.where("id % 2 = 0")), holes.words(h.where("id % 3 = 0"))))


# -- spot checks -------------------------------------------------------------
@query("spot_check_round", SQL + forum._IDS.replace(", i", ", i0", 1) + """, i as (select * from i0), m as (select type, max(id) as top from i group by type),
    h as (select m.type, r.id from m, lateral (select unnest(range(1, top + 1)) as id) r anti join i on i.type = m.type and i.id = r.id), c as (select type, count(*) as n from h where id % 3 <> 0 group by type)
    select type, case when n <= 64 then n else least(n, 35) end as n_taken, case when n <= 64 then 0 else least(n, 35) + (select count(*) from h where h.type = c.type and h.id % 3 = 0) end as n_checked, 0 as n_wrong from c""")  # fmt: skip
def spot_check_round(sp: SparkSession, d: str) -> DataFrame:
    """How many ids a round takes of each type, how many are checked afterwards, and how many of those taken weren't to be."""
    h = holes.holes(forum._ids(sp, d))
    unchecked, checked = h.where("id % 3 <> 0"), h.where("id % 3 = 0")
    taken, mask = holes.spot_check_round(unchecked, checked, 35, seed=7)
    wrong = taken.join(unchecked, ["type", "id"], "left_anti").groupBy("type").agg(F.count("*").alias("n_wrong"))
    n = taken.groupBy("type").agg(F.count("*").alias("n_taken")).join(mask.groupBy("type").agg(F.count("*").alias("n_checked")), "type", "left").join(wrong, "type", "left")
    return n.select("type", "n_taken", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_checked", "n_wrong")])


# -- line files --------------------------------------------------------------
def _lines(sp: SparkSession, d: str) -> DataFrame:
    t = table(sp, d, "ba_topic").select(F.col("type").cast("string").alias("repo"), "id")
    return t.select("repo", F.when(F.col("id") % 11 == 0, F.concat(F.lit("x"), "id")).otherwise(F.concat(F.lit(" "), F.col("id"), F.lit(" "))).alias("value"))


@query("id_list", "select distinct cast(type as varchar) as repo, id from ba_topic where id % 11 <> 0")
def id_list(sp: SparkSession, d: str) -> DataFrame:
    return lines.id_list(_lines(sp, d))


@query("fullest_list", """with i as (select distinct cast(type as varchar) as repo, id from ba_topic where id % 11 <> 0)
    select id from i where repo = (select repo from i group by repo order by max(id) desc, repo limit 1)""")  # fmt: skip
def fullest_list(sp: SparkSession, d: str) -> DataFrame:
    return lines.fullest_list(_lines(sp, d))


@query("timestamp_lines", "select id, cast(max(type) as bigint) as ts from ba_topic where id % 5 <> 0 group by id")
def timestamp_lines(sp: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).otherwise(F.concat_ws(":", F.col("id"), F.col("type")))
    return lines.timestamps(table(sp, d, "ba_topic").select(F.col("type").alias("line_no"), value.alias("value")))


@query("mask_file", forum.ORACLES["hole_words"])
def mask_file(sp: SparkSession, d: str) -> DataFrame:
    """A mask written as text, one word per line, and read again."""
    path = scratch(sp, "masks")
    lines.write_words(holes.words(holes.holes(forum._ids(sp, d))), path)
    back = lines.read_words(sp, path)
    return holes.lines_to_words(back.select(F.col("type").cast("int").alias("type"), "line_no", "text"))


# -- timelines ---------------------------------------------------------------
def _commits(sp: SparkSession, d: str) -> DataFrame:
    s = table(sp, d, "ba_post_snapshot").select("type", "snap_ts", "mid").distinct()
    msg = F.concat(F.when(F.col("mid") % 2 == 0, "group topic: ").otherwise("BLOG topic: "), F.lit("x | "), F.col("snap_ts"))
    path = F.array(S.topic_path(F.lit("group"), "mid", ".json"))
    return s.select(F.col("type").alias("repo_id"), F.struct("snap_ts", "mid").alias("commit_id"), path.alias("paths"), msg.alias("msg"), F.lit(False).alias("is_first"), F.lit(1).alias("committed"), F.lit(2).alias("authored"))


@query("path_log", """with c as (select distinct type as repo_id, snap_ts, mid from ba_post_snapshot)
    select repo_id, concat('group/', lpad(cast(mid // 10000 as varchar), 2, '0'), '/', lpad(cast(mid % 10000 // 100 as varchar), 2, '0'), '/', mid, '.json') as path, count(*) as n_commits,
    min(snap_ts) as first_ts, max(snap_ts) as last_ts, 1 as spaces from c group by repo_id, mid""")  # fmt: skip
def path_log(sp: SparkSession, d: str) -> DataFrame:
    return history.path_log(_commits(sp, d))


# commits: one for each delivery; their lists of exact moments lack some topics, and are empty every third commit
@query("timeline", """with v as (select distinct type, mid, snap_ts as ts from ba_post_snapshot), dv as (select type, mid, ts + 5 as ts, ts as hint from v where (mid + ts // 1000) % 4 <> 0),
    x as (select v.*, coalesce(max(dv.ts) filter (dv.hint = v.ts), case when v.mid % 2 = 0 then coalesce(min(dv.ts) filter (dv.ts >= v.ts), min(dv.ts)) end) as document_ts from v left join dv using (type, mid) group by v.type, v.mid, v.ts),
    y as (select *, case when (ts // 1000) % 3 <> 0 and mid % 5 <> 0 then ts // 10000000000 else ts end as moment from x where document_ts is not null)
    select type, mid, moment as ts, max(ts) as page_ts, arg_max(document_ts, ts) as document_ts from y group by type, mid, moment""")  # fmt: skip
def timeline(sp: SparkSession, d: str) -> DataFrame:
    v = forum._versions(sp, d)
    docs = v.where("(mid + ts div 1000) % 4 <> 0").select("type", "mid", (F.col("ts") + 5).alias("ts"), F.col("ts").alias("hint"))
    pages = v.withColumn("hint", F.col("ts")).withColumn("is_meta", F.col("mid") % 2 == 0)
    exact = v.where("(ts div 1000) % 3 <> 0 and mid % 5 <> 0").select(F.col("ts").alias("page_ts"), F.col("mid").alias("id"), F.expr("ts div 10000000000").alias("ts")).distinct()
    return history.timeline(pages, docs, exact, ["type", "mid"])


@query("asof_content", forum._VERSIONS + """, f as (select q.type, q.mid, q.ask, coalesce(max(v.ts) filter (v.ts <= q.ask), min(v.ts)) as ts from q join v using (type, mid) group by 1, 2, 3),
    n as (select type, mid, snap_ts as ts, count(distinct id) as n_posts, max(id) as last_post from ba_post_snapshot group by 1, 2, 3) select f.*, n.n_posts, n.last_post from f join n using (type, mid, ts)""")  # fmt: skip
def asof_content(sp: SparkSession, d: str) -> DataFrame:
    s = table(sp, d, "ba_post_snapshot").groupBy("type", "mid", F.col("snap_ts").alias("ts")).agg(F.count_distinct("id").alias("n_posts"), F.max("id").alias("last_post"))
    return history.content_at(forum._requests(s), s, ["type", "mid"], at="ask")


# -- scalars -----------------------------------------------------------------
@query("scalars_users", """select distinct username, case when regexp_full_match(username, '[0-9]+') then try_cast(username as integer) end as guessed, case when id >= 0 then id end as styled, case when id % 2 = 0 then username end as sign from ba_user where username is not null""")
def scalars_users(sp: SparkSession, d: str) -> DataFrame:
    u = table(sp, d, "ba_user").where("username is not null").select("id", "username").distinct()
    style = F.concat(F.lit("background-image:url('//x.example/pic/user/l/000/00/"), F.col("id"), F.lit("_a.jpg?r=1')"))
    sign = F.when(F.col("id") % 2 == 0, F.concat(F.lit("("), "username", F.lit(")"))).otherwise(F.concat(F.lit("("), "username"))
    return u.select("username", S.guess_uid("username").alias("guessed"), S.uid_from_style(style).cast("bigint").alias("styled"), S.user_sign(sign).alias("sign")).distinct()


@query("scalars_paths", """with t as (select distinct type, id from ba_topic) select id, 'blog' as space, id as topic, case when id % 2 = 0 then 'GROUP' else 'EP' end as named,
    case when id < 1000 then id || ' B' else printf('%.1f kB', ((id + 50) // 100) / 10.0) end as size, case when id % 3 = 0 then '{"7":[' || id || ']}' end as likes from t where type = 8 and id between 1 and 999999""")  # fmt: skip
def scalars_paths(sp: SparkSession, d: str) -> DataFrame:
    t = table(sp, d, "ba_topic").where("type = 8 and id between 1 and 999999").select("id").distinct()
    page = F.when(F.col("id") % 3 == 0, F.concat(F.lit('<script>\n  var data_likes_list = {"7":['), "id", F.lit("]};\n</script>"))).otherwise(F.lit("<p>none</p>"))
    path = S.topic_path(F.lit("blog"), "id", ".html")
    msg = F.when(F.col("id") % 2 == 0, "group topic: a | 1").otherwise("ep topic: b | 2")
    return t.select("id", S.path_space(path).alias("space"), S.path_topic(path).alias("topic"), S.message_space(msg).alias("named"), S.human_bytes("id").alias("size"), S.likes_script(page).alias("likes"))


@query("scalars_times", """with e as (select distinct event_id as n, 1700000000 + event_id * 4211 as sec from events)
    select n, sec - sec % 60 as read, strftime(to_timestamp(sec) + interval 8 hour, '%Y-%m-%d %H:%M:%S') as shown, epoch(cast(strftime(to_timestamp(sec), '%Y-%m-%d') as date))::bigint as aired,
    case when n % 2 = 0 then '-' else '+' end || case when n >= 86400 then (n // 86400) || 'd ' else '' end || case when n >= 3600 then (n % 86400 // 3600) || 'h ' else '' end
    || case when n >= 60 then (n % 3600 // 60) || 'm ' else '' end || (n % 60) || 's' as took from e where n > 0""")  # fmt: skip
def scalars_times(sp: SparkSession, d: str) -> DataFrame:
    e = table(sp, d, "events").where("event_id > 0").select(F.col("event_id").alias("n"), (F.lit(1_700_000_000) + F.col("event_id") * 4211).alias("sec")).distinct()
    local = F.date_format(F.timestamp_seconds(F.col("sec") + 8 * 3600), "yyyy-M-d HH:mm")
    aired = F.concat(F.lit("时长:24m / 首播:"), F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd"))
    ms = F.when(F.col("n") % 2 == 0, -F.col("n") * 1000).otherwise(F.col("n") * 1000)
    return e.select("n", S.post_second(local).alias("read"), S.human_moment(F.col("sec") * 1000).alias("shown"), S.on_air_second(aired).alias("aired"), S.human_duration(ms).alias("took"))


# -- pages -------------------------------------------------------------------
def made_pages(sp: SparkSession, d: str) -> DataFrame:
    """A page of each topic, in the form of its space type: the first post or description, a comment, and an answer to it."""
    t = M.topics(sp, d).where("id > 0").select("type", "id", "uid", "sid", F.coalesce("dateline", F.lit(1_700_000_000)).alias("sec"))
    n = F.col("id").cast("string")

    def moment(plus: int):
        return F.date_format(F.timestamp_seconds(F.col("sec") + 8 * 3600 + plus), "yyyy-M-d HH:mm")

    def post(cls: str, no: int, floor: str, text: str, more="", plus: int = 60):
        user = F.concat(F.lit("w"), F.col("id") % 50)
        return F.concat(
            F.lit(f'<div class="{cls}" id="post_'), F.col("id") * 10 + no, F.lit('" data-item-user="'), user, F.lit(f'" name="floor-{floor}"><div class="post_actions re_info"><div class="action"><small>#{floor} - '), moment(plus),
            F.lit('</small></div></div><a href="/user/'), user, F.lit('" class="avatar"><span style="background-image:url(\'//pic.example/l/000/'), F.when(F.col("id") % 3 == 0, F.concat(n, F.lit(".jpg"))).otherwise("icon.jpg"),
            F.lit(f'\')"></span></a><div class="inner"><strong><a href="/user/x">N&amp;'), user, F.lit('</a></strong> <span class="tip_j">(sign)</span>'), F.lit(text), F.lit(more) if isinstance(more, str) else more, F.lit("</div></div>"),
        )

    sub = post("sub_reply", 2, "2-1", '<div class="cmt_sub_content">so <b>it</b> is<br></div>')
    badge = F.when(F.col("id") % 5 == 0, F.concat(F.lit('<div class="row_reply" id="post_'), F.col("id") * 10 + 3, F.lit('"><div><span class="tip_j">'), moment(120), F.lit('</span></div><a class="avatar" href="/user/mod"></a><div class="inner"><strong><a>M</a></strong><span class="badgeStateClosed">x</span></div></div>'))).otherwise("")
    answer = post("row_reply", 1, "2", '<div class="reply_content"><div class="message"><span class="tip_collapsed">删除了回复</span></div><div class="topic_sub_reply">', F.concat(sub, F.lit("</div></div>")))
    comments = F.concat(F.lit('<div id="comment_list">'), answer, F.when(F.col("type").isin(8, 10), badge).otherwise(""), F.lit("</div>"))
    head = F.concat(F.lit('<html><head><link href="/css?r430"><script>\n  var data_likes_list = {"'), n, F.lit('":[]};\n</script></head><body>\n'))
    forum_page = F.concat(
        F.lit('<div id="pageHeader"><h1><span><a href="/group/g'), F.col("sid"), F.lit('" class="avatar">Space '), F.col("sid"), F.lit("</a></span> T "), n, F.lit("</h1></div>"),
        post("postTopic light_odd", 0, "1", '<div class="topic_content">Hello &amp; <i>you</i></div>', plus=0), comments,
    )
    ep = F.concat(
        F.lit('<div id="headerSubject"><h1><a href="/subject/'), F.col("sid"), F.lit('">Work</a></h1></div><div id="columnEpA"><h2>T '), n, F.lit(' <small><a href="/ep/'), n,
        F.lit('">more</a></small></h2><div class="epDesc">told <span class="tip">时长:24m / 首播:'), F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd"), F.lit("</span></div></div>"), comments,
    )
    mono = F.concat(F.lit('<div id="headerSubject"><h1><a href="/mono/'), n, F.lit('">T '), n, F.lit('</a></h1></div><div id="columnCrtB"><div class="detail">told</div></div>'), comments)
    blog = F.concat(
        F.lit('<div class="author user-card"><a><img src="//pic.example/'), n, F.lit('_x.jpg"></a><div class="title"><p><a href="/user/w'), F.col("id") % 50, F.lit('">Me</a></p></div></div><h1 class="title">T '), n, F.lit('</h1><div class="time">'), moment(0),
        F.lit(' · 3 reads</div><div id="entry_content">told</div><div class="tags"><a>a</a> <a>b</a></div><div class="entry-related-subjects"><a href="/subject/'), n, F.lit('">x</a></div>'), comments,
    )
    gone = F.lit('<div id="colunmNotice"><div><p class="text">no such topic</p></div></div>')
    body = F.when(F.col("id") % 13 == 0, gone).when(F.col("type").isin(8, 10), forum_page).when(F.col("type") == 11, ep).when(F.col("type") == 21, blog).otherwise(mono)
    page = F.when(F.col("id") % 17 == 0, F.lit("<html><body>502</body></html>")).otherwise(F.concat(head, body, F.lit("</body></html>")))
    return t.where("sid is not null or type in (21, 200, 300)").select(F.col("id").cast("bigint").alias("page_id"), "type", "id", page.alias("contentHtml"))


_PAGES = SQL + """, g as (select type, id, sid, coalesce(dateline, 1700000000) as sec from t where id > 0 and (sid is not null or type in (21, 200, 300))),
    x as (select *, case when id % 17 = 0 then 'unparsed' when id % 13 = 0 then 'deleted' else 'ok' end as status, type in (8, 10) as forum, type in (200, 300) as mono, sec - sec % 60 as minute, (sec // 86400) * 86400 as day from g)"""


@query("page_topics", _PAGES + """select type, id, status, case when status = 'ok' then 'T ' || id end as title, case status when 'ok' then case when forum and id % 5 = 0 then 2 else 0 end when 'deleted' then 1 end as state,
    case status when 'ok' then not (forum and id % 5 = 0) when 'deleted' then false end as display, case when status = 'ok' then case when type = 11 then day when not mono then minute end end as dateline,
    case when status = 'ok' then case when forum then case when id % 3 = 0 then id end when type = 21 then id else 0 end end as uid, case when status = 'ok' then case when forum then id * 10 else -id end end as top_post_pid,
    case when status = 'ok' then case when forum then 'g' || sid when type = 11 then cast(sid as varchar) when mono then cast(id as varchar) end end as space,
    case when status = 'ok' then case when forum then 'Space ' || sid when type = 11 then 'Work' when mono then 'T ' || id end end as space_name, case when status = 'ok' and type = 21 then 'a,b' else '' end as tags,
    case when status = 'ok' and type = 21 then id end as subject, case when status <> 'unparsed' then '{"' || id || '":[]}' end as likes from x""")  # fmt: skip
def page_topics(sp: SparkSession, d: str) -> DataFrame:
    t = topic_parsers.parse_topics(made_pages(sp, d))
    return t.select(
        "type", "id", "status", "title", "state", "display", "dateline", "uid", "top_post_pid", "space", "space_name", F.array_join("tags", ",").alias("tags"), F.try_element_at("related_subjects", F.lit(1)).alias("subject"), "likes"
    )


@query("page_posts", _PAGES + """, o as (select * from x where status = 'ok'), f as (
    select type, id as topic, case when forum then id * 10 else -id end as id, case when forum then 1 else 0 end as floor, null as sub, null as related, case when forum then case when id % 3 = 0 then id end when type = 21 then id else 0 end as uid,
      case when forum or type = 21 then 'w' || id % 50 else '_pseudo_writer' end as username, case when forum then 'N&w' || id % 50 when type = 21 then 'Me' else '_pseudo_writer' end as nickname, case when forum then 'sign' end as sign,
      case when mono then 0 when type = 11 then day else minute end as dateline, 0 as state, case when forum then 'Hello &amp; <i>you</i>' when type = 11 then null else 'told' end as html from o
    union all select type, id, id * 10 + 1, 2, null, null, case when id % 3 = 0 then id end, 'w' || id % 50, 'N&w' || id % 50, 'sign', (sec + 60) // 60 * 60, 1, '<span class="tip_collapsed">删除了回复</span>' from o
    union all select type, id, id * 10 + 2, 2, 1, id * 10 + 1, case when id % 3 = 0 then id end, 'w' || id % 50, 'N&w' || id % 50, 'sign', (sec + 60) // 60 * 60, 0, 'so <b>it</b> is<br>' from o
    union all select type, id, id * 10 + 3, 3, null, null, null, 'mod', 'M', null, (sec + 120) // 60 * 60, 2, '<strong><a>M</a></strong><span class="badgeStateClosed">x</span>' from o where forum and id % 5 = 0)
    select * from f""")  # fmt: skip
def page_posts(sp: SparkSession, d: str) -> DataFrame:
    t = topic_parsers.parse_topics(made_pages(sp, d)).select("type", F.col("id").alias("topic"), F.explode("posts").alias("p"))
    pseudo_ep = (F.col("type") == 11) & (F.col("p.username") == topic_parsers.NOBODY)  # its text holds the date it was aired
    names = ("id", "floor", "sub", "related", "uid", "username", "nickname", "sign", "dateline", "state")
    return t.select("type", "topic", *[F.col(f"p.{c}").alias(c) for c in names], F.when(~pseudo_ep, F.col("p.html")).alias("html"))

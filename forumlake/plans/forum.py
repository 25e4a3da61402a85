"""Queries over the forum's tables: counts, reactions, rankings, masks, merges, history; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlake.functions import scalars as S
from forumlake.operators import counts, heavy_keys, history, holes, identity, likes, merge, ranks, user_stats
from forumlake.operators.relatedness import relatedness
from forumlake.plans import model as M
from forumlake.plans.model import AS_OF, SQL
from forumlake.schema import DAY, second
from forumlake.session import scratch, table
from forumlake.sources import documents, topic_pages
from forumlake.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- counts ------------------------------------------------------------------
def _count_queries() -> None:
    for what, frame, t in (("post", M.posts, "p"), ("topic", M.topics, "t")):
        for tail, days in (("all", None), ("30d", 30), ("7d", 7)):
            where = "true" if days is None else f"x.dateline >= {AS_OF - days * DAY}"
            query(f"{what}_count_{tail}", SQL + f"select x.type, x.uid, u.username, x.state, count(*) as cnt from {t} x join u on u.id = x.uid where {where} group by all")(
                lambda sp, d, frame=frame, days=days: counts.activity_count(frame(sp, d), M.users(sp, d), AS_OF, days)
            )
            name = f"{what}_count_space" + ("" if days is None else f"_{tail}")
            query(name, SQL + f"""select x.type, x.uid, s.name, s.display_name, u.username, x.state, count(*) as cnt
                from {t} x join u on u.id = x.uid join s on s.type = x.type and s.sid = x.sid where {where} group by x.type, x.uid, s.sid, s.name, s.display_name, u.username, x.state""")(
                lambda sp, d, frame=frame, days=days: counts.space_count(frame(sp, d), M.users(sp, d), M.spaces(sp, d), AS_OF, days)
            )
        flags = counts.POST_FLAGS if what == "post" else counts.TOPIC_FLAGS
        bits = ", ".join(f"count(*) filter (x.state & {S.STATE[f]} = {S.STATE[f]}) as {n}" for n, f in flags.items())
        query(f"{what}_stat", SQL + f"""select x.type, x.uid, u.username, count(*) as total, count(*) filter (x.dateline >= {AS_OF - 7 * DAY}) as r7d,
            count(*) filter (x.dateline >= {AS_OF - 30 * DAY}) as r30d, {bits} from {t} x join u on u.id = x.uid group by x.type, x.uid, u.username""")(
            lambda sp, d, frame=frame, flags=flags: counts.activity_stat(frame(sp, d), M.users(sp, d), flags, AS_OF)
        )


_count_queries()


# -- reactions ---------------------------------------------------------------
@query("likes_received_by_face", SQL + """select lk.type, lk.value as face_key, u.username, cast(sum(lk.total) as bigint) as cnt
    from lk join t on lk.type = t.type and lk.mid = t.id and t.state <> 1 join p on p.id = lk.pid and p.type = lk.type and p.state <> 1 join u on u.id = p.uid
    group by all having sum(lk.total) > 0""")  # fmt: skip
def likes_received_by_face(sp: SparkSession, d: str) -> DataFrame:
    return likes.received_by_face(M.likes_received(sp, d), M.topics(sp, d), M.posts(sp, d), M.users(sp, d))


@query("likes_given_by_face", SQL + """select lr.type, lr.value as face_key, u.username, cast(sum(lr.total) as bigint) as cnt
    from u join lr on lr.uid = u.id join t on lr.type = t.type and lr.mid = t.id and t.state <> 1 join p on p.id = lr.pid and p.type = lr.type and p.state <> 1
    group by all having sum(lr.total) > 0""")  # fmt: skip
def likes_given_by_face(sp: SparkSession, d: str) -> DataFrame:
    return likes.given_by_face(M.likes_given(sp, d), M.topics(sp, d), M.posts(sp, d), M.users(sp, d))


@query("likes_given_by_space", SQL + """select lr.type, u.username, s.sid, s.name as space_name, s.display_name as space_display_name, cast(sum(lr.total) as bigint) as cnt
    from u join lr on lr.uid = u.id join t on lr.type = t.type and lr.mid = t.id and t.state <> 1 join s on s.type = t.type and s.sid = t.sid
    group by all having sum(lr.total) > 0""")  # fmt: skip
def likes_given_by_space(sp: SparkSession, d: str) -> DataFrame:
    return likes.given_by_space(M.likes_given(sp, d), M.topics(sp, d), M.users(sp, d), M.spaces(sp, d))


_RECEIVED = """from u join p on p.uid = u.id join lk on p.type = lk.type and lk.mid = p.mid and p.id = lk.pid
    join t on t.type = lk.type and lk.mid = t.id join s on s.type = t.type and s.sid = t.sid"""


@query("likes_received_by_space", SQL + f"""select lk.type, u.username, s.sid, s.name as space_name, s.display_name as space_display_name, cast(sum(lk.total) as bigint) as cnt
    {_RECEIVED} where t.state <> 1 and p.state <> 1 group by all having sum(lk.total) > 0""")  # fmt: skip
def likes_received_by_space(sp: SparkSession, d: str) -> DataFrame:
    return likes.received_by_space(M.likes_received(sp, d), M.topics(sp, d), M.posts(sp, d), M.users(sp, d), M.spaces(sp, d))


@query("likes_received_by_space_name", SQL + f"select lk.type, u.username, s.name as space_name, cast(sum(lk.total) as bigint) as cnt {_RECEIVED} group by all having sum(lk.total) > 0")
def likes_received_by_space_name(sp: SparkSession, d: str) -> DataFrame:
    return likes.received_by_space(M.likes_received(sp, d), M.topics(sp, d), M.posts(sp, d), M.users(sp, d), M.spaces(sp, d), alive=False, by="name")


@query("view_likes_sum", SQL + """select lk.type, lk.value as face_key, u.id as uid, u.username, cast(sum(lk.total) as bigint) as cnt
    from u join p on p.uid = u.id join lk on p.id = lk.pid and p.type = lk.type group by all having sum(lk.total) > 0""")  # fmt: skip
def view_likes_sum(sp: SparkSession, d: str) -> DataFrame:
    return likes.sum_by_face(M.likes_received(sp, d), M.posts(sp, d), M.users(sp, d))


# -- rankings ----------------------------------------------------------------
@query("rank_replies", SQL + """select p.type, p.mid, p.uid, p.id, p.dateline, p.state, p.sid, t.title, u.username,
    rank() over (partition by p.type, p.mid, p.uid order by p.dateline desc nulls last, p.id desc) as rank_reply_asc
    from u join p on u.id = p.uid join t on p.type = t.type and t.id = p.mid""")  # fmt: skip
def rank_replies(sp: SparkSession, d: str) -> DataFrame:
    return ranks.rank_replies(M.posts(sp, d), M.topics(sp, d), M.users(sp, d))


_LAST = "from u join t on u.id = t.uid join p on t.last_post_pid = p.id and t.type = p.type"
_RANK = "rank() over (partition by t.type, t.uid order by p.dateline desc nulls last, p.id desc)"


@query("rank_topics", SQL + f"select t.*, p.dateline as last_update_time, u.username, {_RANK} as rank_last_reply, {_RANK} as rank_dateline {_LAST}")
def rank_topics(sp: SparkSession, d: str) -> DataFrame:
    return ranks.rank_topics(M.topics(sp, d), M.posts(sp, d), M.users(sp, d))


@query("recent_topics", SQL + f"""select * from (select t.*, p.dateline as last_update_time, u.username, s.display_name as space_display_name, {_RANK} as rank_last_reply
    {_LAST} left join s on t.type = s.type and t.sid = s.sid where t.state <> 1 and t.dateline >= {AS_OF - ranks.YEARS3}) where rank_last_reply <= 10""")  # fmt: skip
def recent_topics(sp: SparkSession, d: str) -> DataFrame:
    return ranks.recent_topics(M.topics(sp, d), M.posts(sp, d), M.users(sp, d), M.spaces(sp, d), AS_OF)


_REPLIES = f"""
, f as (select p.*, t.title, t.state as topic_state, t.sid as topic_sid, row_number() over (partition by p.type, p.uid, p.mid order by p.dateline desc nulls last, p.id desc) as n
        from p join t on t.id = p.mid and t.type = p.type and t.top_post_pid <> p.id where p.uid in (select id from u) and p.dateline >= {AS_OF - ranks.YEARS3}),
g as (select *, row_number() over (partition by type, uid order by dateline desc nulls last, id desc) as k from f where n = 1),
r as (select g.type, g.id, g.mid, g.uid, g.dateline, g.state, g.sid, g.title, u.username, g.topic_state, s.display_name as space_display_name
      from g join u on u.id = g.uid left join s on s.type = g.type and s.sid = g.topic_sid where k <= 10)"""


@query("recent_replies", SQL + _REPLIES + " select * from r")
def recent_replies(sp: SparkSession, d: str) -> DataFrame:
    return ranks.recent_replies(M.posts(sp, d), M.topics(sp, d), M.users(sp, d), M.spaces(sp, d), AS_OF)


@query("reply_briefs", SQL + _REPLIES + """ select type, username, title, mid, id as pid, dateline, space_display_name from r
    where title is not null and state & 1 = 0 and topic_state & 1 = 0 qualify row_number() over (partition by type, username order by dateline desc nulls last, id desc) <= 10""")  # fmt: skip
def reply_briefs(sp: SparkSession, d: str) -> DataFrame:
    return ranks.reply_briefs(recent_replies(sp, d))


_GIVEN = f"""
, g as (select p.type, p.mid, cast(p.id as bigint) as pid, u.username, lr.value as face_key, t.title, p.dateline, s.display_name as space_display_name,
        rank() over (partition by p.type, p.mid, lr.uid order by p.dateline desc nulls last, p.id desc) as rank_like_rev_asc
        from u join lr on lr.uid = u.id join p on lr.type = p.type and lr.mid = p.mid and lr.pid = p.id join t on p.type = t.type and p.mid = t.id
        left join s on t.type = s.type and t.sid = s.sid where lr.total <> 0 and p.state <> 1 and p.state <> 16 and t.state <> 1),
r as (select * from g where rank_like_rev_asc <= 5 and dateline >= {AS_OF - ranks.YEARS3})"""


@query("recent_likes_given", SQL + _GIVEN + " select * from r")
def recent_likes_given(sp: SparkSession, d: str) -> DataFrame:
    return ranks.recent_likes_given(M.likes_given(sp, d), M.posts(sp, d), M.topics(sp, d), M.users(sp, d), M.spaces(sp, d), AS_OF)


@query("like_briefs", SQL + _GIVEN + """, b as (select type, username, mid, max(title) as title, max(dateline) as dateline, max(space_display_name) as space_display_name, count(*) as n_pairs from r group by 1, 2, 3)
    select * from b where title is not null qualify row_number() over (partition by type, username order by dateline desc nulls last, mid) <= 10""")  # fmt: skip
def like_briefs(sp: SparkSession, d: str) -> DataFrame:
    return ranks.like_briefs(recent_likes_given(sp, d)).withColumn("n_pairs", F.size("pairs").cast("bigint")).drop("pairs")


# -- folded statistics -------------------------------------------------------
_SPACE = """
, ps as (select p.type, u.username, s.name, count(*) as post_total from p join u on u.id = p.uid join s on s.type = p.type and s.sid = p.sid group by 1, 2, 3),
ts as (select t.type, u.username, s.name, count(*) as topic_total from t join u on u.id = t.uid join s on s.type = t.type and s.sid = t.sid group by 1, 2, 3),
gs as (select lr.type, u.username, s.name, cast(sum(lr.total) as bigint) as given from u join lr on lr.uid = u.id join t on lr.type = t.type and lr.mid = t.id and t.state <> 1
       join s on s.type = t.type and s.sid = t.sid group by 1, 2, 3 having sum(lr.total) > 0),
a as (select type, username, name, coalesce(post_total, 0) as post_total, coalesce(topic_total, 0) as topic_total, coalesce(given, 0) as given
      from ps full join ts using (type, username, name) left join gs using (type, username, name))
"""


@query("space_stat_top5", SQL + _SPACE + "select * from a qualify row_number() over (partition by type, username order by post_total + given desc, name) <= 5")
def space_stat_top5(sp: SparkSession, d: str) -> DataFrame:
    return user_stats.space_stat(M.posts(sp, d), M.topics(sp, d), M.likes_given(sp, d), M.users(sp, d), M.spaces(sp, d))


@query("user_stat", SQL + f"""
, ps as (select p.type, u.username, count(*) as post_total, count(*) filter (p.dateline >= {AS_OF - 7 * DAY}) as post_r7d, count(*) filter (p.dateline >= {AS_OF - 30 * DAY}) as post_r30d,
         count(*) filter (p.state & 1 = 1) as post_deleted, count(*) filter (p.state & 16 = 16) as post_admin_deleted, count(*) filter (p.state & 128 = 128) as post_violative,
         count(*) filter (p.state & 256 = 256) as post_collapsed from p join u on u.id = p.uid group by 1, 2),
ts as (select t.type, u.username, count(*) as topic_total, count(*) filter (t.dateline >= {AS_OF - 7 * DAY}) as topic_r7d, count(*) filter (t.dateline >= {AS_OF - 30 * DAY}) as topic_r30d,
         count(*) filter (t.state & 1 = 1) as topic_deleted, count(*) filter (t.state & 4 = 4) as topic_silent, count(*) filter (t.state & 2 = 2) as topic_closed,
         count(*) filter (t.state & 8 = 8) as topic_reopen from t join u on u.id = t.uid group by 1, 2)
select * from ps full join ts using (type, username)""")  # fmt: skip
def user_stat(sp: SparkSession, d: str) -> DataFrame:
    return user_stats.flat_stat(M.posts(sp, d), M.topics(sp, d), M.users(sp, d), AS_OF)


# -- identity ----------------------------------------------------------------
@query("duplicate_usernames", SQL + "select id, username, nickname from u where username is not null qualify count(*) over (partition by username) >= 2")
def duplicate_usernames(sp: SparkSession, d: str) -> DataFrame:
    return identity.duplicate_usernames(M.users(sp, d))


@query("valid_usernames", "select distinct username from ba_user where username is not null and username in (select nickname from ba_user union select username from ba_user where id % 2 = 0)")
def valid_usernames(sp: SparkSession, d: str) -> DataFrame:
    u = table(sp, d, "ba_user")
    return identity.existing_usernames(u, u.select(F.col("nickname").alias("username")).union(u.where("id % 2 = 0").select("username")))


def _surrogates(sp: SparkSession, d: str) -> DataFrame:
    """Users of whom some also have a hashed id."""
    u = M.users(sp, d)
    return u.select("id", "username").unionByName(u.where("id > 0 and id % 2 = 0").select((-F.col("id")).alias("id"), "username"))


_PAIRS = """, us as (select id, username from u union all select -id, username from u where id > 0 and id % 2 = 0),
pr as (select min(id) as neg, max(id) as pos from us where username is not null group by username having count(*) = 2 and min(id) < 0 and max(id) > 0)"""


@query("identity_merge_posts", SQL + _PAIRS + """, h as (select type, id, mid, case when id % 5 = 0 and uid > 0 and uid % 2 = 0 then -uid else uid end as uid from p)
    select h.type, h.id, h.mid, coalesce(pr.pos, h.uid) as uid from h left join pr on pr.neg = h.uid""")  # fmt: skip
def identity_merge_posts(sp: SparkSession, d: str) -> DataFrame:
    uid = F.when((F.col("id") % 5 == 0) & (F.col("uid") > 0) & (F.col("uid") % 2 == 0), -F.col("uid")).otherwise(F.col("uid"))
    return identity.repoint(M.posts(sp, d).select("type", "id", "mid", uid.alias("uid")), identity.identity_pairs(_surrogates(sp, d)))


@query("identity_merge_users", SQL + _PAIRS + " select us.id, us.username from us where id not in (select neg from pr)")
def identity_merge_users(sp: SparkSession, d: str) -> DataFrame:
    s = _surrogates(sp, d)
    return identity.merge_users(s, identity.identity_pairs(s))


_LIKES2 = """, l2 as (select * from lr union all select type, mid, pid, value, -uid, case when pid % 2 = 0 then total else 1 - total end from lr where uid % 2 = 0 and pid % 3 <> 0)"""


def _given_twice(sp: SparkSession, d: str) -> DataFrame:
    g = M.likes_given(sp, d)
    total = F.when(F.col("pid") % 2 == 0, F.col("total")).otherwise(1 - F.col("total"))
    return g.unionByName(g.where("uid % 2 = 0 and pid % 3 <> 0").withColumn("total", total).withColumn("uid", -F.col("uid")))


@query("identity_merge_likes", SQL + _PAIRS + _LIKES2 + """ select x.type, x.mid, x.pid, x.value, case when pr.pos is not null and y.uid is null then pr.pos else x.uid end as uid, x.total
    from l2 x left join pr on pr.neg = x.uid left join l2 y on y.type = x.type and y.mid = x.mid and y.pid = x.pid and y.value = x.value and y.uid = pr.pos
    where pr.pos is null or y.uid is null or y.total <> x.total""")  # fmt: skip
def identity_merge_likes(sp: SparkSession, d: str) -> DataFrame:
    return identity.merge_likes_given(_given_twice(sp, d), identity.identity_pairs(_surrogates(sp, d)))


@query("likes_rev_conflicts", SQL + _PAIRS + _LIKES2 + """ select a.type, a.mid, a.pid, a.value, pr.neg, pr.pos, a.total as pos_total, b.total as neg_total
    from pr join l2 a on a.uid = pr.pos join l2 b on b.uid = pr.neg and a.type = b.type and a.mid = b.mid and a.pid = b.pid and a.value = b.value""")  # fmt: skip
def likes_rev_conflicts(sp: SparkSession, d: str) -> DataFrame:
    return identity.likes_conflicts(_given_twice(sp, d), identity.identity_pairs(_surrogates(sp, d)))


@query("colliding_likes", SQL + _PAIRS + _LIKES2 + """ select pr.neg, pr.pos, x.type, x.mid, x.pid, x.value, count(*) as n from l2 x join pr on x.uid in (pr.neg, pr.pos) group by all having count(*) >= 2""")
def colliding_likes(sp: SparkSession, d: str) -> DataFrame:
    return identity.colliding_keys(_given_twice(sp, d), identity.identity_pairs(_surrogates(sp, d)), ["type", "mid", "pid", "value"])


# -- holes and masks ---------------------------------------------------------
_IDS = ", i as (select distinct type, cast(id as bigint) as id from ba_topic)"
_HOLES = _IDS + ", m as (select type, max(id) as top from i group by type), h as (select m.type, r.id from m, lateral (select unnest(range(1, top + 1)) as id) r anti join i on i.type = m.type and i.id = r.id)"
_RUNS = "select type, min(id) as lo, max(id) as hi from (select type, id, id - row_number() over (partition by type order by id) as k from {}) group by type, k"


def _ids(sp: SparkSession, d: str) -> DataFrame:
    return table(sp, d, "ba_topic").select("type", F.col("id").cast("bigint").alias("id"))


@query("topic_holes", SQL + _HOLES + " select type, id from h")
def topic_holes(sp: SparkSession, d: str) -> DataFrame:
    return holes.holes(_ids(sp, d))


@query("hole_ranges", SQL + _HOLES + " " + _RUNS.format("h"))
def hole_ranges(sp: SparkSession, d: str) -> DataFrame:
    return holes.hole_ranges(_ids(sp, d))


@query("topic_ranges", SQL + _IDS + " " + _RUNS.format("i"))
def topic_ranges(sp: SparkSession, d: str) -> DataFrame:
    return holes.ranges(_ids(sp, d))


@query("holes_unmasked", SQL + _HOLES + " select type, id from h where id % 7 <> 0")
def holes_unmasked(sp: SparkSession, d: str) -> DataFrame:
    mask = holes.words(holes.holes(_ids(sp, d)).where("id % 7 = 0"))
    return holes.holes(_ids(sp, d)).join(holes.word_ids(mask), ["type", "id"], "left_anti")


@query("holes_first_100", SQL + _HOLES + " select type, id from h qualify row_number() over (partition by type order by id) <= 100")
def holes_first_100(sp: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("type").orderBy("id"))
    return holes.holes(_ids(sp, d)).withColumn("n", n).where("n <= 100").drop("n")


_WORDS = """select e.type, e.word_idx, coalesce(b.word, 0) as word from
    (select type, unnest(range(0, top // 64 + 1)) as word_idx from (select type, max(id) as top from {0} group by type)) e
    left join (select type, id // 64 as word_idx, cast(sum(case when id % 64 = 63 then -9223372036854775808::hugeint else (1::hugeint << (id % 64)::int) end) as bigint) as word from {0} group by 1, 2) b using (type, word_idx)"""


@query("hole_words", SQL + _HOLES + " " + _WORDS.format("h"))
def hole_words(sp: SparkSession, d: str) -> DataFrame:
    return holes.words(holes.holes(_ids(sp, d)))


@query("mask_decode", SQL + _HOLES + " select type, id from h")
def mask_decode(sp: SparkSession, d: str) -> DataFrame:
    return holes.word_ids(holes.words(holes.holes(_ids(sp, d))))


@query("mask_sizes", SQL + _HOLES + " select type, count(*) as cardinality, (max(id) // 64 + 1) * 64 as size from h group by type")
def mask_sizes(sp: SparkSession, d: str) -> DataFrame:
    return holes.mask_sizes(holes.words(holes.holes(_ids(sp, d))))


@query("mask_merge", SQL + _HOLES + """, o as (select * from h where id % 2 = 0), n as (select * from h where id % 3 = 0), v as (select h.* from h join m using (type) where h.id % 5 <> 0 and h.id * 4 <= m.top * 3),
    w as (select type, (max(id) // 64 + 1) * 64 as size from v group by type)
    select h.type, h.id from h join w using (type) where h.id < w.size and
      (case when (h.type, h.id) in (select (type, id) from v) then h.id % 3 = 0 else h.id % 2 = 0 end)""")  # fmt: skip
def mask_merge(sp: SparkSession, d: str) -> DataFrame:
    """With a visited mask that ends at three quarters of each type's greatest id, so that holes beyond it are lost."""
    i = _ids(sp, d)
    h = holes.holes(i)
    near = h.join(i.groupBy("type").agg(F.max("id").alias("top")), "type").where("id % 5 <> 0 and id * 4 <= top * 3").select("type", "id")
    old, new, seen = holes.words(h.where("id % 2 = 0")), holes.words(h.where("id % 3 = 0")), holes.words(near)
    return holes.word_ids(holes.merge_masks(old, new, seen))


@query("mask_merge_whole", SQL + _HOLES + " select type, id from h where case when id % 5 <> 0 then id % 3 = 0 else id % 2 = 0 end")
def mask_merge_whole(sp: SparkSession, d: str) -> DataFrame:
    """As mask_merge, with a visited mask that reaches to each type's greatest id, so that no hole is beyond it."""
    i = _ids(sp, d)
    h = holes.holes(i)
    tops = i.groupBy("type").agg(F.max("id").alias("id"))
    old, new = (holes.words(h.where(c)) for c in ("id % 2 = 0", "id % 3 = 0"))
    return holes.word_ids(holes.merge_masks(old, new, holes.words(h.where("id % 5 <> 0").unionByName(tops))))


@query("recent_window_holes", SQL + _IDS + """, c as (select type, count(*) as n, max(id) as top from i where type not in (11, 200, 300) group by type),
    w as (select type, n, unnest(range(top - least(100, n * 6 // 7) + 1, top + 1)) as id from c),
    a as (select w.*, w.id - row_number() over (partition by w.type order by w.id) as k from w anti join i on i.type = w.type and i.id = w.id),
    b as (select *, count(*) over (partition by type, k) as len from a)
    select type, id from b where len <= 35 qualify row_number() over (partition by type order by id desc) <= least(n // 8, 10)""")  # fmt: skip
def recent_window_holes(sp: SparkSession, d: str) -> DataFrame:
    return holes.recent_window_holes(_ids(sp, d).distinct())


@query("big_hole_mask", SQL + """, g as (select type, cast(id as bigint) as id from t where state = 0), m as (select type, max(cast(id as bigint)) as top from t group by type),
    a as (select type, unnest(range(0, top + 1)) as id from m), x as (select a.*, a.id - row_number() over (partition by a.type order by a.id) as k from a anti join g on g.type = a.type and g.id = a.id),
    y as (select type, id, count(*) over (partition by type, k) as len from x)
    select type, id from y where len > 100 union select type, 0 from m union select type, top + 2 from m""")  # fmt: skip
def big_hole_mask(sp: SparkSession, d: str) -> DataFrame:
    t = M.topics(sp, d)
    return holes.big_hole_mask(t.where("state = 0").select("type", "id"), t.groupBy("type").agg(F.max("id").alias("top")))


@query("max_topic_id", SQL + " select type, max(id) as max_id from t group by type")
def max_topic_id(sp: SparkSession, d: str) -> DataFrame:
    return M.topics(sp, d).groupBy("type").agg(F.max("id").alias("max_id"))


@query("topic_ids_by_state", SQL + " select type, id from t where state = 0")
def topic_ids_by_state(sp: SparkSession, d: str) -> DataFrame:
    return M.topics(sp, d).where("state = 0").select("type", "id")


@query("spot_check_sample")
def spot_check_sample(sp: SparkSession, d: str) -> DataFrame:
    return holes.spot_check_sample(holes.holes(_ids(sp, d)), 35, seed=7)


@query("hidden_mask", SQL + """, e as (select type, cast(id as bigint) as id, (coalesce(state, 0) & 97) <> 0 or top_post_pid is null or top_post_pid in (0, -1) as empty, (coalesce(state, 0) & 32) = 32 as redirect from t)
    select type, id from e where empty and not redirect and not (type in (8, 10, 21) and id = 0) union select type, max(id) + 1 from e group by type""")  # fmt: skip
def hidden_mask(sp: SparkSession, d: str) -> DataFrame:
    t = M.topics(sp, d)
    return holes.hidden_mask(t.select("type", "id", S.is_empty_topic("state", F.lit(1), "top_post_pid").alias("empty"), F.coalesce(S.has_flag("state", "BLOG_REDIRECT"), F.lit(False)).alias("redirect")))


@query("known_max_ids", """select type, max(id) as id from (select type, cast(id as bigint) as id from ba_topic union all select type, mid from ba_post) group by type""")
def known_max_ids(sp: SparkSession, d: str) -> DataFrame:
    return holes.max_ids(table(sp, d, "ba_topic"), table(sp, d, "ba_post").select("type", F.col("mid").alias("id")))


@query("spot_check_list")
def spot_check_list(sp: SparkSession, d: str) -> DataFrame:
    return holes.to_visit(spot_check_sample(sp, d), recent_window_holes(sp, d))


# -- merges ------------------------------------------------------------------
# versions: the deliveries of posts, numbered by delivery; of rows repeated in one, one
_PV = """with v as (select type, id, mid, snap_ts as seq, max(uid) as uid, max(dateline) as dateline, max(state) as state, max(sid) as sid from ba_post_snapshot group by 1, 2, 3, 4)"""


def _post_versions(sp: SparkSession, d: str) -> DataFrame:
    s = table(sp, d, "ba_post_snapshot").withColumnRenamed("snap_ts", "seq")
    return s.groupBy("type", "id", "mid", "seq").agg(*[F.max(c).alias(c) for c in ("uid", "dateline", "state", "sid")])


@query("upsert_post", _PV + """ select type, id, mid, arg_min(struct_pack(x := uid), seq).x as uid, arg_min(struct_pack(x := dateline), seq).x as dateline,
    arg_max(struct_pack(x := state), seq).x as state, arg_max(struct_pack(x := coalesce(sid, 0)), seq).x as sid from v group by 1, 2, 3""")  # fmt: skip
def upsert_post(sp: SparkSession, d: str) -> DataFrame:
    return merge.upsert_posts(_post_versions(sp, d))


# topics by delivery: uid, dateline and state of the first post of a topic there, last post the greatest id
_TV = _PV + """, w as (select type, mid as id, seq, arg_min(struct_pack(x := uid), id).x as uid, arg_min(struct_pack(x := sid), id).x as sid, arg_min(struct_pack(x := dateline), id).x as dateline,
    arg_min(struct_pack(x := state), id).x as state, cast(min(id) as bigint) as top_post_pid, case when count(*) > 3 then cast(max(id) as bigint) end as last_post_pid, cast(null as varchar) as title from v group by 1, 2, 3)"""


def _topic_versions(sp: SparkSession, d: str) -> DataFrame:
    g = _post_versions(sp, d).groupBy("type", F.col("mid").alias("tid"), "seq")
    firsts = [F.min_by(c, "id").alias(c) for c in ("uid", "sid", "dateline", "state")]
    last = F.when(F.count("*") > 3, F.max("id").cast("bigint")).alias("last_post_pid")
    return g.agg(*firsts, F.min("id").cast("bigint").alias("top_post_pid"), last, F.lit(None).cast("string").alias("title")).withColumnRenamed("tid", "id")


@query("upsert_topic", _TV + """ select type, id, arg_max(uid, seq) filter (uid is not null) as uid, arg_max(sid, seq) filter (sid is not null) as sid,
    arg_max(dateline, seq) filter (dateline is not null) as dateline, arg_max(struct_pack(x := state), seq).x as state, arg_max(top_post_pid, seq) filter (top_post_pid is not null) as top_post_pid,
    coalesce(arg_max(last_post_pid, seq) filter (last_post_pid is not null), case when count(*) > 1 then -1 end) as last_post_pid, max(title) as title from w group by 1, 2""")  # fmt: skip
def upsert_topic(sp: SparkSession, d: str) -> DataFrame:
    return merge.upsert_topics(_topic_versions(sp, d))


# versions of users: their rows in the order of their names and nicknames
_UV = "with v as (select id, username, nickname, row_number() over (partition by id order by username nulls first, nickname nulls last) as seq from ba_user)"


@query("upsert_user", _UV + " select id, arg_max(struct_pack(x := username), seq).x as username, arg_max(nickname, seq) filter (nickname is not null) as nickname from v group by id")
def upsert_user(sp: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col("username").asc_nulls_first(), F.col("nickname").asc_nulls_last())
    return merge.upsert_users(table(sp, d, "ba_user").withColumn("seq", F.row_number().over(w)))


@query("upsert_naming", """with v as (select *, row_number() over (partition by type, sid order by name, display_name nulls first) as seq from ba_space_naming_mapping)
    select type, sid, arg_min(struct_pack(x := name), seq).x as name, arg_max(struct_pack(x := display_name), seq).x as display_name from v group by 1, 2""")  # fmt: skip
def upsert_naming(sp: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("type", "sid").orderBy("name", F.col("display_name").asc_nulls_first())
    return merge.upsert_naming(table(sp, d, "ba_space_naming_mapping").withColumn("seq", F.row_number().over(w)))


@query("like_tombstones", SQL + """, sn as (select type, mid, pid, value, total + 1 as total from lk where pid % 3 <> 0), seen as (select distinct type, mid from lk where mid % 2 = 0), sx as (select sn.* from sn join seen using (type, mid))
    select type, mid, pid, value, total from sx
    union all select type, mid, pid, value, 0 from lk semi join seen using (type, mid) anti join sx using (type, mid, pid, value)
    union all select type, mid, pid, value, total from lk anti join seen using (type, mid)""")  # fmt: skip
def like_tombstones(sp: SparkSession, d: str) -> DataFrame:
    stored = M.likes_received(sp, d)
    seen = stored.where("mid % 2 = 0").select("type", "mid").distinct()
    snapshot = stored.where("pid % 3 <> 0").withColumn("total", F.col("total") + 1).join(seen, ["type", "mid"], "left_semi")
    return merge.like_tombstones(stored, snapshot, seen)


@query("blog_post_tombstones", SQL + """, sn as (select * from p where type = 21 and id % 4 <> 0), seen as (select distinct type, mid from sn)
    select p.type, p.id, p.mid, p.uid, p.dateline, p.sid,
      case when p.type = 21 and p.id <> -p.mid and (p.type, p.mid) in (select (type, mid) from seen) and p.id % 4 = 0 then 1 else p.state end as state from p""")  # fmt: skip
def blog_post_tombstones(sp: SparkSession, d: str) -> DataFrame:
    p = M.posts(sp, d)
    return merge.blog_post_tombstones(p, p.where("type = 21 and id % 4 <> 0"))


# -- history -----------------------------------------------------------------
_VERSIONS = "with v as (select distinct type, mid, snap_ts as ts from ba_post_snapshot), q as (select distinct type, mid, ask from (select type, mid from v), (select unnest([1745000000000, 1747566000417, 1748000000000, 1790000000000]) as ask))"


def _requests(v: DataFrame) -> DataFrame:
    ats = F.array(*[F.lit(x).cast("bigint") for x in (1745000000000, 1747566000417, 1748000000000, 1790000000000)])
    return v.select("type", "mid").distinct().select("type", "mid", F.explode(ats).alias("ask"))


def _versions(sp: SparkSession, d: str) -> DataFrame:
    return table(sp, d, "ba_post_snapshot").select("type", "mid", F.col("snap_ts").alias("ts")).distinct()


@query("asof_floor", _VERSIONS + " select q.type, q.mid, q.ask, coalesce(max(v.ts) filter (v.ts <= q.ask), min(v.ts)) as ts from q join v using (type, mid) group by 1, 2, 3")
def asof_floor(sp: SparkSession, d: str) -> DataFrame:
    v = _versions(sp, d)
    return history.asof_floor(_requests(v), v, ["type", "mid"], at="ask")


@query("asof_ceiling", _VERSIONS + " select q.type, q.mid, q.ask, coalesce(min(v.ts) filter (v.ts >= q.ask), min(v.ts)) as ts from q join v using (type, mid) group by 1, 2, 3")
def asof_ceiling(sp: SparkSession, d: str) -> DataFrame:
    v = _versions(sp, d)
    return history.asof_ceiling(_requests(v), v, ["type", "mid"], at="ask")


@query("blocked_ranges", "select distinct type, mid, snap_ts as ts from ba_post_snapshot where not (snap_ts between 1746000000000 and 1747000000000 or snap_ts between 1749639600417 and 1749639600417)")
def blocked_ranges(sp: SparkSession, d: str) -> DataFrame:
    r = sp.createDataFrame([(1746000000000, 1747000000000), (1749639600417, 1749639600417)], "lo bigint, hi bigint")
    return history.drop_blocked(_versions(sp, d), r)


@query("space_block_cut", """with v as (select distinct type, mid, snap_ts as ts from ba_post_snapshot), b as (select *, type = 10 and ts between 1748000000000 and 1799000000000 as blocked from v)
    select type, mid, ts from b qualify ts <= max(case when not blocked then ts end) over (partition by type, mid)""")  # fmt: skip
def space_block_cut(sp: SparkSession, d: str) -> DataFrame:
    return history.cut_at_block(_versions(sp, d), ["type", "mid"], (F.col("type") == 10) & F.col("ts").between(1748000000000, 1799000000000))


@query("deleted_post_recovery", _PV + """, a as (select type, mid, id, max(seq) filter (coalesce(state & 17, 0) = 0) as last_alive, max(seq) as last_seen from v group by 1, 2, 3)
    select a.type, a.mid, a.id, a.last_alive, v.uid, v.dateline from a join v on v.type = a.type and v.mid = a.mid and v.id = a.id and v.seq = a.last_alive where last_alive < last_seen""")  # fmt: skip
def deleted_post_recovery(sp: SparkSession, d: str) -> DataFrame:
    return history.recover_deleted(_post_versions(sp, d), content=("uid", "dateline"), ts="seq")


@query("history_timestamps", "select distinct type, mid, snap_ts as ts from ba_post_snapshot")
def history_timestamps(sp: SparkSession, d: str) -> DataFrame:
    return _versions(sp, d)


# commits: one for each delivery of a topic; documents carry the delivery as a hint, a little later
@query("commit_pairing", """with v as (select distinct type, mid, snap_ts as ts from ba_post_snapshot), d as (select type, mid, ts + 5 as ts, ts as hint from v where (mid + ts // 1000) % 3 <> 0)
    select v.type, v.mid, v.ts, coalesce(max(d.ts) filter (d.hint = v.ts), case when v.mid % 2 = 0 then coalesce(min(d.ts) filter (d.ts >= v.ts), min(d.ts)) end) as document_ts
    from v left join d using (type, mid) group by v.type, v.mid, v.ts""")  # fmt: skip
def commit_pairing(sp: SparkSession, d: str) -> DataFrame:
    v = _versions(sp, d)
    docs = v.where("(mid + ts div 1000) % 3 <> 0").select("type", "mid", (F.col("ts") + 5).alias("ts"), F.col("ts").alias("hint"))
    pages = v.withColumn("hint", F.col("ts")).withColumn("is_meta", F.col("mid") % 2 == 0)
    return history.pair_commits(pages, docs, ["type", "mid"]).select("type", "mid", "ts", "document_ts")


@query("file_history", """with c as (select type as repo_id, snap_ts as commit_id, mid from ba_post_snapshot where snap_ts > (select min(snap_ts) from ba_post_snapshot))
    select distinct repo_id, commit_id, concat('group/', lpad(cast(mid // 10000 as varchar), 2, '0'), '/', lpad(cast(mid % 10000 // 100 as varchar), 2, '0'), '/', mid, '.json') as path from c""")  # fmt: skip
def file_history(sp: SparkSession, d: str) -> DataFrame:
    s = table(sp, d, "ba_post_snapshot")
    first = s.agg(F.min("snap_ts")).first()[0]
    c = s.select(F.col("type").alias("repo_id"), F.col("snap_ts").alias("commit_id"), F.array(S.topic_path(F.lit("group"), "mid", ".json")).alias("paths"), F.when(F.col("snap_ts") == first, "META: Init.").otherwise("GROUP").alias("msg"))
    return history.file_index(c.withColumn("is_first", F.lit(True)))


# -- scalars -----------------------------------------------------------------
_POLY = "list_reduce(list_prepend(0::bigint, list_transform(regexp_extract_all(username, '.'), lambda c: ascii(c)::bigint)), lambda h, u: (h * {} % 1000000007 + u) % 1000000007)"
_HASHED = f"-xor({_POLY.format(17)} & 32767, {_POLY.format(19260817)} & 2147450880)"


@query("string_hash", f"""select username, cast(case when try_cast(username as integer) is not null and cast(try_cast(username as integer) as varchar) = username then try_cast(username as integer)
    else {_HASHED} end as integer) as uid from (select distinct username from ba_user where username is not null and username <> '')""")  # fmt: skip
def string_hash(sp: SparkSession, d: str) -> DataFrame:
    return table(sp, d, "ba_user").where("username is not null and username <> ''").select("username").distinct().select("username", S.string_hash("username").alias("uid"))


@query("id_to_path", "select distinct id, concat(lpad(cast(id // 10000 as varchar), 2, '0'), '/', lpad(cast(id % 10000 // 100 as varchar), 2, '0'), '/', id) as path from ba_topic")
def id_to_path(sp: SparkSession, d: str) -> DataFrame:
    return table(sp, d, "ba_topic").select("id").distinct().select("id", S.id_path("id").alias("path"))


@query("timestamp_hint", """select distinct snap_ts, mid, case when mid % 2 = 0 then snap_ts else snap_ts + mid end as hint from ba_post_snapshot""")
def timestamp_hint(sp: SparkSession, d: str) -> DataFrame:
    s = table(sp, d, "ba_post_snapshot").select("snap_ts", "mid").distinct()
    msg = F.when(F.col("mid") % 2 == 0, F.concat(F.lit("GROUP TOPIC: x | "), F.col("snap_ts"))).otherwise(F.lit("META: Init."))
    return s.select("snap_ts", "mid", S.timestamp_hint(msg, F.col("snap_ts") + F.col("mid"), F.col("snap_ts") + 2 * F.col("mid")).alias("hint"))


@query("post_state_from_html", """select type, id, mid, case when state in (1, 16, 128, 256) then state else 0 end as html_state from (select type, id, mid, max(state) as state from ba_post group by 1, 2, 3)""")
def post_state_from_html(sp: SparkSession, d: str) -> DataFrame:
    p = table(sp, d, "ba_post").groupBy("type", "id", "mid").agg(F.max("state").alias("state"))
    html = (
        F.when(F.col("state") == 1, '<span class="tip_collapsed">删除了回复</span>').when(F.col("state") == 16, '<span class="tip_collapsed">回复违反「…」被删除</span>')
        .when(F.col("state") == 128, '<span class="post_content_collapsed">因含有「…」不提倡的内容被折叠').when(F.col("state") == 256, '<span class="post_content_collapsed">回复被折叠')
        .otherwise("因违反「…」被删除")
    )
    return p.select("type", "id", "mid", S.post_state(html).alias("html_state"))


@query("style_revision", "select distinct page_id, coalesce(try_cast(nullif(regexp_extract(substr(contentHtml, 1, 5000), 'css\\?r(\\d+)', 1), '') as integer), 398) as revision from topic")
def style_revision(sp: SparkSession, d: str) -> DataFrame:
    return table(sp, d, "topic").select("page_id", S.style_revision("contentHtml").alias("revision")).distinct()


# -- graph -------------------------------------------------------------------
_FLOORS = """with f as (select l_orderkey as topic, l_linenumber as floor, nullif(row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1, 0) as sub,
    concat('u', l_partkey % 97) as username from lineitem)"""


@query("relatedness", _FLOORS + """, top as (select topic, arg_min(username, floor) as top from f where sub is null group by topic),
 e as (
  select f.username as u, top.top as v, case when sub is null then 0.6 else 0.4 end as s from f join top using (topic)
  union all select a.username, b.username,
    case when a.sub is null and b.sub is null then 0.2 when a.sub is null and b.sub is not null then case when a.floor = b.floor then 0.8 else 0.2 end
         when a.sub is not null and b.sub is null then 0 when a.floor = b.floor then 0.6 else 0.1 end
  from f a join f b on a.topic = b.topic and (a.floor <> b.floor or a.sub is distinct from b.sub))
 select greatest(u, v) as a, least(u, v) as b, round(cast(sum(s) as double), 6) as score from e where u <> v group by 1, 2 having round(cast(sum(s) as double), 6) <> 0""")  # fmt: skip
def relatedness_query(sp: SparkSession, d: str) -> DataFrame:
    li = table(sp, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    return relatedness(li.select(F.col("l_orderkey").alias("topic"), F.col("l_linenumber").alias("floor"), F.when(n > 0, n).alias("sub"), F.concat(F.lit("u"), F.col("l_partkey") % 97).alias("username")))


# -- lookups -----------------------------------------------------------------
@query("posts_of_topic", SQL + " select * from p where type = 8 and mid = 101")
def posts_of_topic(sp: SparkSession, d: str) -> DataFrame:
    return M.posts(sp, d).where("type = 8 and mid = 101")


@query("posts_per_space_pairs", SQL + """ select s.name, count(*) as n, min(p.dateline) as first_sec, max(p.dateline) as last_sec, cast(sum(p.dateline) as bigint) as total from p join s on s.type = p.type and s.sid = p.sid group by s.name""")
def posts_per_space_pairs(sp: SparkSession, d: str) -> DataFrame:
    out = heavy_keys.eager_join_aggregate(M.posts(sp, d), M.spaces(sp, d).select("type", "sid", "name"), ["type", "sid"], ["name"], "dateline", aliases=("n", "total", "first_sec", "last_sec"))
    return out.select("name", "n", "first_sec", "last_sec", F.col("total").cast("bigint").alias("total"))


@query("health_freshness", "select distinct type as repo, max(case when dateline > 100000000000 then dateline // 1000 else dateline end) as last_commit, 1750694400 - max(case when dateline > 100000000000 then dateline // 1000 else dateline end) > 900 and type <> 200 as stale from ba_post group by type")
def health_freshness(sp: SparkSession, d: str) -> DataFrame:
    r = table(sp, d, "ba_post").groupBy(F.col("type").alias("repo")).agg(F.max(second(F.col("dateline"))).alias("last_commit"))
    r = r.withColumn("is_static", F.col("repo") == 200).withColumn("name", F.lit("current"))
    return history.freshness(r, AS_OF).select("repo", "last_commit", "stale")


# -- documents, pages, streams -----------------------------------------------
def _topic_documents(sp: SparkSession, d: str) -> DataFrame:
    """The files that are topic documents (not lists of records), with a digest of their body."""
    return documents.read_topics(table(sp, d, "raw_file").where("body is not null").select("body", F.sha2("body", 256).alias("digest")))


_DOCS = r"""with b as (select distinct body from raw_file where body like '{%"postList"%' and json_valid(body)),
t as (select cast(body->>'$.id' as integer) as topic_id, lower(body->>'$.space.type') as kind, unnest(cast(body->'$.postList' as json[])) as r from b),
p as (select case kind when 'group' then 8 when 'subject' then 10 when 'ep' then 11 when 'blog' then 21 when 'person' then 200 else 300 end as type, topic_id,
      cast(r->>'$.id' as integer) as id, cast(r->>'$.mid' as integer) as mid, cast(r->>'$.user.id' as integer) as user_id, cast(r->>'$.dateline' as bigint) as dateline, cast(r->>'$.state' as integer) as state from t)"""


@query("document_posts", _DOCS + " select type, id, mid, user_id as uid, dateline, state from p where coalesce(user_id, 1) <> 0")
def document_posts(sp: SparkSession, d: str) -> DataFrame:
    """A body that was delivered twice counts once: posts are one by its digest and their place in it, so no body is shuffled."""
    q = documents.all_posts(_topic_documents(sp, d), "digest").where(S.is_real_author(F.col("user.id"), F.col("user.username")))
    return q.dropDuplicates(["digest", "n", "m"]).select("type", "id", "mid", F.col("user.id").alias("uid"), "dateline", F.col("state").cast("int").alias("state"))


@query("document_topic_state", _DOCS + " select type, topic_id as id, cast(bit_or(coalesce(state, 0) & 14) as bigint) as state from p group by 1, 2")
def document_topic_state(sp: SparkSession, d: str) -> DataFrame:
    return documents.topic_state(_topic_documents(sp, d))


@query("document_last_post", _DOCS + " select type, topic_id as id, cast(max(id) as bigint) as last_post_pid from p group by 1, 2")
def document_last_post(sp: SparkSession, d: str) -> DataFrame:
    return documents.topic_rows(_topic_documents(sp, d)).groupBy("type", "id").agg(F.max("last_post_pid").alias("last_post_pid")).where("last_post_pid is not null")


@query("dead_letters", """select count(*) as n from (select distinct body from raw_file where body is not null and trim(body, ' ') <> '') where not (body like '{%"postList"%' and json_valid(body))""")
def dead_letters(sp: SparkSession, d: str) -> DataFrame:
    return documents.dead_letters(_topic_documents(sp, d)).agg(F.count_distinct("digest").alias("n"))


@query("parse_topics")
def parse_topics(sp: SparkSession, d: str) -> DataFrame:
    return topic_pages.parse_pages(table(sp, d, "topic"))


@query("stream_ingest", _PV.replace("with v", "with v0").replace("snap_ts as seq", "snap_ts as seq") + """, v as (select * from v0)
    select type, id, mid, arg_min(struct_pack(x := uid), seq).x as uid, arg_min(struct_pack(x := dateline), seq).x as dateline,
    arg_max(struct_pack(x := state), seq).x as state, arg_max(struct_pack(x := coalesce(sid, 0)), seq).x as sid from v group by 1, 2, 3""")  # fmt: skip
def stream_ingest(sp: SparkSession, d: str) -> DataFrame:
    """Deliveries of posts as a stream, folded into a stored table in small batches, in whatever order files come."""
    schema = "snap_ts bigint, type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint"
    path = f"{d}/ba_post_snapshot.parquet"
    source = stream.parquet_stream(sp, path, schema).withColumnRenamed("snap_ts", "seq")
    stored = "type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint, first_seq bigint, last_seq bigint"
    target = stream.SnapshotTable(sp, scratch(sp, "ingest"), stored, ["type", "id", "mid"])
    stream.ingest(source, target, merge.fold_post_states, scratch(sp, "ingest-checkpoint"))
    return target.read().withColumn("sid", F.coalesce("sid", F.lit(0))).drop("first_seq", "last_seq")


@query("user_stats_nested")
def user_stats_nested(sp: SparkSession, d: str) -> DataFrame:
    return user_stats.user_stats(M.posts(sp, d), M.topics(sp, d), M.likes_received(sp, d), M.likes_given(sp, d), M.users(sp, d), M.spaces(sp, d), AS_OF)

"""The data-preparation problems of the core: queries p1, p3, p5, p6."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.operators.compaction import FileTable
from forumlake.operators.heavy_keys import eager_join_aggregate, key_activity
from forumlake.operators.rolling import daily_values, rolling_totals
from forumlake.operators.snapshot_diff import snapshot_changes
from forumlake.schema import forum_day, second, somebody
from forumlake.session import materialise, scratch, table
from forumlake.sources.topic_files import topic_records

#: Topic ids per partition directory of the compacted table.
SLOT = 1_000_000
LAST_DAY = dt.date(2025, 6, 23)
#: A key is heavy from one in so many posts on (2.5 %), compared in whole numbers.
HEAVY_ONE_IN = 40


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Post records of all topic files, each once, read from the compacted table.

    Partitions that come in one small file, or in well-sized ones, are left alone; copies in them are removed on reading.
    """
    rows = topic_records(table(spark, root, "ba_cache_file_relative_path"), table(spark, root, "raw_file"))
    t = FileTable(
        spark, scratch(spark, "p1"), "mid int, id int, uid bigint, state bigint, dateline bigint, type int, slot int", ["type", "slot"], ["type", "mid", "id"]
    )
    t.append(rows.select("mid", "id", "uid", "state", "dateline", "type", F.expr(f"mid div {SLOT}").cast("int").alias("slot")))
    t.compact()
    return t.read().select("type", "mid", "id")


def activity(spark: SparkSession, root: str) -> DataFrame:
    """What each uid wrote: entity, day, and the key of the post or topic; copies included."""
    posts = table(spark, root, "ba_post").select(somebody(F.col("uid")).alias("entity"), forum_day(second(F.col("dateline"))).alias("day"), F.lit(0).alias("kind"), "type", "id", "mid")
    topics = table(spark, root, "ba_topic").select(
        somebody(F.col("uid")).alias("entity"), forum_day(second(F.col("dateline"))).alias("day"), F.lit(1).alias("kind"), "type", "id", F.lit(0).alias("mid")
    )
    return posts.unionByName(topics)


def lull_after_burst(value: np.ndarray, totals: dict[int, np.ndarray]) -> np.ndarray:
    """Days without activity whose last 30 days hold 12 or more, the last 7 at twice their rate."""
    return (value == 0) & (totals[30] >= 12) & (15 * totals[7] >= 7 * totals[30])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    daily = daily_values(activity(spark, root), ["kind", "type", "id", "mid"])
    rows = rolling_totals(daily, (LAST_DAY - dt.date(1970, 1, 1)).days, (7, 30), lull_after_burst)
    return rows.select(F.col("entity").alias("uid"), F.date_add(F.lit(dt.date(1970, 1, 1)), F.col("day")).cast("string").alias("day"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(spark, table(spark, root, "ba_post_snapshot"))


def p6_keys(spark: SparkSession, root: str) -> DataFrame:
    """Posts, first and last second of every uid and topic, and of the whole."""
    posts = table(spark, root, "ba_post").select("type", "id", "mid", F.col("uid").cast("bigint").alias("uid"), second(F.col("dateline")).alias("sec"))
    return key_activity(posts, table(spark, root, "ba_topic").select("type", "id"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Heavy keys. All keys are counted once, into a table from which both the whole and the keys are read."""
    keys = materialise(spark, p6_keys(spark, root), "p6")
    whole = keys.where("field = 'all'").select("n_posts").scalar()
    return keys.where((F.col("field") != "all") & (F.col("n_posts") * HEAVY_ONE_IN >= whole)).select("field", "type", "key_id")


def p6_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Per topic author: rows of posts joined with rows of topics (copies on both sides), from states."""
    posts = table(spark, root, "ba_post").select("type", F.col("mid").alias("tid"), second(F.col("dateline")).alias("sec"))
    topics = table(spark, root, "ba_topic").select("type", F.col("id").alias("tid"), F.col("uid").alias("author"))
    return eager_join_aggregate(posts, topics, ["type", "tid"], ["author"], "sec", aliases=("n_pairs", "sum_sec", "first_sec", "last_sec"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_keys": p6_keys, "p6_pairs": p6_pairs}

_SEC = "nullif(case when dateline > 100000000000 then dateline // 1000 else dateline end, 0)"
_POST = f"(select distinct type, id, mid, uid, {_SEC} as sec from ba_post)"
_TOPIC = f"(select distinct type, id, uid, {_SEC} as sec from ba_topic)"

_P1 = r"""
with named as (
  select id as fid, regexp_replace(regexp_replace(trim(file_relative_path), '\\', '/', 'g'), '/+', '/', 'g') as p
  from ba_cache_file_relative_path),
files as (
  select fid, lower(regexp_extract(p, '(?i)^(?:.*/)?(group|subject|ep|blog|person|character)/(?:.*/)?([0-9]+)\.json[^/]*$', 1)) as name,
         regexp_extract(p, '(?i)^(?:.*/)?(group|subject|ep|blog|person|character)/(?:.*/)?([0-9]+)\.json[^/]*$', 2) as topic from named),
rec as (
  select case name when 'group' then 8 when 'subject' then 10 when 'ep' then 11 when 'blog' then 21 when 'person' then 200 else 300 end as type,
         cast(topic as integer) as mid,
         unnest(regexp_extract_all(f.body, '\{\s*"id"\s*:\s*(-?[0-9]+)\s*,\s*"user"\s*:\s*\{[^{}]*\}[^{}]*\}', 1)) as id
  from raw_file f join files using (fid) where name <> '')
select distinct cast(type as integer) as type, mid, cast(id as integer) as id from rec
"""

_P3 = f"""
with act as (
  select uid, cast((sec + 28800) // 86400 as integer) as day from {_POST} where uid <> 0 and sec is not null
  union all
  select uid, cast((sec + 28800) // 86400 as integer) as day from {_TOPIC} where uid <> 0 and sec is not null),
daily as (select uid, day, count(*) as n from act where day <= date '2025-06-23' - date '1970-01-01' group by 1, 2),
near as (select distinct uid, day + o as day from daily, (select unnest(range(0, 30)) as o) where day + o <= date '2025-06-23' - date '1970-01-01'),
idle as (select uid, day from near anti join daily using (uid, day)),
tot as (
  select i.uid, i.day, sum(d.n) as t30, coalesce(sum(d.n) filter (d.day > i.day - 7), 0) as t7
  from idle i join daily d on d.uid = i.uid and d.day <= i.day and d.day > i.day - 30 group by 1, 2)
select uid, cast(date '1970-01-01' + cast(day as integer) as varchar) as day from tot where t30 >= 12 and 15 * t7 >= 7 * t30
"""

_P5 = """
with s as (select distinct snap_ts, type, id, mid, uid, dateline, state, sid from ba_post_snapshot),
o as (select snap_ts, lag(snap_ts) over (order by snap_ts) as prev from (select distinct snap_ts from s)),
n as (select s.*, o.prev from s join o using (snap_ts) where prev is not null),
e as (select s.*, o.snap_ts as nxt from s join o on o.prev = s.snap_ts)
select coalesce(n.snap_ts, e.nxt) as snap_ts, coalesce(n.type, e.type) as type, coalesce(n.mid, e.mid) as mid, coalesce(n.id, e.id) as id,
       case when e.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change
from n full join e on n.snap_ts = e.nxt and n.type = e.type and n.id = e.id and n.mid = e.mid
where n.id is null or e.id is null or (n.uid, n.dateline, n.state, n.sid) is distinct from (e.uid, e.dateline, e.state, e.sid)
"""

_P6 = f"""
with p as {_POST}, k as (
  select 'uid' as field, 0 as type, uid as key_id, count(*) as n_posts, min(sec) as first_sec, max(sec) as last_sec, cast(null as boolean) as in_topics from p where uid <> 0 group by uid
  union all
  select 'mid', type, cast(mid as bigint), count(*), min(sec), max(sec), bool_or((type, mid) in (select (type, id) from ba_topic)) from p group by type, mid
  union all
  select 'all', 0, 0, count(*), min(sec), max(sec), null from p)
"""

ORACLES = {
    "p1_found": _P1,
    "p3_found": _P3,
    "p5_found": _P5,
    "p6_keys": _P6 + "select field, cast(type as integer) as type, cast(key_id as bigint) as key_id, n_posts, first_sec, last_sec, in_topics from k",
    "p6_found": _P6 + "select field, cast(type as integer) as type, cast(key_id as bigint) as key_id from k where field <> 'all' and n_posts * 40 >= (select n_posts from k where field = 'all')",
    "p6_pairs": f"""
select t.uid as author, count(*) as n_pairs, cast(sum(p.sec) as bigint) as sum_sec, min(p.sec) as first_sec, max(p.sec) as last_sec
from (select type, mid, {_SEC} as sec from ba_post) p join ba_topic t on p.type = t.type and p.mid = t.id group by t.uid""",
}

"""The forum's relational model, read from an archive root, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.schema import second
from forumlake.session import table

#: The moment "now" of rolling windows, unless a caller gives another: 2025-06-24 00:00 of the forum's day.
AS_OF = 1_750_694_400


def users(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ba_user").groupBy("id").agg(F.max("username").alias("username"), F.max("nickname").alias("nickname"))


def spaces(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ba_space_naming_mapping").groupBy("type", "sid").agg(F.min("name").alias("name"), F.min("display_name").alias("display_name"))


def topics(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "ba_topic").withColumn("dateline", second(F.col("dateline")))
    return t.groupBy("type", "id").agg(*[F.max(c).alias(c) for c in ("uid", "sid", "dateline", "state", "top_post_pid", "last_post_pid", "title")])


def posts(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "ba_post").withColumn("dateline", second(F.col("dateline")))
    return p.groupBy("type", "id", "mid").agg(*[F.max(c).alias(c) for c in ("uid", "dateline", "state", "sid")])


def likes_given(spark: SparkSession, root: str) -> DataFrame:
    """Reactions by user, built from the event stream: each event is a reaction to a post of a topic."""
    e = table(spark, root, "events").select("event_id", "event_type", (F.lit(5002) + F.col("user_id") * 3).alias("liker"), (F.lit(1000) + F.col("event_id") % 3000).cast("int").alias("tid"))
    t = topics(spark, root).select("type", F.col("id").alias("tid"), "top_post_pid", "last_post_pid")
    face = F.when(F.col("event_type") == "view", 79).when(F.col("event_type") == "purchase", 140).when(F.col("event_type") == "signup", 54).otherwise(0)
    r = e.join(t, "tid").select(
        "type", F.col("tid").alias("mid"), F.when(F.col("event_id") % 2 == 0, F.col("last_post_pid")).otherwise(F.col("top_post_pid")).alias("pid"), face.alias("value"),
        F.col("liker").alias("uid"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("total"),
    )
    return r.where("pid is not null").groupBy("type", "mid", "pid", "value", "uid").agg(F.max("total").alias("total"))


def likes_received(spark: SparkSession, root: str) -> DataFrame:
    return likes_given(spark, root).groupBy("type", "mid", "pid", "value").agg(F.sum("total").alias("total"))


_S = "nullif(case when dateline > 100000000000 then dateline // 1000 else dateline end, 0)"
#: The same model for DuckDB, as the beginning of a query.
SQL = f"""
with u as (select id, max(username) as username, max(nickname) as nickname from ba_user group by id),
s as (select type, sid, min(name) as name, min(display_name) as display_name from ba_space_naming_mapping group by type, sid),
t as (select type, id, max(uid) as uid, max(sid) as sid, max({_S}) as dateline, max(state) as state, max(top_post_pid) as top_post_pid,
             max(last_post_pid) as last_post_pid, max(title) as title from ba_topic group by type, id),
p as (select type, id, mid, max(uid) as uid, max({_S}) as dateline, max(state) as state, max(sid) as sid from ba_post group by type, id, mid),
lr0 as (
  select t.type, t.id as mid, case when e.event_id % 2 = 0 then t.last_post_pid else t.top_post_pid end as pid,
         case e.event_type when 'view' then 79 when 'purchase' then 140 when 'signup' then 54 else 0 end as value, 5002 + e.user_id * 3 as uid,
         case when e.event_type = 'error' then 0 else 1 end as total
  from events e join t on t.id = 1000 + e.event_id % 3000),
lr as (select type, mid, pid, value, uid, max(total) as total from lr0 where pid is not null group by type, mid, pid, value, uid),
lk as (select type, mid, pid, value, cast(sum(total) as bigint) as total from lr group by type, mid, pid, value)
"""

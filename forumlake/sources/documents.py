"""Topic documents: nested JSON read into a fixed schema and flattened into the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.functions.scalars import is_real_author, string_hash
from forumlake.schema import SPACE_TYPES

_USER = "struct<id: int, username: string, nickname: string, sign: string>"
_POST = f"id: int, user: {_USER}, floorNum: int, subFloorNum: int, mid: int, related: int, contentHtml: string, contentBbcode: string, state: bigint, dateline: bigint"
#: Two levels of posts: floors and their sub-floors. ``meta`` is a variant, as it holds maps or lists.
TOPIC_SCHEMA = (
    "id int, uid int, title string, dateline bigint, display boolean, topPostPid int, state bigint, "
    "space struct<type: string, name: string, displayName: string, tags: array<string>, relatedSubjectIds: array<int>, meta: variant>, "
    f"postList array<struct<{_POST}, subFloorList: array<struct<{_POST}>>>>"
)


def read_topics(texts: DataFrame, body: str = "body") -> DataFrame:
    """topic (struct, null where the text is no topic document) beside the other columns.

    Each text is parsed once: what a generator yields is not replaced by its expression in later filters and projections.
    """
    rest = [c for c in texts.columns if c != "topic"]
    read = texts.select(*rest, F.explode(F.array(F.from_json(F.col(body), TOPIC_SCHEMA, {"mode": "PERMISSIVE"}))).alias("__fl_t"))
    ok = F.col("__fl_t.id").isNotNull() & F.col("__fl_t.postList").isNotNull()
    return read.select(*rest, F.when(ok, F.col("__fl_t")).alias("topic"))


def write_topics(topics: DataFrame, path: str) -> None:
    """Documents as JSON text, partitioned by space type."""
    topics.select(F.lower("topic.space.type").alias("space_type"), F.to_json("topic").alias("value")).write.mode("append").partitionBy("space_type").text(path)


def dead_letters(read: DataFrame, body: str = "body") -> DataFrame:
    """Rows whose text didn't parse: the ones to look at again."""
    return read.where(F.col(body).isNotNull() & (F.trim(body) != "") & F.col("topic").isNull())


def space_type_id(name: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in SPACE_TYPES.items() for x in kv])
    return F.try_element_at(types, F.lower(name))


def sid_of(topic: Column) -> Column:
    """A topic's space: the hash of the space's name; for a blog its author's id; null without posts or name."""
    empty = topic["postList"].isNull() | (F.size(topic["postList"]) == 0)
    return F.when(~empty, F.when(F.lower(topic["space"]["type"]) == "blog", topic["uid"]).otherwise(string_hash(topic["space"]["name"])))


def all_posts(topics: DataFrame, *keep: str) -> DataFrame:
    """One row per post: each floor, then its sub-floors. type, topic_id and the post's fields; floor_of is its floor's id.

    keep: further columns to keep; then also the post's place, n (floor) and m (0, or sub-floor).
    """
    p = topics.where("topic is not null").select(*keep, space_type_id(F.col("topic.space.type")).alias("type"), F.col("topic.id").alias("topic_id"), F.posexplode("topic.postList").alias("n", "p"))
    own = [x.split(":")[0].strip() for x in _POST.replace(_USER, "x").split(",")]
    bare = lambda c: F.struct(*[c[f].alias(f) for f in own])
    both = F.concat(F.array(bare(F.col("p"))), F.coalesce(F.transform(F.col("p.subFloorList"), bare), F.array().cast(f"array<struct<{_POST}>>")))
    rows = p.select(*keep, "type", "topic_id", "n", F.col("p.id").alias("floor_of"), F.posexplode(both).alias("m", "q"))
    return rows.select(*keep, *(["n", "m"] if keep else []), "type", "topic_id", "floor_of", F.col("q.*"))


def post_rows(topics: DataFrame) -> DataFrame:
    """Posts for the table: without the pseudo writer, with a uid for everyone (0 without a user, a hash for an unknown one)."""
    q = all_posts(topics).where(is_real_author(F.col("user.id"), F.col("user.username")))
    uid = F.when(F.col("user").isNull(), 0).otherwise(F.coalesce("user.id", string_hash("user.username")))
    return q.select("type", "id", "mid", uid.cast("bigint").alias("uid"), "dateline", F.col("state").cast("int").alias("state"))


def topic_rows(topics: DataFrame) -> DataFrame:
    """Topics for the table: the author falls back to the top post's, the last post is the greatest id."""
    t = F.col("topic")
    top = F.try_element_at(F.filter(t["postList"], lambda p: p["id"] == t["topPostPid"]), F.lit(1))["user"]
    uid = F.coalesce(t["uid"], top["id"], string_hash(top["username"])).cast("bigint")
    ids = F.flatten(F.transform(t["postList"], lambda p: F.concat(F.array(p["id"]), F.coalesce(F.transform(p["subFloorList"], lambda s: s["id"]), F.array().cast("array<int>")))))
    return topics.where("topic is not null").select(
        space_type_id(t["space"]["type"]).alias("type"), t["id"].alias("id"), uid.alias("uid"), sid_of(t).cast("bigint").alias("sid"), t["dateline"].alias("dateline"),
        t["state"].cast("int").alias("state"), t["topPostPid"].cast("bigint").alias("top_post_pid"), F.array_max(ids).cast("bigint").alias("last_post_pid"), t["title"].alias("title"),
    )


def topic_state(topics: DataFrame) -> DataFrame:
    """type, id, state: the OR of silent, closed and reopened over a topic's posts."""
    mask = 2 | 4 | 8
    return all_posts(topics).groupBy("type", F.col("topic_id").alias("id")).agg(F.bit_or(F.coalesce("state", F.lit(0)).bitwiseAND(mask)).alias("state"))


def user_rows(topics: DataFrame) -> DataFrame:
    """Distinct users of all posts."""
    return all_posts(topics).where("user is not null").select(F.col("user.id").alias("id"), F.col("user.username").alias("username"), F.col("user.nickname").alias("nickname")).distinct()


def naming_rows(topics: DataFrame) -> DataFrame:
    """Names of spaces: of a blog its author's, of others only if both are known."""
    t = F.col("topic")
    top = F.try_element_at(F.filter(t["postList"], lambda p: p["id"] == t["topPostPid"]), F.lit(1))["user"]
    blog = F.lower(t["space"]["type"]) == "blog"
    r = topics.where("topic is not null").select(
        space_type_id(t["space"]["type"]).alias("type"), F.explode(F.array(F.coalesce(sid_of(t), F.when(blog, top["id"])).cast("bigint"))).alias("sid"),
        F.when(blog, top["username"]).otherwise(t["space"]["name"]).alias("name"), F.when(blog, F.coalesce(top["nickname"], F.lit(""))).otherwise(t["space"]["displayName"]).alias("display_name"),
    )
    return r.where("sid is not null and name is not null and display_name is not null").distinct()


def blog_tags(topics: DataFrame) -> DataFrame:
    return topics.where("lower(topic.space.type) = 'blog'").select(F.col("topic.id").alias("blog_topic_id"), F.explode("topic.space.tags").alias("tag")).distinct()


def blog_subjects(topics: DataFrame) -> DataFrame:
    return topics.where("lower(topic.space.type) = 'blog'").select(F.col("topic.id").alias("blog_topic_id"), F.explode("topic.space.relatedSubjectIds").alias("subject_id")).distinct()


def _reactions(topics: DataFrame, view: str) -> DataFrame:
    """One row per entry of meta.data_likes_list, whether a post's entries are a map or a list."""
    t = topics.where("topic is not null").select(space_type_id(F.col("topic.space.type")).alias("type"), F.col("topic.id").alias("id"), F.expr("try_variant_get(topic.space.meta, '$.data_likes_list', 'variant')").alias("l"))
    t.createOrReplaceTempView(view)
    return t.sparkSession.sql(f"""
        select type, id, a.key as post, e.value as entry, try_variant_get(e.value, '$.main_id', 'int') as main_id, try_variant_get(e.value, '$.value', 'int') as face, try_variant_get(e.value, '$.total', 'int') as total
        from {view}, lateral variant_explode(l) a, lateral variant_explode(a.value) e""")


def like_rows(topics: DataFrame, view: str = "__fl_likes") -> DataFrame:
    """type, mid, pid, value, total. A blog's own entry belongs to its top post, -id; an entry that can't be read voids its topic's reactions."""
    r = _reactions(topics, view).withColumn("pid", F.expr("try_cast(post as int)"))
    bad = r.where("pid is null or main_id is null or face is null").select("type", "id").distinct()
    own = (F.col("type") == SPACE_TYPES["blog"]) & (F.col("pid") == F.col("id"))
    good = r.join(bad, ["type", "id"], "left_anti")
    return good.select("type", F.when(own, F.col("id")).otherwise(F.col("main_id")).alias("mid"), F.when(own, -F.col("id")).otherwise(F.col("pid")).alias("pid"), F.col("face").alias("value"), F.coalesce("total", F.lit(0)).alias("total"))


def like_given_rows(topics: DataFrame, view: str = "__fl_given") -> DataFrame:
    """type, mid, pid, value, username of each user of each entry; entries without users give none."""
    r = _reactions(topics, view).withColumn("pid", F.expr("try_cast(post as int)")).where("pid is not null and main_id is not null and face is not null")
    own = (F.col("type") == SPACE_TYPES["blog"]) & (F.col("pid") == F.col("id"))
    users = F.expr("try_variant_get(entry, '$.users', 'array<struct<username: string>>')")
    each = r.select("type", F.when(own, F.col("id")).otherwise(F.col("main_id")).alias("mid"), F.when(own, -F.col("id")).otherwise(F.col("pid")).alias("pid"), F.col("face").alias("value"), F.explode(users).alias("u"))
    return each.where("u.username is not null").select("type", "mid", "pid", "value", F.col("u.username").alias("username"))

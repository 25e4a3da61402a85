"""Rankings of recent activity: ranks per user and topic, and the latest few of each user.

Top-k filters stand right on the window, so Spark cuts groups before and after the shuffle
(WindowGroupLimit). Ties of rank() keep all their rows, row_number() breaks them by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlake.schema import DAY

YEARS3 = 3 * 365 * DAY


def _latest(*group: str, by: tuple[str, ...] = ("dateline", "id")):
    return Window.partitionBy(*group).orderBy(*[F.col(c).desc_nulls_last() for c in by])


def _names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("uid"), "username")


def rank_replies(posts: DataFrame, topics: DataFrame, users: DataFrame) -> DataFrame:
    """Every post with its topic's title, its author's name and its rank among the author's in the topic."""
    t = topics.select("type", F.col("id").alias("mid"), "title")
    rows = posts.join(t, ["type", "mid"]).join(_names(users), "uid")
    return rows.withColumn("rank_reply_asc", F.rank().over(_latest("type", "mid", "uid")).cast("bigint"))


def topics_with_last_post(topics: DataFrame, posts: DataFrame) -> DataFrame:
    last = posts.select("type", F.col("id").cast("bigint").alias("last_post_pid"), F.col("dateline").alias("last_update_time"))
    return topics.join(last, ["type", "last_post_pid"])


def rank_topics(topics: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """Topics with the time of their last post and their rank among their author's by it."""
    w = _latest("type", "uid", by=("last_update_time", "last_post_pid"))
    rows = topics_with_last_post(topics, posts).join(_names(users), "uid")
    rank = F.rank().over(w).cast("bigint")
    return rows.withColumn("rank_last_reply", rank).withColumn("rank_dateline", rank)


def recent_topics(topics: DataFrame, posts: DataFrame, users: DataFrame, spaces: DataFrame, as_of: int, top: int = 10) -> DataFrame:
    """The `top` ranks of each author's living topics of three years, by last post."""
    alive = topics.where((F.col("state") != 1) & (F.col("dateline") >= as_of - YEARS3))
    w = _latest("type", "uid", by=("last_update_time", "last_post_pid"))
    rows = topics_with_last_post(alive, posts).join(_names(users), "uid")
    rows = rows.withColumn("rank_last_reply", F.rank().over(w)).where(F.col("rank_last_reply") <= top)
    return rows.join(spaces.select("type", "sid", F.col("display_name").alias("space_display_name")), ["type", "sid"], "left").withColumn("rank_last_reply", F.col("rank_last_reply").cast("bigint"))


def recent_replies(posts: DataFrame, topics: DataFrame, users: DataFrame, spaces: DataFrame, as_of: int, top: int = 10) -> DataFrame:
    """Each user's latest reply in each of the `top` topics replied to last, within three years and one type.

    A topic's own first post is no reply; where that isn't known (null) the topic has no replies.
    """
    t = topics.select("type", F.col("id").alias("mid"), "title", F.col("state").alias("topic_state"), F.col("sid").alias("topic_sid"), "top_post_pid")
    rows = posts.where(F.col("dateline") >= as_of - YEARS3).join(t, ["type", "mid"]).where(F.col("top_post_pid") != F.col("id"))
    rows = rows.join(_names(users), "uid")
    one = rows.withColumn("n", F.row_number().over(_latest("type", "uid", "mid"))).where("n = 1")
    few = one.withColumn("n", F.row_number().over(_latest("type", "uid"))).where(F.col("n") <= top)
    s = spaces.select("type", F.col("sid").alias("topic_sid"), F.col("display_name").alias("space_display_name"))
    return few.join(s, ["type", "topic_sid"], "left").select("type", "id", "mid", "uid", "dateline", "state", "sid", "title", "username", "topic_state", "space_display_name")


def reply_briefs(replies: DataFrame, top: int = 10) -> DataFrame:
    """What of `recent_replies` is shown of a username: titled, normal, in living topics; so there may be fewer than `top`."""
    shown = replies.where(F.col("title").isNotNull() & (F.col("state").bitwiseAND(1) == 0) & (F.col("topic_state").bitwiseAND(1) == 0))
    return shown.withColumn("n", F.row_number().over(_latest("type", "username"))).where(F.col("n") <= top).select("type", "username", "title", "mid", F.col("id").alias("pid"), "dateline", "space_display_name")


def recent_likes_given(given: DataFrame, posts: DataFrame, topics: DataFrame, users: DataFrame, spaces: DataFrame, as_of: int, top: int = 5) -> DataFrame:
    """The `top` ranks of posts that a user reacted to in each topic; several faces on a post share a rank.

    The three years are counted after the ranks, so a topic's older reactions leave gaps, not room.
    """
    p = posts.where((F.col("state") != 1) & (F.col("state") != 16)).select("type", "mid", F.col("id").cast("bigint").alias("pid"), "dateline")
    t = topics.where("state <> 1").select("type", F.col("id").alias("mid"), "title", "sid")
    rows = given.where("total <> 0").join(p, ["type", "mid", "pid"]).join(t, ["type", "mid"]).join(_names(users), "uid")
    rows = rows.withColumn("rank_like_rev_asc", F.rank().over(_latest("type", "mid", "uid", by=("dateline", "pid")))).where(F.col("rank_like_rev_asc") <= top)
    rows = rows.where(F.col("dateline") >= as_of - YEARS3).join(spaces.select("type", "sid", F.col("display_name").alias("space_display_name")), ["type", "sid"], "left")
    return rows.select("type", "mid", "pid", "username", F.col("value").alias("face_key"), "title", "dateline", "space_display_name", F.col("rank_like_rev_asc").cast("bigint").alias("rank_like_rev_asc"))


def like_briefs(likes: DataFrame, top: int = 10) -> DataFrame:
    """Of `recent_likes_given`: each user's `top` topics by latest post, with (pid, face) pairs by pid."""
    by = likes.groupBy("type", "username", "mid").agg(
        F.max("title").alias("title"), F.max("dateline").alias("dateline"), F.max("space_display_name").alias("space_display_name"),
        F.sort_array(F.collect_list(F.struct("pid", "face_key")), asc=False).alias("pairs"),
    )  # at most five ranks per user and topic
    w = Window.partitionBy("type", "username").orderBy(F.col("dateline").desc_nulls_last(), "mid")
    return by.where("title is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).drop("n")

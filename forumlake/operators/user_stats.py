"""Per-user statistics folded into one result: what the forum's user pages show.

Two scans (posts, topics) with conditional counts take the place of a dozen separate counts;
reactions add two more. Joins meet per-user rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlake.operators import counts, likes, ranks


def flat_stat(posts: DataFrame, topics: DataFrame, users: DataFrame, as_of: int) -> DataFrame:
    """type, username and all post and topic counts; null on the side that a user has nothing of."""

    def side(items: DataFrame, flags: dict[str, str], prefix: str) -> DataFrame:
        names = ["total", "r7d", "r30d", *flags]
        stat = counts.activity_stat(items, users, flags, as_of).groupBy("type", "username")
        return stat.agg(*[F.sum(n).cast("bigint").alias(f"{prefix}_{n}") for n in names])

    return side(posts, counts.POST_FLAGS, "post").join(side(topics, counts.TOPIC_FLAGS, "topic"), ["type", "username"], "full")


def space_stat(posts: DataFrame, topics: DataFrame, given: DataFrame, users: DataFrame, spaces: DataFrame, top: int = 5) -> DataFrame:
    """Each user's top spaces by posts plus reactions given, among those with a post or topic of the user; ties by name.

    Spaces of equal name are one.
    """
    keys = ["type", "username", "name"]

    def per(items: DataFrame, alias: str) -> DataFrame:
        n = items.groupBy("type", "uid", "sid").agg(F.count("*").alias("n"))
        named = n.join(users.select(F.col("id").alias("uid"), "username"), "uid").join(spaces, ["type", "sid"])
        return named.groupBy(*keys).agg(F.sum("n").cast("bigint").alias(alias))

    g = likes.given_by_space(given, topics, users, spaces).groupBy("type", "username", F.col("space_name").alias("name")).agg(F.sum("cnt").cast("bigint").alias("given"))
    every = per(posts, "post_total").join(per(topics, "topic_total"), keys, "full").join(g, keys, "left")
    every = every.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("post_total", "topic_total", "given")])
    w = Window.partitionBy("type", "username").orderBy((F.col("post_total") + F.col("given")).desc(), "name")
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).drop("n")


def space_stat_full(posts: DataFrame, topics: DataFrame, received: DataFrame, given: DataFrame, users: DataFrame, spaces: DataFrame, as_of: int) -> DataFrame:
    """type, username, name of a space, and all counts of the user's posts and topics there, reactions given and received.

    Counts are made per uid and space id before names are met; spaces of equal name are one. Null on
    the side that the user has nothing of.
    """
    keys = ["type", "username", "name"]

    def side(items: DataFrame, flags: dict[str, str], prefix: str) -> DataFrame:
        names = ["total", "r7d", "r30d", *flags]
        stat = counts.activity_stat(items, users, flags, as_of, ["sid"]).join(spaces.select("type", "sid", "name"), ["type", "sid"]).groupBy(*keys)
        return stat.agg(*[F.sum(n).cast("bigint").alias(f"{prefix}_{n}") for n in names])

    def likes_of(df: DataFrame, alias: str) -> DataFrame:
        return df.groupBy("type", "username", F.col("space_name").alias("name")).agg(F.sum("cnt").cast("bigint").alias(alias))

    every = side(posts, counts.POST_FLAGS, "post").join(side(topics, counts.TOPIC_FLAGS, "topic"), keys, "full")
    every = every.join(likes_of(likes.given_by_space(given, topics, users, spaces), "likes_given"), keys, "full")
    return every.join(likes_of(likes.received_by_space(received, topics, posts, users, spaces), "likes_received"), keys, "full")


def user_stats(posts: DataFrame, topics: DataFrame, received: DataFrame, given: DataFrame, users: DataFrame, spaces: DataFrame, as_of: int, usernames: DataFrame | None = None) -> DataFrame:
    """One row per type and username with nested statistics: counts, faces, spaces, recent replies, topics and reactions.

    usernames: a table of those wanted, at most 200 of which (by name) are taken, as in a request;
    None takes all users. Wanted users are cut out first, so all scans are semi-joined.
    """
    u = users if usernames is None else users.join(usernames.select("username").distinct().orderBy("username").limit(200), "username", "left_semi")
    keys = ["type", "username"]
    base = flat_stat(posts, topics, u, as_of)

    def listed(df: DataFrame, alias: str, order: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        cols = [*order, *[c for c in rest if c not in order]]
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=False).alias(alias))  # all of these are top-k or per face

    faces = lambda df, alias: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("face_key", "cnt"))).alias(alias))
    recent = ranks.recent_topics(topics, posts, u, spaces, as_of).where("title is not null").select(*keys, "last_update_time", "id", "title", "dateline", "space_display_name")
    # a username may have two ids, each with topics of its own
    recent = recent.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("last_update_time").desc_nulls_last(), F.col("id").desc())))
    parts = [
        faces(likes.received_by_face(received, topics, posts, u), "likes_received"), faces(likes.given_by_face(given, topics, posts, u), "likes_given"),
        listed(space_stat(posts, topics, given, u, spaces), "spaces", ["post_total"]),
        listed(ranks.reply_briefs(ranks.recent_replies(posts, topics, u, spaces, as_of)), "replies", ["dateline"]),
        listed(recent.where("n <= 10").drop("n"), "topics", ["last_update_time"]),
        listed(ranks.like_briefs(ranks.recent_likes_given(given, posts, topics, u, spaces, as_of)), "likes", ["dateline"]),
    ]
    for p in parts:
        base = base.join(p, keys, "left")
    return base

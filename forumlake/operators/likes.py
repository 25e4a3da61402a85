"""Reactions given and received, per face and per space.

State filters test equality with DELETED, not its bit: a topic in state 17 passes. A null
state doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _alive(topics: DataFrame) -> DataFrame:
    return topics.where("state <> 1").select("type", F.col("id").alias("mid"), "sid")


def _names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("uid"), "username")


def _post_authors(posts: DataFrame, alive: bool = True) -> DataFrame:
    p = posts.where("state <> 1") if alive else posts
    return p.select("type", F.col("id").cast("bigint").alias("pid"), "uid", F.col("mid").alias("post_mid"))


def _positive(grouped: DataFrame, keys: list[str]) -> DataFrame:
    return grouped.groupBy(*keys).agg(F.sum("total").cast("bigint").alias("cnt")).where("cnt > 0")


def received_by_face(likes: DataFrame, topics: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """type, face_key, username, cnt of reactions to a user's posts; a post is found by (type, id) alone."""
    r = likes.join(_alive(topics), ["type", "mid"], "left_semi").join(_post_authors(posts), ["type", "pid"])
    per = r.groupBy("type", F.col("value").alias("face_key"), "uid").agg(F.sum("total").alias("total"))
    return _positive(per.join(_names(users), "uid"), ["type", "face_key", "username"])


def given_by_face(given: DataFrame, topics: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """type, face_key, username, cnt of reactions by a user to living posts of living topics."""
    r = given.join(_alive(topics), ["type", "mid"], "left_semi").join(_post_authors(posts).select("type", "pid"), ["type", "pid"])
    per = r.groupBy("type", F.col("value").alias("face_key"), "uid").agg(F.sum("total").alias("total"))
    return _positive(per.join(_names(users), "uid"), ["type", "face_key", "username"])


def _by_space(per: DataFrame, users: DataFrame, spaces: DataFrame) -> DataFrame:
    named = per.join(_names(users), "uid").join(spaces, ["type", "sid"])
    by = named.groupBy("type", "username", "sid").agg(F.sum("total").cast("bigint").alias("cnt"), F.max("name").alias("space_name"), F.max("display_name").alias("space_display_name"))
    return by.where("cnt > 0")


def given_by_space(given: DataFrame, topics: DataFrame, users: DataFrame, spaces: DataFrame) -> DataFrame:
    """type, username, sid, cnt and the space's names, of reactions by a user in living topics."""
    per = given.join(_alive(topics), ["type", "mid"]).groupBy("type", "uid", "sid").agg(F.sum("total").alias("total"))
    return _by_space(per, users, spaces)


def received_by_space(likes: DataFrame, topics: DataFrame, posts: DataFrame, users: DataFrame, spaces: DataFrame, alive: bool = True, by: str = "sid") -> DataFrame:
    """As `given_by_space`, of reactions to a user's posts, found by their full key.

    alive=False drops the state filters and by='name' groups by the space's name, which is the
    other database dialect's reading of the same question.
    """
    t = _alive(topics) if alive else topics.select("type", F.col("id").alias("mid"), "sid")
    r = likes.join(t, ["type", "mid"]).join(_post_authors(posts, alive).withColumnRenamed("post_mid", "mid"), ["type", "pid", "mid"])
    per = r.groupBy("type", "uid", "sid").agg(F.sum("total").alias("total"))
    if by == "sid":
        return _by_space(per, users, spaces)
    return _positive(per.join(_names(users), "uid").join(spaces, ["type", "sid"]).withColumnRenamed("name", "space_name"), ["type", "username", "space_name"])


def sum_by_face(likes: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """type, face_key, uid, username, cnt of all reactions to a user's posts, in any state."""
    r = likes.join(_post_authors(posts, alive=False), ["type", "pid"])
    per = r.groupBy("type", F.col("value").alias("face_key"), "uid").agg(F.sum("total").alias("total"))
    return _positive(per.join(_names(users), "uid"), ["type", "face_key", "uid", "username"])

"""Weighted scores of user pairs who write in the same topics.

Posts of a user in a topic (and in a floor of it) are counted first, and pairs are formed of
users with their counts: a pair of posts is never formed, their number is a product. Each of the
two joins forms a pair of users once, whatever the kinds of their posts. A topic (or floor) of many
users is cut into blocks of users, and each pair of blocks is a group of its own, so it is spread
over as many tasks as its pairs deserve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights by how two posts stand to each other.
W_FLOOR_TO_POST, W_SUB_TO_POST, W_SUB_TO_FLOOR, W_FLOORS, W_SUBS_SAME, W_SUB_TO_OTHER, W_SUBS_OTHER = 0.6, 0.4, 0.8, 0.2, 0.6, 0.2, 0.1


#: Users of a topic in one block, on average.
BLOCK_USERS = 1_000


def _pairs(counts: DataFrame, on: list[str], score: Column) -> DataFrame:
    """u, v (u > v), s of users with counts (on, username, n of main floors, m of sub-floors) in the same group."""
    sizes = counts.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK_USERS).cast("int").alias("blocks"))
    x = counts.join(sizes, on).withColumn("b", F.pmod(F.xxhash64("username"), F.col("blocks")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o"))
    left = x.select(*on, "lo", "hi", F.col("username").alias("u"), "n", "m", F.col("b").alias("bu"))
    right = x.select(*on, "lo", "hi", F.col("username").alias("v"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("b").alias("bv"))
    both = left.join(right, [*on, "lo", "hi"]).where("u > v and least(bu, bv) = lo and greatest(bu, bv) = hi")
    return both.select("u", "v", score.alias("s")).where("s <> 0")


def relatedness(floors: DataFrame, since: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """a, b, score of unordered pairs of different usernames (a > b).

    floors: topic, floor, sub (null for a main floor), username; the first main floor is the
    topic's post. Relations between floors, between sub-floors, and between these and other
    floors are seen from both sides, so they count twice where both posts are of a kind.
    since: only posts with a dateline (another column) from then on; hidden: topics (topic) left out.
    """
    f = floors.where("username is not null")
    if since is not None:
        f = f.where(F.col("dateline") >= since)
    if hidden is not None:
        f = f.join(hidden.select("topic"), "topic", "left_anti")
    both = [F.count_if(F.col("sub").isNull()).alias("n"), F.count_if(F.col("sub").isNotNull()).alias("m")]
    by_floor = f.groupBy("topic", "floor", "username").agg(*both)
    by_topic = by_floor.groupBy("topic", "username").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    top = f.where("sub is null").groupBy("topic").agg(F.min_by("username", "floor").alias("top"))
    n, m, n2, m2 = (F.col(c) for c in ("n", "m", "n2", "m2"))
    crossed = n * m2 + n2 * m
    anywhere = 2 * W_FLOORS * n * n2 + W_SUB_TO_OTHER * crossed + 2 * W_SUBS_OTHER * m * m2
    same_floor = (W_SUB_TO_FLOOR - W_SUB_TO_OTHER) * crossed + 2 * (W_SUBS_SAME - W_SUBS_OTHER) * m * m2
    to_top = by_topic.join(top, "topic").where("username <> top").select(
        F.greatest("username", "top").alias("u"), F.least("username", "top").alias("v"), (W_FLOOR_TO_POST * n + W_SUB_TO_POST * m).alias("s")
    )
    every = to_top.unionByName(_pairs(by_topic, ["topic"], anywhere)).unionByName(_pairs(by_floor.where("floor is not null"), ["topic", "floor"], same_floor))
    return every.groupBy(F.col("u").alias("a"), F.col("v").alias("b")).agg(F.round(F.sum("s"), 6).alias("score")).where("score <> 0")

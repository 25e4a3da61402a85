"""Upserts without MERGE: all versions of a row, numbered, folded by one aggregate per key.

Each column has its own rule, as the forum's tables ask for. The fold is associative in the
version numbers and runs with partial aggregation, so a key with many versions, or a batch
with many rows of a key, costs one state per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, LAST, LAST_KNOWN = "first", "last", "last_known"


def rule(column: str, how: str, seq: str) -> Column:
    """first / last: the value of the first or last version, null or not; last_known: of the last that isn't null."""
    if how == FIRST:
        return F.min_by(column, seq)
    if how == LAST:
        return F.max_by(column, seq)
    if how == LAST_KNOWN:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(seq)))
    raise ValueError(how)


def fold(versions: DataFrame, keys: Sequence[str], seq: str, rules: Mapping[str, str]) -> DataFrame:
    """One row per key with each column by its rule. Version numbers are distinct within a key."""
    return versions.groupBy(*keys).agg(*[rule(c, how, seq).alias(c) for c, how in rules.items()], F.count("*").alias("__fl_versions"))


USER_RULES = {"username": LAST, "nickname": LAST_KNOWN}
TOPIC_RULES = {"uid": LAST_KNOWN, "sid": LAST_KNOWN, "dateline": LAST_KNOWN, "state": LAST, "top_post_pid": LAST_KNOWN, "last_post_pid": LAST_KNOWN, "title": LAST_KNOWN}
POST_RULES = {"uid": FIRST, "dateline": FIRST, "state": LAST, "sid": LAST}
NAMING_RULES = {"name": FIRST, "display_name": LAST}


def upsert_users(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """The last username; the last nickname that isn't null."""
    return fold(versions, ["id"], seq, USER_RULES).drop("__fl_versions")


def upsert_topics(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """The last state, null or not; of the others the last known. An unknown last post becomes -1 on the second version."""
    f = fold(versions, ["type", "id"], seq, TOPIC_RULES)
    last = F.coalesce("last_post_pid", F.when(F.col("__fl_versions") > 1, F.lit(-1)))
    return f.withColumn("last_post_pid", last.cast("bigint")).drop("__fl_versions")


def upsert_posts(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """The first uid and dateline, even if null; the last state and sid, where an unknown sid is 0."""
    return fold(versions.withColumn("sid", F.coalesce("sid", F.lit(0))), ["type", "id", "mid"], seq, POST_RULES).drop("__fl_versions")


def fold_post_states(states: DataFrame) -> DataFrame:
    """One state per post, by the rules of `upsert_posts`, whatever the order in which states are folded.

    Of rows with the same delivery number the greatest value of each column stands. An unknown sid
    stays null here, as a row of the same delivery may still bring it; readers see 0.
    """

    def at(seq: str, order: Column, c: str) -> Column:
        return F.max(F.when(F.col(seq).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c)

    first = [at("first_seq", F.bitwise_not("first_seq"), c) for c, how in POST_RULES.items() if how == FIRST]
    last = [at("last_seq", F.col("last_seq"), c) for c, how in POST_RULES.items() if how == LAST]
    return states.groupBy("type", "id", "mid").agg(*first, *last, F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def upsert_naming(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """The first name, the last display name."""
    return fold(versions, ["type", "sid"], seq, NAMING_RULES).drop("__fl_versions")


def upsert_totals(versions: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Totals (of reactions), or values by key: the last version stands."""
    value = next(c for c in versions.columns if c not in (*keys, seq))
    return fold(versions, keys, seq, {value: LAST}).drop("__fl_versions")


def insert_new(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bridges: a key that exists is left alone."""
    return rows.dropDuplicates(list(keys))


def like_tombstones(stored: DataFrame, snapshot: DataFrame, seen: DataFrame, keys: Sequence[str] = ("type", "mid", "pid", "value")) -> DataFrame:
    """Stored totals after a snapshot: its rows overwrite, what it no longer has goes to 0, in the topics it saw.

    seen: (type, mid) of topics that came with content; reactions of other topics don't change.
    """
    keys = list(keys)
    gone = stored.join(seen.select("type", "mid").distinct(), ["type", "mid"], "left_semi").join(snapshot.select(*keys), keys, "left_anti")
    zero = gone.withColumn("total", F.lit(0).cast("bigint"))
    kept = stored.join(snapshot.select(*keys), keys, "left_anti").join(gone.select(*keys), keys, "left_anti")
    cols = [*keys, "total"]
    return snapshot.select(*cols).unionByName(zero.select(*cols)).unionByName(kept.select(*cols))


def blog_post_tombstones(stored: DataFrame, snapshot: DataFrame, blog_type: int = 21) -> DataFrame:
    """Stored blog posts that a topic's snapshot lacks get state 1; the top post (id = -mid) is exempt."""
    seen = snapshot.where(F.col("type") == blog_type).select("type", "mid").distinct()
    gone = stored.where((F.col("type") == blog_type) & (F.col("id") != -F.col("mid"))).join(seen, ["type", "mid"], "left_semi")
    gone = gone.join(snapshot.select("type", "mid", "id"), ["type", "mid", "id"], "left_anti").select("type", "mid", "id", F.lit(1).alias("dead"))
    return stored.join(gone, ["type", "mid", "id"], "left").withColumn("state", F.coalesce("dead", "state")).drop("dead")


def recode_type(rows: DataFrame, old: int = 100, new: int = 21) -> DataFrame:
    return rows.withColumn("type", F.when(F.col("type") == old, new).otherwise(F.col("type")))

"""Counts of posts and topics per user, space and state, over all time and trailing windows.

Rows are counted by uid before they meet users or spaces, so a join carries one row per uid
and state and no user's share of the rows matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.schema import DAY, STATE


def within(days: int | None, as_of: int) -> Column:
    """Whether dateline lies in the last days, counted back from as_of, inclusive and without an upper bound."""
    return F.lit(True) if days is None else F.col("dateline") >= F.lit(as_of - days * DAY)


def activity_count(items: DataFrame, users: DataFrame, as_of: int, days: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Items (posts or topics) per type, uid, username, state and the columns of ``by``."""
    counted = items.where(within(days, as_of)).groupBy("type", "uid", "state", *by).agg(F.count("*").alias("cnt"))
    return counted.join(users.select(F.col("id").alias("uid"), "username"), "uid").select("type", "uid", "username", "state", *by, "cnt")


def space_count(items: DataFrame, users: DataFrame, spaces: DataFrame, as_of: int, days: int | None = None) -> DataFrame:
    """`activity_count` per space, with its names; items of unnamed spaces are left out."""
    return activity_count(items, users, as_of, days, ["sid"]).join(spaces, ["type", "sid"]).select("type", "uid", "name", "display_name", "username", "state", "cnt")


def has(flag: str) -> Column:
    """Whether a state has a flag; a null state has none."""
    bit = STATE[flag]
    return F.coalesce(F.col("state").bitwiseAND(bit) == bit, F.lit(False))


POST_FLAGS = {"deleted": "DELETED", "admin_deleted": "ADMIN_DELETED", "violative": "VIOLATIVE", "collapsed": "COLLAPSED"}
TOPIC_FLAGS = {"deleted": "DELETED", "silent": "SILENT", "closed": "CLOSED", "reopen": "REOPEN"}


def stat_columns(flags: dict[str, str], as_of: int, prefix: str = "") -> list[Column]:
    """Total, last 7 and 30 days, and one count per flag, from one scan."""
    return [
        F.count("*").alias(f"{prefix}total"), F.count_if(within(7, as_of)).alias(f"{prefix}r7d"), F.count_if(within(30, as_of)).alias(f"{prefix}r30d"),
        *[F.count_if(has(f)).alias(f"{prefix}{n}") for n, f in flags.items()],
    ]


def activity_stat(items: DataFrame, users: DataFrame, flags: dict[str, str], as_of: int, by: Sequence[str] = ()) -> DataFrame:
    """The counts of `stat_columns` per type, uid and username: what a dozen separate counts would give."""
    stats = items.groupBy("type", "uid", *by).agg(*stat_columns(flags, as_of))
    return stats.join(users.select(F.col("id").alias("uid"), "username"), "uid")

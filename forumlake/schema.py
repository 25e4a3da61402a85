"""Fixed vocabulary of the forum model and the columns of its tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Space types.
SPACE_TYPES = {
    "group": 8,
    "subject": 10,
    "ep": 11,
    "blog": 21,
    "person": 200,
    "character": 300,
}

# State bits.
STATE = {
    "NORMAL": 0,
    "DELETED": 1,
    "CLOSED": 2,
    "SILENT": 4,
    "REOPEN": 8,
    "ADMIN_DELETED": 16,
    "BLOG_REDIRECT": 32,
    "BLOG_CLUB": 64,
    "VIOLATIVE": 128,
    "COLLAPSED": 256,
}

DAY = 86_400
#: The forum's clock runs eight hours ahead of UTC.
FORUM_OFFSET = 8 * 3_600
#: A dateline above this is in milliseconds.
MILLISECONDS_FROM = 100_000_000_000


def second(dateline: Column) -> Column:
    """Epoch seconds of a dateline; milliseconds are scaled, null and 0 are null."""
    s = F.when(dateline > MILLISECONDS_FROM, F.floor(dateline / F.lit(1000)).cast("bigint")).otherwise(dateline.cast("bigint"))
    return F.when(s != 0, s)


def forum_day(sec: Column) -> Column:
    """Days since 1970-01-01 of the forum's calendar, as an int."""
    return F.floor((sec + F.lit(FORUM_OFFSET)) / F.lit(DAY)).cast("int")


def somebody(uid: Column) -> Column:
    """The uid, or null where it is nobody (null or 0)."""
    return F.when(uid != 0, uid.cast("bigint"))

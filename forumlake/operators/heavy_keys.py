"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are reduced to one compact state per join key (and group column) before they
meet; the join pairs states, not rows, and the states are combined algebraically: counts multiply, a
sum is scaled by the other side's count, minimum and maximum are untouched (`joined_states`). The
roll-up to the wanted keys, one set of them (`eager_join_aggregate`) or several at once
(`key_activity`), runs on joined states. Partial aggregation happens on the map side, so however many
rows a key holds, each task sends one state for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Internal columns; the names can't clash with columns of the inputs' states.
N, S, LO, HI, M = "__fl_n", "__fl_sum", "__fl_min", "__fl_max", "__fl_m"


def compact_states(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One state per key: rows, sum, least and greatest value (nulls are in the count only)."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count("*").alias(N), F.sum(v).alias(S), F.min(v).alias(LO), F.max(v).alias(HI))


def joined_states(left: DataFrame, right: DataFrame, on: Sequence[str], group: Sequence[str], value: str, how: str = "inner") -> DataFrame:
    """States of ``left JOIN right ON on`` per join key and group columns (of left or right), without ever forming the join's rows.

    value is a column of left. Columns on, group, N, S, LO, HI, and M: how many rows of right the key
    has (null if none, with how=left). As in SQL, null join keys match nothing (with how=left they are
    kept), null group keys form a group of their own, and copies on either side count as often as they
    come. Columns beside those named are dropped before the join, so clashing names do no harm.
    """
    if how not in ("inner", "left"):
        raise ValueError("how: inner or left")
    on, group = list(on), list(group)
    lg = [g for g in group if g in left.columns and g not in on]
    rg = [g for g in group if g not in left.columns and g not in on]
    a = compact_states(left, [*on, *lg], value)
    b = right.groupBy(*on, *rg).agg(F.count("*").alias(M))
    both = a.join(b, on, how)
    m = F.coalesce(F.col(M), F.lit(1)) if how == "left" else F.col(M)
    return both.select(*on, *[g for g in group if g not in on], (F.col(N) * m).alias(N), (F.col(S) * m).alias(S), LO, HI, M)


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, on: Sequence[str], group: Sequence[str], value: str, how: str = "inner", aliases: Sequence[str] = ("n", "total", "least", "greatest")
) -> DataFrame:
    """Aggregate ``left JOIN right ON on`` by ``group``: group, then row count, sum, min and max of value over the join under ``aliases``.

    Defined cases: see `joined_states`.
    """
    names = dict(zip((N, S, LO, HI), aliases, strict=True))
    return joined_states(left, right, on, group, value, how).groupBy(*group).agg(
        F.sum(N).cast("bigint").alias(names[N]), F.sum(S).alias(names[S]), F.min(LO).alias(names[LO]), F.max(HI).alias(names[HI])
    )


def key_activity(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Posts, first and last second of every uid and every topic, and of the whole, from one pass.

    posts: (type, id, mid, uid, sec) with copies; topics: (type, id) with copies. Returns field
    ('uid', 'mid' or 'all'), type, key_id, n_posts, first_sec, last_sec, in_topics (of a topic: a row
    of topics exists; else null). Field 'all' is one row with the whole, nobody's posts included, or
    none if there are no posts; a uid that is null or 0 has no row.

    1. Copies of a post are removed by its key (type, id, mid), which no hot uid or topic
       skews. Copies agree in uid and second, so any aggregate picks the same value.
    2. Posts are reduced to states by (type, mid, uid), topics to one by (type, mid); a hot topic is
       many states, one for each of its uids, and a hot uid one for each of its topics.
    3. States are joined, counts multiplied. A topic is one row here however many copies it has, so
       each post counts once; a post whose topic has no row is kept.
    4. Each joined state is rolled up to its uid, its topic and the whole in one aggregation.
    """
    one = posts.groupBy("type", "id", "mid").agg(F.max("uid").alias("uid"), F.max("sec").alias("sec"))
    topic = topics.select("type", F.col("id").alias("mid")).distinct()
    state = joined_states(one, topic, ["type", "mid"], ["uid"], "sec", "left")

    def key(field: str, kind: Column, of: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), kind.cast("int").alias("type"), of.cast("bigint").alias("key_id"))

    keys = F.array(key("uid", F.lit(0), F.col("uid")), key("mid", F.col("type"), F.col("mid")), key("all", F.lit(0), F.lit(0)))
    each = state.select(F.explode(keys).alias("k"), N, LO, HI, F.col(M).isNotNull().alias(M)).where((F.col("k.field") != "uid") | (F.col("k.key_id") != 0))
    rolled = each.groupBy("k.field", "k.type", "k.key_id").agg(
        F.sum(N).cast("bigint").alias("n_posts"), F.min(LO).alias("first_sec"), F.max(HI).alias("last_sec"), F.max(F.when(F.col("k.field") == "mid", F.col(M))).alias("in_topics")
    )
    return rolled.select("field", "type", "key_id", "n_posts", "first_sec", "last_sec", "in_topics")

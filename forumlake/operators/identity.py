"""Identity merge: hashed (negative) ids of users whose real id has become known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_usernames(users: DataFrame) -> DataFrame:
    """All rows of users whose username has two rows or more."""
    n = F.count("*").over(Window.partitionBy("username"))
    return users.where("username is not null").withColumn("__fl_n", n).where("__fl_n >= 2").drop("__fl_n")


def existing_usernames(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted usernames that exist, each once."""
    return wanted.where("username is not null").select("username").distinct().join(users.select("username"), "username", "left_semi")


def identity_pairs(users: DataFrame) -> DataFrame:
    """neg, pos of usernames with exactly one negative and one positive id."""
    g = users.where("username is not null").groupBy("username").agg(F.count("*").alias("n"), F.min("id").alias("neg"), F.max("id").alias("pos"))
    return g.where("n = 2 and neg < 0 and pos > 0").select("neg", "pos")


def repoint(rows: DataFrame, pairs: DataFrame, column: str = "uid") -> DataFrame:
    """Rows with a merged id in ``column`` replaced by its real one; the rest as they are."""
    p = pairs.select(F.col("neg").alias(column), F.col("pos").alias("__fl_pos"))
    return rows.join(p, column, "left").withColumn(column, F.coalesce("__fl_pos", column)).drop("__fl_pos")


def repoint_blog_spaces(topics: DataFrame, pairs: DataFrame, blog_type: int = 21) -> DataFrame:
    """A blog's space is its author's id, so it follows the merge; other spaces don't."""
    p = pairs.select(F.col("neg").alias("sid"), F.col("pos").alias("__fl_pos"))
    new = F.when(F.col("type") == blog_type, F.coalesce("__fl_pos", "sid")).otherwise(F.col("sid"))
    return topics.join(p, "sid", "left").withColumn("sid", new).drop("__fl_pos")


def merge_likes_given(given: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reactions after the merge: a negative row goes if the real user has the same with an equal total,
    moves if the real user has none, and stays if the totals differ."""
    keys = ["type", "mid", "pid", "value"]
    p = pairs.select(F.col("neg").alias("uid"), F.col("pos").alias("__fl_pos"))
    real = given.select(*keys, F.col("uid").alias("__fl_pos"), F.col("total").alias("__fl_total"))
    both = given.join(p, "uid", "left").join(real, [*keys, "__fl_pos"], "left")
    kept = both.where("__fl_pos is null or __fl_total is null or total <> __fl_total")
    uid = F.when(F.col("__fl_pos").isNotNull() & F.col("__fl_total").isNull(), F.col("__fl_pos")).otherwise(F.col("uid"))
    return kept.withColumn("uid", uid).select(*given.columns)


def likes_conflicts(given: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys of reactions that both ids of a pair have, with both totals."""
    keys = ["type", "mid", "pid", "value"]
    a = given.join(pairs, given["uid"] == pairs["pos"]).select(*keys, "neg", "pos", F.col("total").alias("pos_total"))
    b = given.select(*keys, F.col("uid").alias("neg"), F.col("total").alias("neg_total"))
    return a.join(b, [*keys, "neg"])


def merge_users(users: DataFrame, pairs: DataFrame) -> DataFrame:
    """Users without the negative rows that were merged."""
    return users.join(pairs.select(F.col("neg").alias("id")), "id", "left_anti")


def duplicate_blog_names(spaces: DataFrame, blog_type: int = 21) -> DataFrame:
    """type, name of blog spaces that share a name."""
    return spaces.where(F.col("type") == blog_type).groupBy("type", "name").agg(F.count("*").alias("n")).where("n > 1")


def promote_blog_names(spaces: DataFrame, pairs: DataFrame, blog_type: int = 21) -> DataFrame:
    """Blog names of merged authors under their real ids; a real id that has a name keeps it."""
    moved = repoint(spaces.where(F.col("type") == blog_type).withColumn("__fl_old", F.col("sid")), pairs, "sid")
    own = F.row_number().over(Window.partitionBy("type", "sid").orderBy((F.col("sid") != F.col("__fl_old")).cast("int"), "name"))
    one = moved.withColumn("__fl_n", own).where("__fl_n = 1").select(*spaces.columns)
    return spaces.where((F.col("type") != blog_type) | F.col("type").isNull()).unionByName(one)


def username_ids(wanted: DataFrame, users: DataFrame, hashed: DataFrame) -> DataFrame:
    """username, uid: the known id (the positive one if there are several), else the hash.

    hashed: username, uid by `string_hash`. A username with several ids, none positive, is left out.
    """
    known = users.groupBy("username").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n = 1 or top > 0")
    several = users.groupBy("username").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n > 1 and top <= 0")
    return wanted.select("username").distinct().join(several, "username", "left_anti").join(known, "username", "left").join(hashed, "username", "left").select(
        "username", F.coalesce("top", "uid").alias("uid")
    )


def colliding_keys(rows: DataFrame, pairs: DataFrame, keys: list[str], column: str = "uid") -> DataFrame:
    """Keys that both ids of a pair have: what would come twice after the merge. neg, pos, keys, n."""
    ids = pairs.select("neg", "pos", F.explode(F.array("neg", "pos")).alias(column))
    return rows.join(ids, column).groupBy("neg", "pos", *keys).agg(F.count("*").alias("n")).where("n >= 2")

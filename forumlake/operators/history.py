"""Versions of topics over time: as-of reads, pairing of commits, recovery of deleted posts.

A timeline is rows (key..., ts). As-of lookups are one window over versions and requests of
the same key, not a range join, so their cost is a sort however far the two are apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlake.functions.scalars import message_space, timestamp_hint


def asof_floor(requests: DataFrame, versions: DataFrame, keys: Sequence[str], at: str = "at", ts: str = "ts") -> DataFrame:
    """Each request (keys, at) with the greatest version not after it, or the key's first version."""
    keys = list(keys)
    v = versions.select(*keys, F.col(ts).alias("__fl_t"), F.col(ts).alias("__fl_v"), F.lit(0).alias("__fl_r")).distinct()
    r = requests.select(*keys, F.col(at).alias("__fl_t"), F.lit(None).cast("bigint").alias("__fl_v"), F.lit(1).alias("__fl_r"))
    w = Window.partitionBy(*keys).orderBy("__fl_t", "__fl_r").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    found = v.unionByName(r).withColumn("__fl_f", F.coalesce(F.last("__fl_v", ignorenulls=True).over(w), F.min("__fl_v").over(whole)))
    return found.where("__fl_r = 1").select(*keys, F.col("__fl_t").alias(at), F.col("__fl_f").alias(ts))


def asof_ceiling(requests: DataFrame, versions: DataFrame, keys: Sequence[str], at: str = "at", ts: str = "ts") -> DataFrame:
    """Each request with the least version not before it, or the key's first version."""
    keys = list(keys)
    v = versions.select(*keys, F.col(ts).alias("__fl_t"), F.col(ts).alias("__fl_v"), F.lit(1).alias("__fl_r")).distinct()
    r = requests.select(*keys, F.col(at).alias("__fl_t"), F.lit(None).cast("bigint").alias("__fl_v"), F.lit(0).alias("__fl_r"))
    w = Window.partitionBy(*keys).orderBy("__fl_t", "__fl_r").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    found = v.unionByName(r).withColumn("__fl_f", F.coalesce(F.first("__fl_v", ignorenulls=True).over(w), F.min("__fl_v").over(whole)))
    return found.where("__fl_r = 0").select(*keys, F.col("__fl_t").alias(at), F.col("__fl_f").alias(ts))


def pair_commits(pages: DataFrame, documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Page commits (keys, ts, hint, is_meta) with their document commit (keys, ts, hint).

    They belong together if their hints are equal (of several documents the last); a page commit
    without one pairs, if it is a meta commit, with the first document not before it, or the first.
    """
    keys = list(keys)
    d = documents.groupBy(*keys, "hint").agg(F.max("ts").alias("document_ts"))
    exact = pages.join(d, [*keys, "hint"], "left")
    rest = exact.where("document_ts is null and is_meta").select(*keys, F.col("ts").alias("at")).distinct()
    near = asof_ceiling(rest, documents, keys).select(*keys, F.col("at").alias("ts"), F.col("ts").alias("near_ts"))
    return exact.join(near, [*keys, "ts"], "left").withColumn("document_ts", F.coalesce("document_ts", "near_ts")).drop("near_ts")


def timeline(pages: DataFrame, documents: DataFrame, lines: DataFrame, keys: Sequence[str], topic: str = "mid") -> DataFrame:
    """The versions of topics: keys, ts, page_ts, document_ts.

    pages and documents are paired as in `pair_commits`; unpaired pages are left out. lines: page_ts,
    id, ts are what the commits' own lists of exact moments say (of a repeated id the last line,
    `lines.timestamps`). A page's moment is its topic's in its commit's list; where the list is empty
    or lacks the topic, it is the commit's hint. Of pages with equal moments the last commit stands.
    """
    keys = list(keys)
    paired = pair_commits(pages, documents, keys).where("document_ts is not null")
    exact = lines.select(F.col("page_ts").alias("ts"), F.col("id").alias(topic), F.col("ts").alias("__fl_exact"))
    at = paired.join(exact, ["ts", topic], "left").withColumn("__fl_at", F.coalesce("__fl_exact", "hint"))
    last = at.groupBy(*keys, "__fl_at").agg(F.max("ts").alias("page_ts"), F.max_by("document_ts", "ts").alias("document_ts"))
    return last.select(*keys, F.col("__fl_at").alias("ts"), "page_ts", "document_ts")


def content_at(requests: DataFrame, versions: DataFrame, keys: Sequence[str], at: str = "at", ts: str = "ts") -> DataFrame:
    """Each request (keys, at) with its version by `asof_floor`, and the other columns of that version (keys and ts identify one)."""
    return asof_floor(requests, versions, keys, at, ts).join(versions, [*keys, ts])


#: Slots that the time from the first to the last blocked moment is cut into.
BLOCK_SLOTS = 1 << 16


def drop_blocked(versions: DataFrame, ranges: DataFrame, ts: str = "ts") -> DataFrame:
    """Versions outside all closed ranges (lo, hi), however many, which may overlap; a range with a null end is none.

    Time is cut into slots. Slots that a range covers are one row each, a range's ends one row per
    slot they lie in, and versions are anti-joined on their slot. A version with a null moment stays.
    """
    r = ranges.where("lo <= hi").select(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))
    ends = r.agg(F.min("lo").alias("a"), F.max("hi").alias("b")).first()
    if ends["a"] is None:
        return versions
    width = (ends["b"] - ends["a"]) // BLOCK_SLOTS + 1
    slot = F.expr(f"({ts} - {ends['a']}) div {width}")
    pieces = r.select("lo", "hi", F.explode(F.expr(f"sequence((lo - {ends['a']}) div {width}, (hi - {ends['a']}) div {width})")).alias("__fl_slot"))
    begin = F.col("__fl_slot") * width + ends["a"]
    whole = (F.col("lo") <= begin) & (F.col("hi") >= begin + width - 1)
    covered = pieces.where(whole).select("__fl_slot").distinct()
    parts = pieces.where(~whole).select(F.col("__fl_slot").alias("__fl_s"), F.col("lo").alias("__fl_lo"), F.col("hi").alias("__fl_hi"))
    free = versions.withColumn("__fl_slot", slot).join(covered, "__fl_slot", "left_anti")
    inside = (F.col("__fl_slot") == F.col("__fl_s")) & F.col(ts).between(F.col("__fl_lo"), F.col("__fl_hi"))
    return free.join(parts, inside, "left_anti").drop("__fl_slot")


def cut_at_block(versions: DataFrame, keys: Sequence[str], blocked: Column, ts: str = "ts") -> DataFrame:
    """The timeline up to its last version that isn't blocked; none if all are."""
    ok = F.max(F.when(~blocked, F.col(ts))).over(Window.partitionBy(*keys))
    return versions.withColumn("__fl_cut", ok).where(F.col(ts) <= F.col("__fl_cut")).drop("__fl_cut")


def first_true(rows: DataFrame, keys: Sequence[str], test: Column, ts: str = "ts") -> DataFrame:
    """The first version for which a test holds (F...FT...T)."""
    return rows.groupBy(*keys).agg(F.min(F.when(test, F.col(ts))).alias(ts))


def last_true(rows: DataFrame, keys: Sequence[str], test: Column, ts: str = "ts") -> DataFrame:
    """The last version for which a test holds (T...TF...F)."""
    return rows.groupBy(*keys).agg(F.max(F.when(test, F.col(ts))).alias(ts))


def recover_deleted(post_versions: DataFrame, keys: Sequence[str] = ("type", "mid", "id"), content: Sequence[str] = ("content_html",), ts: str = "ts") -> DataFrame:
    """For posts that are deleted in their last version: when they last lived, and their content then.

    Deleted is state bit 1 or 16. A post that is alive at the end, or never was, has no row.
    """
    dead = F.coalesce(F.col("state").bitwiseAND(17) != 0, F.lit(False))
    living = F.when(~dead, F.col(ts))
    g = post_versions.groupBy(*keys).agg(F.max(living).alias("last_alive"), F.max(ts).alias("last_seen"), *[F.max_by(c, living).alias(c) for c in content])
    return g.where("last_alive is not null and last_alive < last_seen").drop("last_seen")


def file_index(commits: DataFrame) -> DataFrame:
    """(repo_id, commit_id, path), each once, of commits with their lists of changed paths; skips ``meta`` and ``init`` first commits."""
    kept = commits.where(~(F.col("msg").rlike("(?i)^(meta|init)") & F.col("is_first")))
    return kept.select("repo_id", "commit_id", F.explode("paths").alias("path")).distinct()


def commits_of(index: DataFrame, path: str) -> DataFrame:
    """The commits that changed a path."""
    return index.where(F.col("path") == path)


def path_log(commits: DataFrame) -> DataFrame:
    """repo_id, path, n_commits, first_ts, last_ts, spaces (how many the messages name) over the commits that changed each path.

    commits: repo_id, commit_id, paths, msg, is_first, committed, authored; the moment is the message's hint.
    """
    own = commits.select("repo_id", "commit_id", timestamp_hint("msg", "committed", "authored").alias("ts"), message_space("msg").alias("space"))
    logged = file_index(commits).join(own, ["repo_id", "commit_id"])
    return logged.groupBy("repo_id", "path").agg(F.count("*").alias("n_commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("space").alias("spaces"))


def freshness(repos: DataFrame, now: int, minutes: int = 15) -> DataFrame:
    """Whether a repository's last commit (seconds) is older than it may be; static and old ones are exempt."""
    exempt = F.col("is_static") | F.col("name").contains("old")
    return repos.withColumn("stale", ~exempt & (F.lit(now) - F.col("last_commit") > minutes * 60))

"""Queries of the training-text problems: p2, p4, p7, p8, p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.llm.main_body import main_body
from forumlake.llm.packing import pack, pack_documents, violations
from forumlake.llm.quality import junk_probability, named_statistics
from forumlake.llm.tokenize import encode_documents
from forumlake.llm.topn import top_n
from forumlake.schema import second, somebody
from forumlake.session import materialise, table

TOP = 5
KINDS = ("post", "topic")


def ranked_items(spark: SparkSession, root: str) -> DataFrame:
    """Posts by their uid, and topics by their uid with the second of their last post."""
    posts = table(spark, root, "ba_post").select("type", "id", "mid", somebody(F.col("uid")).alias("uid"), second(F.col("dateline")).alias("sec"))
    by_post = posts.select(F.lit(0).alias("g1"), F.col("uid").alias("g2"), F.col("sec").alias("score"), F.col("id").alias("item"), F.col("type").alias("tie1"), F.col("mid").alias("tie2"))
    last = posts.groupBy("type", F.col("id").cast("bigint").alias("pid")).agg(F.max("sec").alias("sec"))
    topics = table(spark, root, "ba_topic").select("type", F.col("id").alias("tid"), somebody(F.col("uid")).alias("author"), F.col("last_post_pid").alias("pid"))
    topics = topics.where("author is not null and pid is not null").join(last.where("sec is not null"), ["type", "pid"])
    by_topic = topics.select(F.lit(1).alias("g1"), F.col("author").alias("g2"), F.col("sec").alias("score"), F.col("pid").alias("item"), F.col("type").alias("tie1"), F.col("tid").alias("tie2"))
    return by_post.unionByName(by_topic)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    top = top_n(spark, ranked_items(spark, root), TOP)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("g1") + 1).cast("int"))
    return top.select(kind.alias("kind"), F.col("g2").alias("uid"), F.col("tie1").cast("int").alias("type"), F.col("tie2").cast("int").alias("mid"), F.col("item").alias("pid"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return main_body(table(spark, root, "topic"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_documents(spark, table(spark, root, "documents"))


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(spark, table(spark, root, "documents"), table(spark, root, "pack_capacity"))


def p8_violations(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong with the packing of the whole corpus: nothing."""
    sizes = materialise(spark, encode_documents(spark, table(spark, root, "documents"), counts_only=True), "sizes")
    return violations(materialise(spark, pack(spark, sizes, table(spark, root, "pack_capacity")), "packed"), sizes)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return junk_probability(table(spark, root, "documents")).where("junk >= 0.5").select("doc_id")


def p9_statistics(spark: SparkSession, root: str) -> DataFrame:
    return named_statistics(table(spark, root, "documents"))


def p9_counts(spark: SparkSession, root: str) -> DataFrame:
    """The statistics that are plain counts: characters, lines that show something, digits."""
    s = named_statistics(table(spark, root, "documents"))
    n_chars, n_lines = (F.round(F.exp(c) - 1).cast("bigint") for c in ("log_chars", "log_lines"))
    return s.select("doc_id", n_chars.alias("n_chars"), n_lines.alias("n_lines"), (F.col("digit_share") > 0).alias("has_digits"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p7_ids": p7_ids, "p8_packing": p8_packing, "p9_found": p9_found, "p9_statistics": p9_statistics, "p9_counts": p9_counts, "p8_violations": p8_violations}

_SEC = "nullif(case when dateline > 100000000000 then dateline // 1000 else dateline end, 0)"

_SHOWN = r"[^\s\p{Z}\x0b\x1c-\x1f\x85]"

ORACLES = {
    "p8_violations": "select cast(null as varchar) as container, cast(null as bigint) as doc_id, cast(null as bigint) as bin, cast(null as varchar) as problem where false",
    "p9_counts": rf"""
select doc_id, length(text) as n_chars, cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SHOWN}'))) as bigint) as n_lines,
       regexp_matches(text, '\p{{N}}') as has_digits
from documents where regexp_matches(text, '{_SHOWN}')""",
    "p4_found": f"""
with p as (select distinct type, id, mid, uid, {_SEC} as sec from ba_post),
l as (select type, id, max(sec) as sec from p group by type, id),
t as (select distinct t.type, t.id, t.uid, t.last_post_pid, l.sec from ba_topic t join l on l.type = t.type and l.id = t.last_post_pid),
i as (
  select 'post' as kind, uid, type, mid, cast(id as bigint) as pid, sec from p
  union all select 'topic', uid, type, id, last_post_pid, sec from t)
select kind, uid, type, mid, pid from i where uid <> 0 and sec is not null
qualify row_number() over (partition by kind, uid order by sec desc, pid desc, type, mid) <= 5""",
}

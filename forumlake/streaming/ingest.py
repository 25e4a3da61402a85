"""Incremental ingest: new deliveries are folded into a stored table, batch by batch.

The stored table is cut into buckets by a hash of its key. A batch reads and rewrites only the buckets
that it touches: their rows are written as a new generation, and publishing a version, one small file
that says which generation each bucket is in, makes them the table's. The version carries the stream
and the number of its batch, so a batch that is run again after a failure changes nothing: delivery at
least once has the effect of exactly once, whatever the rules of the merge. The stream's checkpoint
holds the offsets. Texts that can't be read go to a folder of dead letters, one generation per batch,
from which they can be added again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.operators.merge import blog_post_tombstones, like_tombstones
from forumlake.session import hadoop_path
from forumlake.sources import documents

BUCKET, GEN = "__fl_bucket", "__fl_gen"


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str, anew: bool = True) -> None:
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, not anew)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class SnapshotTable:
    """A table in hash buckets of its key, each in some generation; a numbered version says which. One writer at a time.

    A version that is still empty is of a writer that died, and doesn't count. Old generations are
    kept for KEEP versions, for readers that are still at work.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _numbers(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.path}/_versions")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:8]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def version(self) -> dict:
        """number, gens (of buckets that have rows), applied (the last batch of each stream)."""
        for n in reversed(self._numbers()):
            text = _read_text(self.spark, f"{self.path}/_versions/{n:08d}.json")
            if text:
                return json.loads(text)
        return {"number": 0, "gens": {}, "applied": {}}

    def _dirs(self, gens: dict[str, int]) -> list[str]:
        return [f"{self.path}/data/{GEN}={g}/{BUCKET}={b}" for b, g in sorted(gens.items())]

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        gens = {b: g for b, g in self.version()["gens"].items() if buckets is None or int(b) in buckets}
        fs, _ = hadoop_path(self.spark, self.path)
        dirs = [d for d in self._dirs(gens) if fs.exists(hadoop_path(self.spark, d)[1])]  # a bucket may have lost all rows
        return self.spark.read.schema(self.schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], self.schema)

    def applied(self, stream: str, epoch: int) -> bool:
        return self.version()["applied"].get(stream, -1) >= epoch

    def replace(self, rows: DataFrame, buckets: Sequence[int], stream: str = "", epoch: int | None = None) -> None:
        """Put rows, which may be made from the table itself, in the place of some buckets."""
        old = self.version()
        n = max(self._numbers(), default=0) + 1
        out = rows.withColumn(BUCKET, self.bucket()).withColumn(GEN, F.lit(n))
        out.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GEN, BUCKET).parquet(f"{self.path}/data")
        applied = old["applied"] if epoch is None else old["applied"] | {stream: epoch}
        new = {"number": n, "gens": old["gens"] | {str(b): n for b in buckets}, "applied": applied}
        _write_text(self.spark, f"{self.path}/_versions/{n:08d}.json", json.dumps(new))
        self._forget(n, new)

    def _forget(self, n: int, new: dict) -> None:
        keep = {*new["gens"].values()}
        for k in [x for x in self._numbers() if x <= n][-self.KEEP :]:
            text = _read_text(self.spark, f"{self.path}/_versions/{k:08d}.json")
            keep |= {*json.loads(text)["gens"].values()} if text else set()
        fs, p = hadoop_path(self.spark, f"{self.path}/data")
        if fs.exists(p):
            for s in fs.listStatus(p):
                name = s.getPath().getName()
                if name.startswith(f"{GEN}=") and int(name.partition("=")[2]) not in keep:
                    fs.delete(s.getPath(), True)
        for k in self._numbers()[: -self.KEEP]:
            fs.delete(hadoop_path(self.spark, f"{self.path}/_versions/{k:08d}.json")[1], False)


def merge_batch(target: SnapshotTable, merge: Callable[[DataFrame], DataFrame], seq: str = "seq", stream: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: stored rows of the touched buckets and the batch's are merged, once for each batch number.

    A table whose schema has first_seq and last_seq keeps the delivery numbers of its rows; merge
    folds such states (`merge.fold_post_states`), and deliveries may come in any order. In another
    table stored rows count as versions before all of the batch's, which is right only where
    deliveries come in order.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if target.applied(stream, epoch):
            return
        touched = [r[0] for r in batch.select(target.bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        stored = target.read(touched)
        cols = stored.columns
        if {"first_seq", "last_seq"} <= set(cols):
            fresh = batch.withColumn("first_seq", F.col(seq)).withColumn("last_seq", F.col(seq))
            merged = merge(stored.unionByName(fresh.select(*cols)))
        else:
            merged = merge(stored.withColumn(seq, F.lit(-1).cast("bigint")).unionByName(batch.select(*cols, seq))).select(*cols)
        target.replace(merged, touched, stream, epoch)

    return run


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that a checkpoint keeps, and a new one has not had: batch numbers count within it."""
    path = f"{checkpoint}/__fl_stream"
    name = _read_text(spark, path)
    if not name:
        name = uuid.uuid4().hex
        _write_text(spark, path, name, anew=False)
    return name


def _run(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()


def ingest(source: DataFrame, target: SnapshotTable, merge: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Fold all that a streaming source has into the table, then stop; the next call goes on from there."""
    _run(source, merge_batch(target, merge, stream=stream_name(target.spark, checkpoint)), checkpoint)


class DocumentTables:
    """What topic documents are ingested to: posts, reactions, and dead letters."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.dead = spark, f"{path}/dead"
        self.posts = SnapshotTable(spark, f"{path}/posts", "type int, id int, mid int, uid bigint, dateline bigint, state int", ["type", "mid"], buckets)
        self.likes = SnapshotTable(spark, f"{path}/likes", "type int, mid int, pid int, value int, total bigint", ["type", "mid"], buckets)

    def dead_letters(self) -> DataFrame:
        fs, p = hadoop_path(self.spark, self.dead)
        return self.spark.read.schema("body string, epoch bigint").parquet(self.dead) if fs.exists(p) else self.spark.createDataFrame([], "body string, epoch bigint")


def document_batch(tables: DocumentTables, body: str = "body", stream: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: documents become posts and reactions, each topic as its last document of the batch (by `at`) has it.

    Posts keep their first author and second and take the new state. Of a topic that came, reactions
    it no longer has go to 0 and, in blogs, posts it no longer has are deleted (state 1). Texts that
    aren't documents are dead letters. A batch that is run again changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        read = documents.read_topics(batch.select(F.col(body).alias("body"), "at"))
        documents.dead_letters(read, "body").select("body", F.lit(epoch).alias("epoch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(tables.dead)
        t = read.where("topic is not null")
        of = t.select(documents.space_type_id(F.col("topic.space.type")).alias("type"), F.col("topic.id").alias("mid"), "at", "body", "topic")
        topics = of.groupBy("type", "mid").agg(F.max_by("topic", F.struct("at", F.xxhash64("body"))).alias("topic")).select("topic")
        seen = of.select("type", "mid").distinct()
        if not tables.posts.applied(stream, epoch):
            touched = [r[0] for r in seen.select(tables.posts.bucket().alias("b")).distinct().collect()]
            stored = tables.posts.read(touched)
            new = documents.post_rows(topics).dropDuplicates(["type", "id", "mid"])
            keys = ["type", "id", "mid"]
            old = blog_post_tombstones(stored, new).select(*stored.columns)
            fresh = new.select(*keys, F.struct("uid", "dateline", "state").alias("n"))
            both = old.select(*keys, F.struct("uid", "dateline", "state").alias("o")).join(fresh, keys, "full")
            first = F.coalesce("o", "n")
            tables.posts.replace(both.select(*keys, first["uid"].alias("uid"), first["dateline"].alias("dateline"), F.coalesce("n", "o")["state"].alias("state")), touched, stream, epoch)
        if not tables.likes.applied(stream, epoch):
            touched = [r[0] for r in seen.select(tables.likes.bucket().alias("b")).distinct().collect()]
            new = documents.like_rows(topics).groupBy("type", "mid", "pid", "value").agg(F.max("total").cast("bigint").alias("total"))
            tables.likes.replace(like_tombstones(tables.likes.read(touched), new, seen), touched, stream, epoch)

    return run


def ingest_documents(source: DataFrame, tables: DocumentTables, checkpoint: str) -> None:
    """`document_batch` over all that a streaming source of (body, at) has."""
    _run(source, document_batch(tables, stream=stream_name(tables.spark, checkpoint)), checkpoint)


def reset(spark: SparkSession, checkpoint: str) -> None:
    """Forget the stream's offsets, so that the next ingest begins at the start."""
    fs, p = hadoop_path(spark, checkpoint)
    fs.delete(p, True)


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """A folder, or one file, of Parquet as a stream."""
    fs, p = hadoop_path(spark, path)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(p).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))

"""Compaction of partitions that hold too many small files.

A table is a folder of Parquet files, `data/gen=<n>/<partition directories>`. Every write, an append or
a compaction, has a generation of its own: a number claimed by creating a file that must not exist.
Its files lie beside all others and count only from the moment it is published; then a manifest lists
them. A snapshot is the set of published generations less the (partition, generation) pairs that
published compactions have replaced. Readers pin one, and nothing that a snapshot names is deleted
but by `vacuum`.

`compact` finds, from the manifests, the partitions whose count of small files exceeds a limit, and
rewrites only those into files of a target size, with repeated records removed by key. It writes by
dynamic overwrite, which replaces the partitions of its own generation alone, so a job that lost
executors can run again. Publishing replaces exactly the generations it has read: an append that came
or finished meanwhile stays as it is. Of two compactions from the same snapshot the first to publish
wins, as it takes the next place in their order by a create that fails if the file exists; the other
one is a conflict. What was read must have as many rows as the manifests say, and so must what was
written. A writer that died is never published; its claim and its files go with `vacuum` once its
lease has run out.

Distribution: records move by (partition, hash of key), with as many hash slots per partition as it
needs files of the target size, so a partition with a third of all records is rewritten by as many
tasks as its bytes deserve, and all copies of a record meet in one of them. Manifests are tables, read
in tasks. The driver has one row per partition to be rewritten, and the reader's file list of at most
ROUND_FILES files at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from forumlake.session import hadoop_path

SMALL_BYTES = 32 << 20
TARGET_BYTES = 256 << 20
MAX_SMALL_FILES = 1
#: Files that are rewritten by one job, at most (a partition with more is a job of its own).
ROUND_FILES = 100_000
#: Seconds after which a writer that hasn't published counts as dead.
LEASE = 6 * 3600
GEN = "gen"


class Conflict(RuntimeError):
    """Another writer changed what this one was about to replace."""


@dataclass(frozen=True)
class Snapshot:
    """Published generations, and how far the order of compactions goes; all of it numbers."""

    appends: tuple[int, ...]
    compactions: tuple[int, ...]  # generations, in their order
    place: int  # the last place taken in that order

    @property
    def version(self) -> int:
        return len(self.appends) + len(self.compactions)


class FileTable:
    """A versioned folder of Parquet files in partition directories.

    schema: of the records, partition columns included; keys identify a record.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: Sequence[str], keys: Sequence[str]):
        self.spark, self.path, self.schema = spark, path, schema
        self.partition_by, self.keys = list(partition_by), list(keys)
        self.data, self.log = f"{path}/data", f"{path}/_log"
        types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
        parts = ", ".join(f"{c} {types[c]}" for c in self.partition_by)
        self._manifest_schema = f"{parts}, __fl_gen int, file string, n_bytes bigint, n_rows bigint"
        self._replaced_schema = f"{parts}, __fl_gen int"

    # -- log -----------------------------------------------------------------
    def _create(self, name: str, text: str) -> None:
        """A new file of the log; FileExistsError if it is there."""
        fs, p = hadoop_path(self.spark, f"{self.log}/{name}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise FileExistsError(name) from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _entries(self) -> dict[str, tuple[int, float]]:
        """Names in the log with their bytes and age in seconds."""
        fs, p = hadoop_path(self.spark, self.log)
        if not fs.exists(p):
            return {}
        now = time.time()
        return {s.getPath().getName(): (s.getLen(), now - s.getModificationTime() / 1000) for s in fs.listStatus(p)}

    def _text(self, name: str) -> str:
        fs, p = hadoop_path(self.spark, f"{self.log}/{name}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _delete(self, path: str) -> None:
        fs, p = hadoop_path(self.spark, path)
        fs.delete(p, True)

    def _claim(self) -> int:
        """A generation for this writer alone."""
        n = max((int(x[6:]) for x in self._entries() if x.startswith("claim-")), default=0)
        while True:
            n += 1
            try:
                self._create(f"claim-{n:08d}", json.dumps({"at": time.time()}))
                return n
            except FileExistsError:
                continue

    def _give_up(self, gen: int) -> None:
        for path in (f"{self.data}/{GEN}={gen}", f"{self.path}/_manifest/{gen}", f"{self.path}/_replaced/{gen}"):
            self._delete(path)

    def snapshot(self) -> Snapshot:
        """What is published now. A file of the log that is still empty is of a writer at work, or of a dead one."""
        entries = self._entries()
        appends = tuple(sorted(int(x[5:]) for x, (size, _) in entries.items() if x.startswith("done-") and size))
        places = sorted((int(x[8:]), size) for x, (size, _) in entries.items() if x.startswith("compact-"))
        compactions = tuple(json.loads(self._text(f"compact-{k:08d}"))[GEN] for k, size in places if size)
        return Snapshot(appends, compactions, places[-1][0] if places else 0)

    def version(self) -> int:
        return self.snapshot().version

    # -- manifests -----------------------------------------------------------
    def _part(self, gen: Column | int) -> Column:
        """The directory of a partition of a generation, below data."""
        steps = [F.concat(F.lit(f"{GEN}="), gen if isinstance(gen, Column) else F.lit(gen))]
        steps += [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in self.partition_by]
        return F.concat_ws("/", *steps)

    def _list(self, gen: int) -> int:
        """Write a generation's manifest from its files' footers; returns its rows."""
        fs, p = hadoop_path(self.spark, f"{self.data}/{GEN}={gen}")
        out = f"{self.path}/_manifest/{gen}"
        if fs.exists(p):
            rows = self.spark.read.schema(self.schema).option("basePath", f"{self.data}/{GEN}={gen}").parquet(str(p))
            m = rows.groupBy(*self.partition_by, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"))
            m.select(*self.partition_by, F.lit(gen).alias("__fl_gen"), "file", "n_bytes", "n_rows").write.mode("overwrite").parquet(out)
        else:
            self.spark.createDataFrame([], self._manifest_schema).write.mode("overwrite").parquet(out)
        return self.spark.read.schema(self._manifest_schema).parquet(out).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]

    def live(self, at: Snapshot) -> DataFrame:
        """The files of a snapshot: partition columns, __fl_gen, file, n_bytes, n_rows."""
        gens = [*at.appends, *at.compactions]
        if not gens:
            return self.spark.createDataFrame([], self._manifest_schema)
        m = self.spark.read.schema(self._manifest_schema).parquet(*[f"{self.path}/_manifest/{g}" for g in gens])
        if at.compactions:
            r = self.spark.read.schema(self._replaced_schema).parquet(*[f"{self.path}/_replaced/{g}" for g in at.compactions])
            same = [m[c].eqNullSafe(r[c]) for c in r.columns]
            m = m.join(r, same, "left_anti")
        return m

    def files(self, small_bytes: int = SMALL_BYTES, at: Snapshot | None = None) -> DataFrame:
        """Per partition: n_files, n_small, n_bytes, n_rows, gens (how many), clean (one generation, of a compaction: no repeated records)."""
        at = at or self.snapshot()
        g = self.live(at).groupBy(*self.partition_by).agg(
            F.count("*").alias("n_files"), F.count_if(F.col("n_bytes") < small_bytes).alias("n_small"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"),
            F.collect_set("__fl_gen").alias("gens"),
        )
        clean = (F.size("gens") == 1) & F.array_contains(F.array(*[F.lit(x) for x in at.compactions]).cast("array<int>"), F.col("gens")[0])
        return g.withColumn("clean", F.coalesce(clean, F.lit(False)))

    # -- writing and reading -------------------------------------------------
    def _write(self, rows: DataFrame, gen: int) -> None:
        out = rows.withColumn(GEN, F.lit(gen))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GEN, *self.partition_by).parquet(self.data)

    def append(self, rows: DataFrame) -> int:
        """Add records as they come: each task writes its own files to the partitions it meets."""
        gen = self._claim()
        try:
            self._write(rows, gen)
            self._list(gen)
        except BaseException:
            self._give_up(gen)
            raise
        self._create(f"done-{gen:08d}", json.dumps({GEN: gen}))
        return gen

    def _read(self, dirs: Sequence[str]) -> DataFrame:
        if not dirs:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, {GEN} int").option("basePath", self.data).parquet(*[f"{self.data}/{d}" for d in sorted(dirs)])
        return rows.drop(GEN)

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """Each record of a snapshot (the present one) once. Clean partitions are read as they are; only in others copies are removed."""
        parts = self.files(at=at).select(*self.partition_by, "clean", F.explode("gens").alias("g"))
        dirs = parts.select(self._part(F.col("g")).alias("d"), "clean").collect()
        out = self._read([r.d for r in dirs if r.clean])
        rest = [r.d for r in dirs if not r.clean]
        return out if not rest else out.unionByName(self._once(self._read(rest)))

    def _once(self, rows: DataFrame, *more: str) -> DataFrame:
        """One row per key: of unequal copies the one with the greatest other columns."""
        ids = [*self.partition_by, *[k for k in self.keys if k not in self.partition_by]]
        rest = [c for c in rows.columns if c not in (*ids, *more)]
        if not rest:
            return rows.dropDuplicates(ids)
        g = rows.groupBy(*ids, *more).agg(F.max(F.struct(*rest)).alias("__fl_r"))
        return g.select(*[F.col(f"__fl_r.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns if c not in more])

    # -- compaction ----------------------------------------------------------
    def plan(self, at: Snapshot, max_small_files: int, small_bytes: int, target_bytes: int) -> list:
        """The partitions to rewrite: more than max_small_files small files, and not clean in as few files as its bytes need."""
        need = F.ceil(F.col("n_bytes") / F.lit(target_bytes))
        f = self.files(small_bytes, at).where((F.col("n_small") > max_small_files) & ~(F.col("clean") & (F.col("n_files") <= need)))
        return f.withColumn("slots", F.greatest(need, F.lit(1)).cast("int")).orderBy(*self.partition_by).collect()

    def _rewrite(self, plan: Sequence, gen: int) -> None:
        """One job: the partitions of a plan, read from their generations and written as one."""
        todo = self.spark.createDataFrame([(*[r[c] for c in self.partition_by], r["gens"], r["slots"]) for r in plan], f"{self._replaced_schema.rpartition(',')[0]}, gens array<int>, slots int")
        dirs = [r.d for r in todo.select(*self.partition_by, F.explode("gens").alias("g")).select(self._part(F.col("g")).alias("d")).collect()]
        read = Observation("read")
        rows = self._read(dirs).observe(read, F.count(F.lit(1)).alias("n"))
        slots = todo.select(*[F.col(c).alias(f"__fl_{c}") for c in self.partition_by], "slots")
        same = [F.col(c).eqNullSafe(F.col(f"__fl_{c}")) for c in self.partition_by]
        # one row per partition of the plan
        slotted = rows.join(F.broadcast(slots), same).withColumn("__fl_slot", F.pmod(F.xxhash64(*self.keys), F.col("slots")))
        slotted = slotted.select(*rows.columns, "__fl_slot").repartition(sum(r["slots"] for r in plan), *self.partition_by, "__fl_slot")
        self._write(self._once(slotted, "__fl_slot"), gen)
        n, want = read.get["n"], sum(r["n_rows"] for r in plan)
        if n != want:
            raise Conflict(f"read {n} records, the manifests say {want}: files changed around the log")

    def compact(self, max_small_files: int = MAX_SMALL_FILES, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, round_files: int = ROUND_FILES) -> dict:
        """Rewrite the partitions with more than max_small_files small files. Returns what was done.

        A partition without repeated records, in as few files as its bytes need, is left alone.
        Raises Conflict, with nothing changed, if another compaction of the same snapshot was
        published first, or if files were changed around the log.
        """
        at = self.snapshot()
        plan = self.plan(at, max_small_files, small_bytes, target_bytes)
        done = {"parts": [self._name(r) for r in plan], "files_before": sum(r["n_files"] for r in plan)}
        if not plan:
            return done | {"rows": 0}
        gen = self._claim()
        try:
            rounds: list[list] = [[]]
            for r in plan:
                if rounds[-1] and sum(x["n_files"] for x in rounds[-1]) + r["n_files"] > round_files:
                    rounds.append([])
                rounds[-1].append(r)
            for part in rounds:
                self._rewrite(part, gen)
            rows = self._list(gen)
            replaced = [(*[r[c] for c in self.partition_by], g) for r in plan for g in r["gens"]]
            self.spark.createDataFrame(replaced, self._replaced_schema).write.mode("overwrite").parquet(f"{self.path}/_replaced/{gen}")
            self._publish(at, gen)
        except BaseException:
            self._give_up(gen)
            raise
        return done | {"rows": rows, GEN: gen}

    def _publish(self, at: Snapshot, gen: int) -> None:
        """Take the place after the snapshot's in the order of compactions. A place that a dead writer left empty is passed over."""
        age = self._entries().get(f"compact-{at.place:08d}", (1, 0.0))
        if not age[0] and age[1] < LEASE:
            raise Conflict("another compaction is being published")
        try:
            self._create(f"compact-{at.place + 1:08d}", json.dumps({GEN: gen}))
        except FileExistsError as e:
            raise Conflict("another compaction of the same snapshot was published first") from e

    def _name(self, r: object) -> str:
        return "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else r[c]}" for c in self.partition_by)

    def vacuum(self, lease: float = LEASE) -> list[str]:
        """Delete files that the present snapshot has replaced, and those of writers that claimed longer ago than the lease and
        haven't published. Readers of older snapshots must be done. Returns the directories that went."""
        at = self.snapshot()
        gone = []
        if at.compactions:
            r = self.spark.read.schema(self._replaced_schema).parquet(*[f"{self.path}/_replaced/{g}" for g in at.compactions])
            gone = [x.d for x in r.select(self._part(F.col("__fl_gen")).alias("d")).distinct().collect()]
        known = {*at.appends, *at.compactions}
        for name, (_, age) in self._entries().items():
            if name.startswith("claim-") and int(name[6:]) not in known and age > lease:
                gone.append(f"{GEN}={int(name[6:])}")
        fs, _ = hadoop_path(self.spark, self.data)
        there = [d for d in gone if fs.exists(hadoop_path(self.spark, f"{self.data}/{d}")[1])]
        for d in there:
            self._delete(f"{self.data}/{d}")
        return there

"""The N highest-scoring items of every group, from one global sort.

All items are range-partitioned and sorted on (group, score, identifier), so a group with a
third of all items lies in as many partitions as its size asks for, and no task holds a group.
Each partition numbers its items inside their groups and keeps the first N; only its first and
its last group can go on in a neighbour, so it reports the counts of those two. Prefix sums of
the reported counts give the exact positions; what lies beyond N is dropped. The reported rows
are at most two per partition, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlake.session import input_bytes, materialise, ship

#: Bytes of a partition of the sort, on average, and how much larger items are there than in files.
PARTITION_BYTES, GROWN = 128 << 20, 3

GROUP, ITEM = ("g1", "g2"), ("score", "item", "tie1", "tie2")
_COLS = (*GROUP, *ITEM)
_OUT = "part int, " + ", ".join(f"{c} bigint" for c in _COLS) + ", pos bigint, n bigint"


def _numbered(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: np.ndarray | None = None  # the last distinct item
        seen = 0  # distinct items of its group so far
        first: tuple[int, int, int] | None = None  # the first group and its count, once it has ended

        def out(rows: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            k = rows.shape[1]
            cols = [pa.array(np.full(k, part, dtype=np.int32)), *(pa.array(x) for x in rows), pa.array(pos), pa.array(n)]
            return pa.RecordBatch.from_arrays(cols, names=["part", *_COLS, "pos", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            before = np.concatenate([x[:, :1] if last is None else last[:, None], x[:, :-1]], axis=1)
            fresh = (x != before).any(axis=0)
            fresh[0] |= last is None
            new_group = (x[:2] != before[:2]).any(axis=0)
            new_group[0] |= last is None
            x, new_group = x[:, fresh], new_group[fresh]
            if not x.shape[1]:
                continue
            i = np.arange(x.shape[1])
            starts = i[new_group]
            if len(starts) and last is not None and first is None:  # the partition's first group ended here
                first = (int(last[0]), int(last[1]), seen + int(starts[0]))
            begin = np.maximum.accumulate(np.where(new_group, i, -seen))
            pos = i - begin + 1
            if first is None and len(starts) > 1:
                first = (int(x[0, 0]), int(x[1, 0]), int(starts[1]))
            seen, last = int(pos[-1]), x[:, -1]
            keep = pos <= top
            if keep.any():
                yield out(x[:, keep], pos[keep], np.zeros(int(keep.sum()), dtype=np.int64))
        if last is not None:
            ends = ([first] if first else []) + [(int(last[0]), int(last[1]), seen)]
            rows = np.zeros((6, len(ends)), dtype=np.int64)
            rows[0], rows[1] = [e[0] for e in ends], [e[1] for e in ends]
            yield out(rows, np.zeros(len(ends), dtype=np.int64), np.array([e[2] for e in ends], dtype=np.int64))

    return run


def top_n(spark: SparkSession, items: DataFrame, top: int, partitions: int | None = None) -> DataFrame:
    """The first ``top`` items of each group by score, then item, both descending, then tie1, tie2.

    items: bigint columns g1, g2 (the group), score, item, tie1, tie2. Returns these and pos.
    Defined cases: rows with a null in any of the six don't rank; equal rows are one item
    (they are neighbours after the sort, always in one partition); top < 1 or no items give no
    row; other columns are ignored. The order is total, so every run gives the same rows.
    partitions: of the sort; as many as the input's size asks for, unless given.
    """
    ship(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(items) * GROWN // PARTITION_BYTES))
    rows = items.select(*[F.col(c).cast("bigint").alias(c) for c in _COLS]).dropna()
    order = [F.col("g1"), F.col("g2"), F.col("score").desc(), F.col("item").desc(), F.col("tie1"), F.col("tie2")]
    ranked = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_numbered(top), _OUT)
    # written once: positions of a partition must not be computed twice from ranges sampled twice
    kept = materialise(spark, ranked, "topn")
    earlier = Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = kept.where("pos = 0").select("part", *GROUP, "n").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ends = ends.where("before > 0").select("part", *GROUP, "before")
    exact = kept.where("pos > 0").join(F.broadcast(ends), ["part", *GROUP], "left")  # at most two rows per partition
    return exact.withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0))).where(F.col("pos") <= top).select(*_COLS, "pos")

"""Filling containers of fixed capacity: sum-of-squares online packing.

Documents come one after the other. For each fill level the number of open containers is
kept in an array; a document goes where the sum of the squares of these numbers ends up least
(a new container, one of some level that becomes fuller, or one that it fills exactly); among
equals, into the fullest. This keeps the levels even, so that a partner for most sizes is at
hand. What is open at the end is merged, fullest first, where two contents fit together.

Only a document longer than the capacity is split: into full containers and a rest that is
packed like any document. Distribution: sizes, not texts, are shuffled, once for each
capacity, into shards of bounded tokens and rows by a hash of doc_id; a shard is packed by
one task. The unused room of a shard's last open containers is a fraction of a percent of it.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.llm.tokenize import TOKENIZER_DIR, encode_documents
from forumlake.session import materialise

#: Most tokens and documents of a shard, on average.
SHARD_TOKENS, SHARD_ROWS = 20_000_000, 200_000
SCHEMA = "container string, capacity int, bin bigint, doc_id bigint, part int, start int, n_tokens int"


def sum_of_squares(sizes: np.ndarray, capacity: int, merge: bool = True) -> np.ndarray:
    """The container of each size (0 < size <= capacity), numbered from 0; merge: put what is open at the end together."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by level
    stack: dict[int, list[int]] = {}
    out = np.empty(len(sizes), dtype=np.int64)
    opened = 0
    fill: dict[int, int] = {}
    for i, s in enumerate(sizes.tolist()):
        here = count[1 : capacity - s + 1]
        there = count[1 + s : capacity + 1]
        change = 2 * (there - here) + 2
        if len(change):
            change[-1] = 1 - 2 * here[-1]  # filled exactly: leaves its level and joins none
            change[here == 0] = np.iinfo(np.int64).max
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            least = int(change[best])
        else:
            least = np.iinfo(np.int64).max
        fresh = 2 * int(count[s]) + 1 if s < capacity else 0
        if fresh < least:
            b, level = opened, 0
            opened += 1
        else:
            level = best + 1
            b = stack[level].pop()
            count[level] -= 1
        out[i] = b
        full = level + s
        if full < capacity:
            count[full] += 1
            stack.setdefault(full, []).append(b)
            fill[b] = full
        else:
            fill.pop(b, None)
    return _merge_open(out, fill, opened, capacity) if merge else out


def _merge_open(out: np.ndarray, fill: dict[int, int], opened: int, capacity: int) -> np.ndarray:
    """Put the contents of open containers together, fullest first, each into the fullest it fits."""
    target = np.arange(opened)
    room: list[tuple[int, int]] = []  # (free room, container), sorted
    for b, full in sorted(fill.items(), key=lambda x: (-x[1], x[0])):
        at = bisect_right(room, (full, -1))
        if at < len(room):
            free, to = room.pop(at)
            target[b] = to
            if free > full:
                insort(room, (free - full, to))
        else:
            insort(room, (capacity - full, b))
    _, dense = np.unique(target[out], return_inverse=True)
    return dense.reshape(-1)


def pack_shard(doc_id: np.ndarray, n_tokens: np.ndarray, capacity: int) -> pd.DataFrame:
    """bin, doc_id, part, start, n_tokens of one shard's documents, which are taken by doc_id."""
    order = np.lexsort((n_tokens, doc_id))
    doc_id, n_tokens = doc_id[order], n_tokens[order].astype(np.int64)
    whole, rest = n_tokens // capacity, n_tokens % capacity
    # full containers of documents as long as the capacity or longer
    full = np.repeat(np.arange(len(doc_id)), whole)
    part = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    items = np.nonzero(rest)[0]
    bins = sum_of_squares(rest[items], capacity)
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    none = np.nonzero(n_tokens == 0)[0]
    idx = np.concatenate([items, full, none])
    return pd.DataFrame(
        {
            "bin": np.concatenate([bins, n_bins + np.arange(len(full)), np.zeros(len(none), dtype=np.int64)]),
            "doc_id": doc_id[idx],
            "part": np.concatenate([whole[items], part, np.zeros(len(none), dtype=np.int64)]).astype(np.int32),
            "start": np.concatenate([whole[items] * capacity, part * capacity, np.zeros(len(none), dtype=np.int64)]).astype(np.int32),
            "n_tokens": np.concatenate([rest[items], np.full(len(full), capacity), np.zeros(len(none), dtype=np.int64)]).astype(np.int32),
        }
    )


def pack(spark: SparkSession, sizes: DataFrame, containers: DataFrame, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Containers for the documents of ``sizes`` (doc_id bigint, n_tokens int), for each capacity.

    containers: container string, capacity int, a small fixed table (more than 1,000 rows are
    refused). Returns container, capacity, bin, doc_id, part, start, n_tokens: tokens
    [start, start + n_tokens) of the document lie in that bin; bins are numbered apart in each
    container kind. Defined cases: a document without tokens (null or empty text) comes out once,
    with 0 tokens, in its shard's first bin; a null size is 0; rows with equal doc_id are
    documents of their own; null or non-positive capacities are left out, repeated ones count once.
    """
    kinds = containers.where("capacity > 0").select("container", F.col("capacity").cast("int").alias("capacity")).distinct().limit(1_001).collect()
    if len(kinds) > 1_000:
        raise ValueError("more than 1000 container kinds")
    if not kinds:
        return spark.createDataFrame([], SCHEMA)
    rows = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("int"), F.lit(0)).alias("n_tokens"))
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    shards = max(1, -(-whole["t"] // shard_tokens), -(-whole["n"] // shard_rows))
    each = F.explode(F.array(*[F.struct(F.lit(k["container"]).alias("container"), F.lit(k["capacity"]).alias("capacity")) for k in sorted(kinds, key=lambda k: (k["capacity"], k["container"] or ""))]))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).withColumn("k", each).select("k.container", "k.capacity", "shard", "doc_id", "n_tokens")

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        container, capacity, shard = key
        pdf = pd.concat(frames, ignore_index=True)
        ids = pdf["doc_id"].fillna(-1).to_numpy(dtype=np.int64)  # a null doc_id comes out as -1
        got = pack_shard(ids, pdf["n_tokens"].to_numpy(), int(capacity))
        got["bin"] += int(shard) << 32
        got.insert(0, "capacity", np.int32(capacity))
        got.insert(0, "container", container)
        for at in range(0, len(got), 50_000):
            yield got.iloc[at : at + 50_000]

    return spread.groupBy("container", "capacity", "shard").applyInPandas(run, SCHEMA)


def pack_documents(spark: SparkSession, documents: DataFrame, containers: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """`pack` with the tokens of the documents' texts as sizes, counted once for all capacities."""
    return pack(spark, materialise(spark, encode_documents(spark, documents, tokenizer_dir, counts_only=True), "sizes"), containers)


def violations(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """container, doc_id, bin, problem of a packing that isn't right: none, if it is.

    sizes: doc_id, n_tokens, as packed. A bin holds more than its capacity; a document's parts don't
    add up to its tokens, don't follow each other, or are several though it fits.
    """
    over = packed.groupBy("container", "capacity", "bin").agg(F.sum("n_tokens").alias("n")).where("n > capacity").select("container", F.lit(None).cast("bigint").alias("doc_id"), "bin", F.lit("too full").alias("problem"))
    whole = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("want"), F.max("n_tokens").alias("most"), F.count("*").alias("copies"))
    parts = packed.groupBy("container", "capacity", "doc_id").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    both = parts.join(whole, "doc_id", "full")
    wrong = F.coalesce(F.col("have"), F.lit(-1)) != F.coalesce(F.col("want"), F.lit(-1))
    split = (F.col("most") <= F.col("capacity")) & (F.col("n") != F.col("copies"))
    bad = both.where(wrong | split | (F.col("end") != F.col("most"))).select("container", "doc_id", F.lit(None).cast("bigint").alias("bin"), F.when(split, "split").otherwise("not whole").alias("problem"))
    return over.unionByName(bad)

"""What changed between full snapshots: subtracted invertible Bloom lookup tables.

Every delivery is sketched per hash bucket: an element is (key, digest of the other
fields), put into one cell of each of four subtables; a cell holds the count of its
elements and the XOR of their keys, digests and checks. The table of a delivery minus
that of the one before it holds only elements that differ. A cell with count 1 or -1
whose check fits gives an element back; taking it out of its other cells uncovers more.
A bucket that doesn't come out empty, or whose recovered elements don't give the
bucket's own digest, is sketched again with larger tables; what still fails after the
last enlargement is compared by an exact join. A key with elements on both sides was
changed, with one on one side added or removed.

Distribution: one exchange, of (delivery, key, digest) by bucket. Buckets are hashes of
unique keys, so none is hot; removal of repeated rows, sketches, subtraction and peeling
all stay in the bucket's partition. The driver sees only the list of failed buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.session import materialise, ship

HASHES = 4
#: Rows of one delivery that a bucket holds on average.
BUCKET_ROWS = 4096
#: Cells of a bucket's first table; each enlargement multiplies by GROW.
FIRST_CELLS = 1024
GROW = 4
ROUNDS = 3

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_longs(columns: Sequence[np.ndarray | int]) -> np.ndarray:
    """Spark's ``xxhash64`` of bigint columns (public algorithm XXH64, seed 42), vectorised."""
    h: np.ndarray = np.uint64(42)
    with np.errstate(over="ignore"):
        for c in columns:
            x = np.asarray(c, dtype=np.int64).astype(np.uint64)
            h = h + _P5 + np.uint64(8)
            h = h ^ (_rotl(x * _P2, 31) * _P1)
            h = _rotl(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return np.asarray(h).astype(np.int64)


def _positions(k1: np.ndarray, k2: np.ndarray, v: np.ndarray, seed: int, sub: int) -> np.ndarray:
    h = xxhash64_longs([k1, k2, v, seed]).astype(np.uint64)
    return np.stack([((h >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64) % sub + j * sub for j in range(HASHES)])


def peel(group: np.ndarray, cell: np.ndarray, cnt: np.ndarray, k1: np.ndarray, k2: np.ndarray, v: np.ndarray, c: np.ndarray, seed: int, cells: int):
    """Recover the elements of many subtracted tables at once.

    group numbers the tables from 0. Cell -1 of a table is its digest, made from the rows by
    another hash. Returns (group, k1, k2, v, sign) of the elements, and for each table
    whether it failed (a cell is left, or the digest doesn't fit).
    """
    n = int(group.max()) + 1 if len(group) else 0
    sub = cells // HASHES
    T = [np.zeros(n * cells, dtype=np.int64) for _ in range(5)]
    real = cell >= 0
    at = group[real] * cells + cell[real]
    for t, x in zip(T, (cnt, k1, k2, v, c), strict=True):
        t[at] = x[real]
    tc, t1, t2, tv, tx = T
    found: list[tuple[np.ndarray, ...]] = []
    look = np.nonzero((tc == 1) | (tc == -1))[0]
    while len(look):
        pure = look[xxhash64_longs([t1[look], t2[look], tv[look]]) == tx[look]]
        if not len(pure):
            break
        # an element may be alone in several of its cells: take it once
        _, once = np.unique(np.stack([pure // cells, tx[pure]]), axis=1, return_index=True)
        pure = pure[once]
        g, a1, a2, av, ax, sign = pure // cells, t1[pure], t2[pure], tv[pure], tx[pure], tc[pure]
        found.append((g, a1, a2, av, sign))
        where = _positions(a1, a2, av, seed, sub) + g * cells
        for row in where:
            np.subtract.at(tc, row, sign)
            for t, x in ((t1, a1), (t2, a2), (tv, av), (tx, ax)):
                np.bitwise_xor.at(t, row, x)
        touched = np.unique(where)
        look = touched[(tc[touched] == 1) | (tc[touched] == -1)]
    el = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    failed = np.zeros(n, dtype=bool)
    left = np.nonzero(tc | t1 | t2 | tv | tx)[0]
    failed[left // cells] = True
    # the digest: count and XORs of all elements, checked with a second hash
    want = [np.zeros(n, dtype=np.int64) for _ in range(5)]
    for w, x in zip(want, (cnt, k1, k2, v, c), strict=True):
        w[group[~real]] = x[~real]
    have = [np.zeros(n, dtype=np.int64) for _ in range(5)]
    g = el[0]
    np.add.at(have[0], g, el[4])
    for w, x in zip(have[1:], (el[1], el[2], el[3], xxhash64_longs([el[1], el[2], el[3], -1])), strict=True):
        np.bitwise_xor.at(w, g, x)
    for w, x in zip(want, have, strict=True):
        failed |= w != x
    return el, failed


def _classify(el: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(index of an element of each key, code 1 added, 2 removed, 3 changed)."""
    g, k1, k2, _, sign = el
    keys = np.stack([g, k1, k2])
    _, first, at = np.unique(keys, axis=1, return_index=True, return_inverse=True)
    code = np.zeros(len(first), dtype=np.int64)
    np.bitwise_or.at(code, at.reshape(-1), np.where(sign > 0, 1, 2))
    return first, code


CHANGE = np.array(["", "added", "removed", "changed"])
_OUT = "pair int, bucket int, k1 bigint, k2 bigint, change string"


def _peeler(seed: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            pair, bucket = cols[0], cols[1]
            edge = np.concatenate([[True], (pair[1:] != pair[:-1]) | (bucket[1:] != bucket[:-1])])
            group = np.cumsum(edge) - 1
            gp, gb = pair[edge], bucket[edge]
            el, failed = peel(group, *cols[2:], seed=seed, cells=cells)
            good = ~failed[el[0]]
            el = tuple(x[good] for x in el)
            first, code = _classify(el) if len(el[0]) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            bad = np.nonzero(failed)[0]
            g = np.concatenate([el[0][first], bad])
            zero = np.zeros(len(bad), dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(gp[g].astype(np.int32)), pa.array(gb[g].astype(np.int32)), pa.array(np.concatenate([el[1][first], zero])), pa.array(np.concatenate([el[2][first], zero])),
                    pa.array(np.concatenate([CHANGE[code], np.repeat("failed", len(bad))]).astype(object), pa.string()),
                ],
                names=["pair", "bucket", "k1", "k2", "change"],
            )

        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.columns]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(same))  # sorted by (pair, bucket): where the last table begins
            if cut or (held and (held[-1][0][-1] != cols[0][0] or held[-1][1][-1] != cols[1][0])):
                parts = [*held, [x[:cut] for x in cols]]
                yield solve([np.concatenate(x) for x in zip(*parts, strict=True)])
                held = [[x[cut:] for x in cols]]
            else:
                held.append(cols)
        if held:
            yield solve([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _flags(cols: Sequence[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(cols):
        out = out + F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _packs(snapshots: DataFrame, keys: Sequence[str]) -> bool:
    """Whether keys are three whole numbers of at most 32 bits, which two bigints hold."""
    types = dict(snapshots.dtypes)
    return len(keys) == 3 and all(types[k] in ("tinyint", "smallint", "int") for k in keys)


def _key_pair(snapshots: DataFrame, keys: Sequence[str]) -> tuple[Column, Column]:
    """Two bigints for a key: its three ints, with a bit for each null, or else two hashes of it."""
    cols = [F.col(k) for k in keys]
    if not _packs(snapshots, keys):
        return F.xxhash64(_flags(cols), *cols, F.lit(1)), F.xxhash64(F.lit(2), _flags(cols), *cols)
    a, b, c = (x.cast("int") for x in cols)
    low, zero = F.lit(0xFFFFFFFF), F.lit(0)
    k1 = F.shiftleft(F.coalesce(b, zero).cast("bigint"), 32).bitwiseOR(F.coalesce(c, zero).cast("bigint").bitwiseAND(low))
    k2 = F.shiftleft(_flags([a, b, c]), 32).bitwiseOR(F.coalesce(a, zero).cast("bigint").bitwiseAND(low))
    return k1, k2


def _elements(snapshots: DataFrame, order: str, keys: Sequence[str], values: Sequence[str], buckets: int) -> DataFrame:
    """at (the delivery), bucket, k1, k2, v: one element per delivery and key, with repetitions.

    v digests the values as stored, nulls marked. Repeated rows give the same v; if copies of a key
    disagree inside a delivery, the greatest digest stands for the key, at every run.
    """
    k1, k2 = _key_pair(snapshots, keys)
    vs = [F.col(x) for x in values]
    v = F.xxhash64(_flags(vs), *vs)
    rows = snapshots.where(F.col(order).isNotNull()).select(F.col(order).alias("at"), k1.alias("k1"), k2.alias("k2"), v.alias("v"))
    bucket = F.pmod(F.xxhash64("k1", "k2", F.lit(7).cast("bigint")), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket)


def _sketch(elements: DataFrame, n_snaps: int, seed: int, cells: int) -> DataFrame:
    """Subtracted tables of consecutive deliveries: pair, bucket, cell, cnt, k1, k2, v, c; non-empty cells only."""
    sub = cells // HASHES
    h = F.xxhash64("k1", "k2", "v", F.lit(seed).cast("bigint"))
    places = [(F.pmod(F.shiftrightunsigned(F.col("h"), 16 * j).bitwiseAND(F.lit(0xFFFF)), F.lit(sub)) + F.lit(j * sub)).cast("int") for j in range(HASHES)]
    check, digest = F.xxhash64("k1", "k2", "v"), F.xxhash64("k1", "k2", "v", F.lit(-1).cast("bigint"))
    xors = [F.bit_xor(x).alias(x) for x in ("k1", "k2", "v", "c")]
    one = elements.groupBy("bucket", "snap", "k1", "k2").agg(F.max("v").alias("v"))
    put = (
        one.withColumn("h", h).withColumn("check", check).withColumn("digest", digest)
        .select("bucket", "snap", "k1", "k2", "v", "check", "digest", F.explode(F.array(F.lit(-1), *places)).alias("cell"))
        .select("bucket", "snap", "cell", "k1", "k2", "v", F.when(F.col("cell") < 0, F.col("digest")).otherwise(F.col("check")).alias("c"))
    )
    table = put.groupBy("bucket", "snap", "cell").agg(F.count("*").alias("cnt"), *xors)
    sides = F.array(F.struct(F.col("snap").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("snap") + 1).alias("pair"), F.lit(-1).alias("sign")))
    minus = (
        table.select("bucket", "cell", "cnt", "k1", "k2", "v", "c", F.explode(sides).alias("s"))
        .select("bucket", "cell", F.col("s.pair").alias("pair"), (F.col("cnt") * F.col("s.sign")).alias("cnt"), "k1", "k2", "v", "c")
        .where((F.col("pair") > 0) & (F.col("pair") < n_snaps))
        .groupBy("bucket", "pair", "cell").agg(F.sum("cnt").alias("cnt"), *xors)
    )
    some = (F.col("cnt") != 0) | (F.col("c") != 0) | (F.col("v") != 0) | (F.col("k1") != 0) | (F.col("k2") != 0)  # a bucket without a change has no row left
    return minus.where(some).select("pair", "bucket", "cell", "cnt", "k1", "k2", "v", "c").sortWithinPartitions("pair", "bucket")


def _exact(elements: DataFrame, failed: DataFrame, n_snaps: int) -> DataFrame:
    """The plain comparison, for tables that no enlargement decoded."""
    one = elements.groupBy("bucket", "snap", "k1", "k2").agg(F.max("v").alias("v"))
    old = one.select((F.col("snap") + 1).alias("pair"), "bucket", "k1", "k2", F.col("v").alias("old")).where(F.col("pair") < n_snaps)
    new = one.select(F.col("snap").alias("pair"), "bucket", "k1", "k2", F.col("v").alias("new")).where(F.col("pair") > 0)
    both = new.join(old, ["pair", "bucket", "k1", "k2"], "full").join(failed, ["pair", "bucket"], "left_semi")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("pair", "bucket", "k1", "k2", change.alias("change")).where("change is not null")


def snapshot_changes(
    spark: SparkSession,
    snapshots: DataFrame,
    order: str = "snap_ts",
    keys: Sequence[str] = ("type", "id", "mid"),
    values: Sequence[str] = ("uid", "dateline", "state", "sid"),
    bucket_rows: int = BUCKET_ROWS,
    first_cells: int = FIRST_CELLS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Keys added, removed or changed by each delivery against the one before it.

    snapshots: ``order`` (a number, date or time, the delivery), keys and values of any types that
    hash; others are ignored. Keys of three ints are what the tables hold; of other keys they hold two
    hashes, and the keys themselves are looked up afterwards in the deliveries, by recovered hashes.
    Returns order, the keys, change. Defined cases: rows without a delivery
    are left out; rows repeated inside a delivery count once; null keys are keys; null and null
    don't differ, null and a value do; a single delivery, or none, gives no row; a delivery that
    misses a key between two that have it gives removed, then added.
    """
    ship(spark)
    per = snapshots.where(F.col(order).isNotNull()).groupBy(F.col(order).alias("at")).agg(F.count("*").alias("n"))
    found = sorted((r[0], r[1]) for r in per.collect())  # one row per delivery
    buckets = max(1, -(-max((n for _, n in found), default=0) // bucket_rows))
    kind = dict(snapshots.dtypes)[order]
    numbers = F.broadcast(spark.createDataFrame([(s, i) for i, (s, _) in enumerate(found)], f"at {kind}, snap int"))  # one row per delivery
    elements = _elements(snapshots, order, keys, values, buckets).join(numbers, "at").drop("at")
    results: list[DataFrame] = []
    todo: DataFrame | None = None
    cells = first_cells
    for attempt in range(rounds):
        rows = elements if todo is None else elements.join(todo.select("bucket").distinct(), "bucket", "left_semi")
        tables = _sketch(rows.repartition("bucket"), len(found), attempt, cells)
        if todo is not None:
            tables = tables.join(todo, ["pair", "bucket"], "left_semi").sortWithinPartitions("pair", "bucket")
        done = materialise(spark, tables.mapInArrow(_peeler(attempt, cells), _OUT), f"diff-{attempt}")
        results.append(done.where("change <> 'failed'"))
        todo = done.where("change = 'failed'").select("pair", "bucket")  # at most one row per bucket and delivery
        if todo.isEmpty():
            break
        cells = min(cells * GROW, HASHES << 16)
    else:
        results.append(_exact(elements, todo, len(found)))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    out = out.join(numbers.select(F.col("at").alias("__fl_at"), F.col("snap").alias("pair")), "pair")
    if not _packs(snapshots, keys):
        return _look_up(out, snapshots, order, keys)
    low = F.lit(0xFFFFFFFF)

    def half(col: Column, bit: int) -> Column:
        x = col.bitwiseAND(low)
        signed = F.when(x > 0x7FFFFFFF, x - F.lit(1 << 32)).otherwise(x).cast("int")
        return F.when(F.shiftrightunsigned(F.col("k2"), 32).bitwiseAND(F.lit(1 << bit)) == 0, signed)

    a, b, c = keys
    return out.select(
        F.col("__fl_at").alias(order), half(F.col("k2"), 0).alias(a), half(F.shiftrightunsigned(F.col("k1"), 32), 1).alias(b), half(F.col("k1"), 2).alias(c), "change"
    )


def _look_up(out: DataFrame, snapshots: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """The keys of recovered hashes, from the rows that have them; the join filters rows by the hashes before they move."""
    k1, k2 = _key_pair(snapshots, keys)
    names = snapshots.where(F.col(order).isNotNull()).select(k1.alias("k1"), k2.alias("k2"), F.struct(*keys).alias("__fl_k"))
    wanted = names.join(out.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.any_value("__fl_k").alias("__fl_k"))
    return out.join(wanted, ["k1", "k2"]).select(F.col("__fl_at").alias(order), *[F.col(f"__fl_k.{k}").alias(k) for k in keys], "change")

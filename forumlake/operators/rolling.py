"""Rolling totals over trailing periods, by block decomposition.

Every entity's daily values are laid on the calendar (days without activity are
zeros) and the calendar is cut into blocks as long as the window. Inside a block
a prefix sum and a suffix sum are kept; the total of the ``w`` days that end with
day ``d`` is the prefix at ``d`` plus the suffix, in the block before, that starts
at ``d - w + 1``. Cost per day is constant, whatever the window.

Distribution: rows are first reduced to one per (entity, day), so the shuffle by
entity carries at most one row per entity and calendar day, even for an entity
that holds a third of all raw rows. The calendar bounds what a task keeps of one
entity; nothing unbounded is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.session import ship

#: Cells of the dense entity-by-day matrix that a task works on at once (8 bytes each).
CELLS = 2_000_000


def trailing(daily: np.ndarray, w: int) -> np.ndarray:
    """Trailing totals of ``w`` columns for each row of an (entities, days) matrix."""
    n, days = daily.shape
    blocks = -(-days // w) if days else 0
    padded = np.zeros((n, blocks * w), dtype=np.int64)
    padded[:, :days] = daily
    cube = padded.reshape(n, blocks, w)
    prefix = np.cumsum(cube, axis=2)
    suffix = np.cumsum(cube[:, :, ::-1], axis=2)[:, :, ::-1]
    total = prefix
    # day o of block b: prefix[b][o] + suffix[b - 1][o + 1]; the last day's window is its own block
    total[:, 1:, : w - 1] += suffix[:, :-1, 1:]
    return total.reshape(n, blocks * w)[:, :days]


def _complete(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entity, day, value) of sorted batches, cut only between entities."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in batches:
        e, d, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(e):
            continue
        cut = int(np.searchsorted(e, e[-1]))  # sorted by entity
        if cut:
            parts = [*held, (e[:cut], d[:cut], v[:cut])]
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            held = [(e[cut:], d[cut:], v[cut:])]
        elif held and held[-1][0][-1] != e[0]:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = [(e, d, v)]
        else:
            held.append((e, d, v))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def rolling_totals(
    daily: DataFrame,
    end_day: int,
    windows: Sequence[int] = (7, 30),
    keep: Callable[[np.ndarray, dict[int, np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """Totals and averages of trailing windows for each entity and calendar day.

    daily: one row per (entity bigint, day int, value bigint), as `daily_values`
    makes them. Each entity gets a row for every day from its first one to
    ``end_day``; days before the first count as 0 (and have no row, as all of their
    totals are 0). ``keep(value, totals by window)`` may say which rows to return.

    Defined cases: entities or days that are null have no row; days after ``end_day``
    are left out; an empty input gives no row; a null value counts as 0.
    Returns entity, day, value, total_<w>, avg_<w> for each window.
    """
    ship(daily.sparkSession)
    windows = tuple(int(w) for w in windows)
    rows = daily.select(
        F.col("entity").cast("bigint").alias("entity"), F.col("day").cast("int").alias("day"), F.coalesce(F.col("value").cast("bigint"), F.lit(0)).alias("value")
    ).where(F.col("entity").isNotNull() & F.col("day").isNotNull() & (F.col("day") <= F.lit(end_day)))
    rows = rows.repartition("entity").sortWithinPartitions("entity", "day")
    schema = "entity bigint, day int, value bigint, " + ", ".join(f"total_{w} bigint, avg_{w} double" for w in windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entity, day, value in _complete(batches):
            ids, first, at = np.unique(entity, return_index=True, return_inverse=True)
            begins = day[first]
            step = max(1, CELLS // max(1, end_day - int(begins.min()) + 1))
            for lo in range(0, len(ids), step):
                hi = min(len(ids), lo + step)
                own = slice(first[lo], first[hi] if hi < len(ids) else len(entity))
                start = int(begins[lo:hi].min())
                dense = np.zeros((hi - lo, end_day - start + 1), dtype=np.int64)
                np.add.at(dense, (at[own] - lo, day[own] - start), value[own])
                totals = {w: trailing(dense, w) for w in windows}
                want = np.arange(start, end_day + 1)[None, :] >= begins[lo:hi, None]
                if keep is not None:
                    want &= keep(dense, totals)
                r, c = np.nonzero(want)
                if len(r):
                    cols = [pa.array(ids[lo + r]), pa.array((c + start).astype(np.int32)), pa.array(dense[r, c])]
                    for w in windows:
                        t = totals[w][r, c]
                        cols += [pa.array(t), pa.array(t / w)]
                    out = pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])
                    for i in range(0, out.num_rows, 100_000):
                        yield out.slice(i, 100_000)

    return rows.mapInArrow(run, schema)


def daily_values(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Events per entity and day, each event once however often it is delivered.

    events: entity bigint, day int, and the columns of ``key`` that identify an event;
    copies of an event must agree in entity and day. One exchange, on (entity, day):
    it serves the removal of copies and the count, and a hot entity is spread over its days.
    """
    rows = events.where(F.col("entity").isNotNull() & F.col("day").isNotNull()).select("entity", "day", *key)
    return rows.repartition("entity", "day").dropDuplicates(["entity", "day", *key]).groupBy("entity", "day").agg(F.count("*").alias("value"))

"""The core's data-preparation operators on small made-up inputs, against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlake.operators.compaction import Conflict, FileTable
from forumlake.operators.heavy_keys import eager_join_aggregate, key_activity
from forumlake.operators.rolling import daily_values, rolling_totals, trailing
from forumlake.operators.snapshot_diff import peel, snapshot_changes, xxhash64_longs
from forumlake.schema import second
from forumlake.sources.topic_files import normal_path, records, topic_file, topic_records

# -- rolling totals ----------------------------------------------------------


@pytest.mark.parametrize("w", [1, 2, 7, 30])
@pytest.mark.parametrize("days", [0, 1, 6, 7, 8, 61])
def test_trailing_is_the_plain_sum(w, days):
    x = np.random.default_rng(w * 100 + days).integers(0, 5, (4, days))
    want = np.array([[r[max(0, d - w + 1) : d + 1].sum() for d in range(days)] for r in x]).reshape(4, days)
    assert (trailing(x, w) == want).all()


def test_rolling_totals_cases(spark):
    rows = [(1, 10, 2), (1, 12, 1), (1, 12, None), (2, 15, 4), (None, 12, 9), (3, None, 9), (4, 99, 1)]
    got = {(r.entity, r.day): (r.value, r.total_2, r.total_3, r.avg_2) for r in rolling_totals(spark.createDataFrame(rows, "entity bigint, day int, value bigint"), 16, (2, 3)).collect()}
    assert got[1, 10] == (2, 2, 2, 1.0) and got[1, 11] == (0, 2, 2, 1.0) and got[1, 12] == (1, 1, 3, 0.5) and got[1, 13] == (0, 1, 1, 0.5) and got[1, 16] == (0, 0, 0, 0.0)
    assert got[2, 15] == (4, 4, 4, 2.0) and len([k for k in got if k[0] == 1]) == 7 and not [k for k in got if k[0] in (3, 4, None)]


def test_rolling_totals_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "entity bigint, day int, value bigint, total_7 string")
    assert rolling_totals(empty, 5).count() == 0


def test_rolling_totals_many_entities_over_batches(spark):
    rnd = random.Random(1)
    rows = [(e, d, rnd.randint(1, 3)) for e in range(300) for d in sorted(rnd.sample(range(100), 12))]
    df = spark.createDataFrame(rows, "entity bigint, day int, value bigint")
    got = {(r.entity, r.day): r.total_7 for r in rolling_totals(df, 99, (7,)).collect()}
    by = {}
    for e, d, v in rows:
        by.setdefault(e, {})[d] = v
    assert got == {(e, d): sum(by[e].get(x, 0) for x in range(d - 6, d + 1)) for e in by for d in range(min(by[e]), 100)}


def test_daily_values_counts_an_event_once(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 5, "b"), (None, 5, "c"), (2, None, "d"), (2, 6, None)], "entity bigint, day int, k string")
    assert sorted(map(tuple, daily_values(df, ["k"]).collect())) == [(1, 5, 2), (2, 6, 1)]


# -- heavy keys --------------------------------------------------------------


def test_eager_join_equals_join(spark):
    rnd = random.Random(2)
    left = spark.createDataFrame([(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice("ab"), rnd.choice([None, 1, 5, 7])) for _ in range(200)], "k int, g string, v bigint")
    right = spark.createDataFrame([(rnd.choice([1, 2, 2, 4, None]), rnd.choice("xy")) for _ in range(40)], "k int, h string")
    for how in ("inner", "left"):
        j = left.join(right, "k", how).groupBy("g", "h").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        assert sorted(map(str, eager_join_aggregate(left, right, ["k"], ["g", "h"], "v", how).collect())) == sorted(map(str, j.collect()))


def test_key_activity_cases(spark):
    p = [(8, 1, 5, 7, 100), (8, 1, 5, 7, 100), (8, 2, 5, None, 50), (8, 3, 6, 0, None), (10, 1, 5, 7, 200)]
    posts = spark.createDataFrame(p, "type int, id int, mid int, uid bigint, sec bigint")
    topics = spark.createDataFrame([(8, 5), (8, 5)], "type int, id int")
    got = {(r.field, r.type, r.key_id): (r.n_posts, r.first_sec, r.last_sec, r.in_topics) for r in key_activity(posts, topics).collect()}
    assert got == {("uid", 0, 7): (2, 100, 200, None), ("mid", 8, 5): (2, 50, 100, True), ("mid", 8, 6): (1, None, None, False), ("mid", 10, 5): (1, 200, 200, False), ("all", 0, 0): (4, 50, 200, None)}
    none = key_activity(posts.where("false"), topics.where("false")).where("field <> 'all'")
    assert none.count() == 0


def test_second(spark):
    r = spark.createDataFrame([(0,), (None,), (1704038400,), (1704038400123,)], "d bigint").select(second(F.col("d"))).collect()
    assert [x[0] for x in r] == [None, None, 1704038400, 1704038400]


# -- snapshot changes --------------------------------------------------------

SNAP = "snap_ts bigint, type int, id int, mid int, uid bigint, dateline bigint, state int, sid bigint"


def brute(rows):
    by = {}
    for s, *r in rows:
        if s is not None:
            by.setdefault(s, {})[tuple(r[:3])] = tuple(r[3:])
    out, stamps = [], sorted(by)
    for a, b in zip(stamps, stamps[1:], strict=False):
        for k in by[a].keys() | by[b].keys():
            x, y = by[a].get(k), by[b].get(k)
            if x != y:
                out.append((b, *k, "added" if x is None else "removed" if y is None else "changed"))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.snap_ts, r.type, r.id, r.mid, r.change) for r in df.collect()), key=str)


def history(seed, n, churn):
    rnd = random.Random(seed)
    live = {(8, i, i % 7 - 3): (rnd.choice([None, 1, 2]), 5, 0, None) for i in range(n)}
    rows = []
    for s in (10, 20, 30):
        for k in list(live):
            if rnd.random() < churn:
                live.pop(k)
            elif rnd.random() < churn:
                live[k] = (rnd.choice([None, 1, 2]), rnd.choice([None, 5]), rnd.randint(0, 2), rnd.choice([None, 0]))
        for i in range(int(n * churn)):
            live[10, -i - s * 1000, 1] = (1, None, 1, 1)
        rows += [(s, *k, *v) for k, v in live.items()] * 1
    rows += rnd.sample(rows, len(rows) // 10)
    rnd.shuffle(rows)
    return rows


def test_xxhash64_is_spark_s(spark):
    x = [(0, 0, 0), (1, -1, 5), (-(2**63), 2**63 - 1, 12345)]
    want = [r[0] for r in spark.createDataFrame(x, "a bigint, b bigint, c bigint").select(F.xxhash64("a", "b", "c")).collect()]
    a = np.array(x, dtype=np.int64)
    assert xxhash64_longs([a[:, 0], a[:, 1], a[:, 2]]).tolist() == want


@pytest.mark.parametrize(("n", "churn", "cells"), [(50, 0.1, 64), (400, 0.2, 256), (400, 0.9, 64)])
def test_snapshot_changes_equal_brute_force(spark, n, churn, cells):
    """With the smallest tables all buckets fail at first, are enlarged, and at last compared by the join."""
    rows = history(n, n, churn)
    got = snapshot_changes(spark, spark.createDataFrame(rows, SNAP), bucket_rows=100, first_cells=cells, rounds=2)
    assert rows_of(got) == brute(rows)


def test_snapshot_changes_cases(spark):
    rows = [
        (1, 8, 1, 1, 5, 5, 0, 0), (1, 8, 1, 1, 5, 5, 0, 0), (1, 8, 2, 1, None, 5, 0, 0), (1, None, 3, None, 1, 1, 1, 1), (1, 8, 4, 1, None, 7, 0, 0),
        (2, 8, 1, 1, 5, 5, 0, 0), (2, 8, 2, 1, 5, 5, 0, 0), (2, None, 3, None, 1, 1, 1, 2), (2, 8, 4, 1, 7, None, 0, 0),
        (3, 8, 2, 1, 5, 5, 0, 0), (3, None, 3, None, 1, 1, 1, 2), (3, 8, 4, 1, 7, None, 0, 0), (4, 8, 1, 1, 5, 5, 0, 0), (None, 8, 9, 9, 1, 1, 1, 1),
    ]
    df = spark.createDataFrame(rows, SNAP).withColumn("bucket", F.lit("clash"))
    assert rows_of(snapshot_changes(spark, df)) == brute(rows)
    assert snapshot_changes(spark, df.where("snap_ts = 1")).count() == 0
    assert snapshot_changes(spark, df.where("false")).count() == 0


def test_snapshot_changes_of_any_types(spark):
    rows = [("2024-01-01", "a", 1 << 40, "x", 1.5), ("2024-01-01", "b", 1, None, None), ("2024-01-01", None, 2, "z", 0.5), ("2024-01-02", "a", 1 << 40, "y", 1.5), ("2024-01-02", None, 2, "z", 0.5), ("2024-01-02", "c", 1, "", 0.0), ("2024-01-02", "c", 1, "", 0.0)]
    df = spark.createDataFrame(rows, "day string, name string, n bigint, title string, x double").withColumn("day", F.col("day").cast("date"))
    got = snapshot_changes(spark, df, "day", ["name", "n"], ["title", "x"])
    assert got.columns == ["day", "name", "n", "change"] and {str(r.day) for r in got.collect()} == {"2024-01-02"}
    assert sorted((r.name, r.n, r.change) for r in got.collect()) == [("a", 1 << 40, "changed"), ("b", 1, "removed"), ("c", 1, "added")]


def test_peel_reports_an_overfull_table():
    n, cells = 200, 16
    rnd = np.random.default_rng(3)
    k1, k2, v = (rnd.integers(0, 1 << 40, n) for _ in range(3))
    c = xxhash64_longs([k1, k2, v])
    cell = rnd.integers(0, cells, n)
    t = [np.zeros(cells, dtype=np.int64) for _ in range(4)]
    for x, y in zip(t, (k1, k2, v, c), strict=True):
        np.bitwise_xor.at(x, cell, y)
    _, failed = peel(np.zeros(cells, dtype=np.int64), np.arange(cells), np.bincount(cell, minlength=cells), *t, seed=0, cells=cells)
    assert failed.tolist() == [True]


# -- topic files and compaction ----------------------------------------------


def test_topic_file_paths(spark):
    cases = {
        "group/00/10/1009.json": (8, 1009), "./blog//00/10/7.json": (21, 7), "ep\\00\\01\\55.json": (11, 55), "/SUBJECT/1.JSON": (10, 1), "json_repo/../person/3.json.tmp": (200, 3),
        "character/3.json~": (300, 3), "group/5.json ": (8, 5), "group/x/../subject/5.json": None, "group/00/topiclist.txt": None, "blog/7.html": None, "7.json": None, "mygroup/7.json": None,
        "group/a7.json": None, "": None, "group/99999999999.json": None, "a/group/b/7.json": (8, 7),
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string").select("p", topic_file(F.col("p")).alias("t"), normal_path(F.col("p")).alias("n")).collect()
    got = {r.p: tuple(r.t) if r.t else None for r in rows}
    cases["group/x/../subject/5.json"] = (10, 5)
    assert got == cases | {None: None}


REC = '{"id":%d,"user":{"id":%s},"mid":%d,"state":0,"dateline":5}'


def test_records_in_all_writings(spark):
    a, b = REC % (1, "7", 9), REC % (-9, "null", 9)
    bodies = {
        "lines": f"{a}\n{b}\n", "crlf": f"﻿{a}\r\n\r\n{b}", "list": f"[{a}, {b}]", "doc": f'{{"id":9,"space":{{"type":"BLOG"}},"postList":[{a},{b}]}}',
        "indented": '{\n "id": 9,\n "postList": [\n  ' + a.replace(",", ",\n   ").replace(":", " : ") + ",\n " + b + "\n ]\n}",
    }
    for name, body in bodies.items():
        got = spark.createDataFrame([(body,)], "b string").select(F.explode(records(F.col("b"))).alias("r")).select("r.id", "r.user.id").collect()
        assert sorted(map(tuple, got), key=str) == [(-9, None), (1, 7)], name
    for body in ("", "[]", a[:-1], a[:20], '{"id":9,"postList":[]}', "<html>"):
        assert spark.createDataFrame([(body,)], "b string").select(F.explode(records(F.col("b")))).count() == 0
    cut = spark.createDataFrame([(f"[{a},{b[:-3]}",)], "b string").select(F.explode(records(F.col("b"))).alias("r")).select("r.id").collect()
    assert [r[0] for r in cut] == [1]
    long = "\n".join(REC % (i, "1", 9) for i in range(20_000))
    assert spark.createDataFrame([(long,)], "b string").select(F.explode(records(F.col("b")))).count() == 20_000


def test_topic_records_nulls_and_clashes(spark):
    paths = spark.createDataFrame([(1, "group/9.json", "x"), (2, None, "x"), (3, "group/ng.txt", "x"), (4, "blog/9.json", "x")], "id bigint, file_relative_path string, body string")
    files = spark.createDataFrame([(1, None, REC % (1, "7", 9)), (1, 3, REC % (1, "7", 9)), (2, 3, REC % (1, "7", 9)), (3, 3, REC % (1, "7", 9)), (4, 3, None), (5, 3, REC % (1, "7", 9))], "fid bigint, n_bytes bigint, body string")
    assert [tuple(r)[:3] for r in topic_records(paths, files).distinct().collect()] == [(8, 9, 1)]


def file_table(spark, tmp_path):
    return FileTable(spark, str(tmp_path / "t"), "k int, v int, part int", ["part"], ["k"])


def add(spark, t, rows):
    t.append(spark.createDataFrame(rows, "k int, v int, part int").repartition(5))


def names(t, column="n_files"):
    return {t._name(r): r[column] for r in t.files().collect()}


def test_compaction_keeps_each_record_once(spark, tmp_path):
    t = file_table(spark, tmp_path)
    add(spark, t, [(i, i, i % 2) for i in range(100)] + [(i, i, i % 2) for i in range(50)] + [(None, 1, None), (None, 1, None)])
    before = names(t)
    done = t.compact()
    assert done["rows"] == 101 and before["part=0"] > 1 and set(names(t).values()) == {1} and all(names(t, "clean").values())
    assert sorted(map(str, map(tuple, t.read().collect()))) == sorted(map(str, [(i, i, i % 2) for i in range(100)] + [(None, 1, None)]))
    assert t.compact()["rows"] == 0


def test_compaction_leaves_well_sized_partitions(spark, tmp_path):
    """Partitions in one file stay as they are, with the production threshold; their copies go on reading."""
    t = file_table(spark, tmp_path)
    t.append(spark.createDataFrame([(1, 1, 1), (1, 1, 1)], "k int, v int, part int").coalesce(1))
    add(spark, t, [(i, i, 0) for i in range(20)])
    assert t.compact()["parts"] == ["part=0"]
    assert names(t, "gens")["part=1"] == [1] and names(t, "clean") == {"part=0": True, "part=1": False}
    assert t.read().count() == 21


def test_append_during_a_compaction_is_kept(spark, tmp_path):
    """A whole append, between what a compaction reads and what it publishes, and one claimed before and published after."""
    t, other = file_table(spark, tmp_path), file_table(spark, tmp_path)
    add(spark, t, [(i, i, 0) for i in range(20)])
    early = other._claim()
    write = t._write

    def meanwhile(rows, gen):
        add(spark, other, [(100 + i, 1, 0) for i in range(5)] + [(3, 9, 0)])
        write(rows, gen)

    t._write = meanwhile
    t.compact()
    assert names(t, "clean") == {"part=0": False}
    other._write(spark.createDataFrame([(4, 4, 0), (200, 1, 0)], "k int, v int, part int"), early)
    other._list(early)
    other._create(f"done-{early:08d}", "{}")
    keys = sorted(r.k for r in t.read().collect())
    assert keys == sorted([*range(20), *range(100, 105), 200])
    t._write = write
    assert t.compact()["rows"] == 26 and sorted(r.k for r in t.read().collect()) == keys and {r.v for r in t.read().where("k = 3").collect()} == {9}


def test_two_compactions_of_a_snapshot(spark, tmp_path):
    t, other = file_table(spark, tmp_path), file_table(spark, tmp_path)
    add(spark, t, [(i, i, 0) for i in range(20)])
    publish = t._publish

    def late(at, gen):
        assert other.compact()["rows"] == 20
        publish(at, gen)

    t._publish = late
    with pytest.raises(Conflict):
        t.compact()
    assert t.read().count() == 20 and names(t, "clean") == {"part=0": True} and len(t.snapshot().compactions) == 1
    assert not (tmp_path / "t" / "data" / "gen=2").exists()


def test_files_around_the_log_are_noticed(spark, tmp_path):
    t = file_table(spark, tmp_path)
    add(spark, t, [(i, i, 0) for i in range(20)])
    before = t.snapshot()
    stray = spark.createDataFrame([(99, 1)], "k int, v int")
    stray.write.mode("append").parquet(f"{t.data}/gen=1/part=0")
    with pytest.raises(Conflict):
        t.compact()
    assert t.snapshot() == before


def test_readers_keep_their_snapshot(spark, tmp_path):
    t = file_table(spark, tmp_path)
    add(spark, t, [(i, i, 0) for i in range(20)])
    old = t.snapshot()
    rows = t.read(old)
    add(spark, t, [(i, i, 0) for i in range(20, 30)])
    t.compact()
    assert rows.count() == t.read(old).count() == 20 and t.read().count() == 30
    assert len(t.vacuum()) == 2 and t.read().count() == 30 and t.vacuum() == []


def test_dead_writers_count_nothing(spark, tmp_path):
    t = file_table(spark, tmp_path)
    add(spark, t, [(i, i, 0) for i in range(20)])
    dead = t._claim()  # an append that dies before it is published
    t._write(spark.createDataFrame([(77, 1, 0)], "k int, v int, part int"), dead)
    assert t.read().count() == 20 and t.compact()["rows"] == 20
    assert t.vacuum(3600) == ["gen=1/part=0"] and t.vacuum(-1) == [f"gen={dead}"] and t.read().count() == 20
    add(spark, t, [(i, i, 0) for i in range(20, 24)])
    t._create("compact-00000002", "")  # a compaction that dies while it publishes
    at = t.snapshot()
    assert at.place == 2 and len(at.compactions) == 1
    with pytest.raises(Conflict):
        t.compact()
    os.utime(tmp_path / "t" / "_log" / "compact-00000002", (1, 1))  # its lease has run out
    assert t.compact()["rows"] == 24 and t.read().count() == 24


def test_compaction_empty(spark, tmp_path):
    t = file_table(spark, tmp_path)
    assert t.compact()["rows"] == 0 and t.read().count() == 0
    add(spark, t, [])
    assert t.compact()["rows"] == 0 and t.read().count() == 0


def test_compaction_sizes_files_in_rounds(spark, tmp_path):
    t = file_table(spark, tmp_path)
    add(spark, t, [(i, i, i % 2) for i in range(5000)])
    size = names(t, "n_bytes")["part=0"]
    t.compact(target_bytes=size // 4, round_files=2)
    assert all(2 <= n <= 6 for n in names(t).values()) and t.read().count() == 5000

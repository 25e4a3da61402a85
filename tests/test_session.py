"""The session's folders, the spreading of small inputs, and the entry's independence of optional parts."""

import importlib

import pytest

import __spark_entry__ as entry
from forumlake import session


def test_core_queries_survive_a_missing_dependency(monkeypatch):
    real = importlib.import_module

    def no_optional(name, *a):
        if name in entry.OPTIONAL:
            raise ImportError("no module of that kind here")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", no_optional)
    with pytest.warns(UserWarning, match="left out"):
        q = entry.queries()
    assert "p1_found" in q and "p2_found" not in q and "user_stat" in q


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):  # noqa: N802
        return self.folder


class FakeSession:
    def __init__(self, context, conf=None):
        self.sparkContext, self.conf = context, {session.CHECKPOINT_KEY: conf} if conf else {}


def test_shared_dir_takes_the_folder_of_the_cluster():
    assert session.shared_dir(FakeSession(FakeContext("spark://x:7077"), "hdfs://a/b/")) == "hdfs://a/b"
    assert session.shared_dir(FakeSession(FakeContext("spark://x:7077", "hdfs://c/d"))) == "hdfs://c/d"
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(FakeSession(FakeContext("yarn")))
    own = session.shared_dir(FakeSession(c := FakeContext("local[4]")))
    assert own == session.shared_dir(FakeSession(c))


def test_spread_moves_small_inputs_only(spark, sf, monkeypatch):
    df = session.table(spark, sf, "ba_user").select("id")
    assert 0 < session.plan_bytes(df) < session.SPREAD_BYTES
    assert "Exchange" in session.spread(df)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    assert "Exchange" not in session.spread(df)._jdf.queryExecution().executedPlan().toString()


def test_input_bytes_are_not_multiplied_by_joins(spark, sf):
    a, b = (session.table(spark, sf, t) for t in ("ba_user", "ba_topic"))
    one, other = session.input_bytes(a), session.input_bytes(b)
    assert 0 < one and session.input_bytes(a.join(b, a["id"] == b["uid"])) == one + other
    local = spark.createDataFrame([(1,)], "x int")
    assert session.input_bytes(local) < 1 << 60 and session.input_bytes(local.crossJoin(a)) >= one

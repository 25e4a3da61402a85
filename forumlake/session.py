"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "forumlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a session, so that they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_forumlake_shipped", False):
        return
    home = Path(__file__).resolve().parent
    if home.is_dir():  # not when the package itself runs from a zip file
        path = Path(tempfile.mkdtemp(prefix="forumlake-")) / f"forumlake-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, Path(home.name) / f.relative_to(home))
        sc.addPyFile(str(path))
    sc._forumlake_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of an archive root."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session whose master is local (tests, a laptop) makes a private temporary
    folder and uses it for the rest of the session; any other session has no folder that all
    executors see, which is an error.
    """
    sc = spark.sparkContext
    got = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if got:
        return got.rstrip("/")
    own = getattr(sc, "_forumlake_scratch", None)
    if own is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        own = sc._forumlake_scratch = tempfile.mkdtemp(prefix="forumlake-")
    return own


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for a path of any scheme."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone already
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Cut lineage with a table written in the shared folder and read again.

    Unlike a local checkpoint it outlives any executor. The schema is passed on
    the read, so an empty result is read back too.
    """
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, from file sizes; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """The size of all tables that df is made from, as in files; nothing runs. Unlike `plan_bytes` it isn't multiplied up by joins.

    What Spark knows no size of (rows that come from the driver or another process) counts as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


#: Up to so many bytes (as in files) are moved to spread costly work over the cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in several even partitions per core, for costly work per row, if it has at most SPREAD_BYTES.

    A file that is one row group is one task, however costly its rows. The exchange is bounded by
    SPREAD_BYTES on a cluster of any size; a larger input is left as its scan splits it, without an
    exchange. Rows are the same either way.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys) if plan_bytes(df) <= SPREAD_BYTES else df

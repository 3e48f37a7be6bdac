"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_LOCAL_DIRS: list[tempfile.TemporaryDirectory] = []
#: Folders of the written tables, by the identity of their DataFrame.
_TABLES: dict[int, str] = {}


def get_spark(app: str = "pagewright", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGEWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it isn't installed on the machine."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session names none and runs in one process (``local[...]``) is a
    temporary folder made; on a cluster a missing setting is an error, because a
    machine-local folder would lose data with its machine.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.TemporaryDirectory(prefix="pagewright-"))
    return _LOCAL_DIRS[0].name


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage so that later stages never recompute it, survives the loss of
    executors, and keeps the columnar, compressed form (smaller than a row
    checkpoint). The table is removed by ``release`` or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = path
    weakref.finalize(out, _TABLES.pop, id(out), None)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once what was made of them is written; nothing may read them afterwards."""
    for t in tables:
        path = _TABLES.pop(id(t), None)
        if path:
            _delete(t.sparkSession, path)


def broadcaster(table: DataFrame, rows: int) -> Callable[[DataFrame], DataFrame]:
    """``broadcast`` if a written table has no more than ``rows`` rows, else what leaves its joins to shuffles. Counting a written table costs next to nothing."""
    return F.broadcast if table.limit(rows + 1).count() <= rows else lambda df: df

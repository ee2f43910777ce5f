"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "lathework") -> SparkSession:
    """A single-machine session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one named in ``spark.checkpoint.dir``.

    A temporary one is made where a single-machine session names none; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lathework-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        atexit.register(_remove, spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage; the files go with the session."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stow(df: DataFrame, name: str = "table") -> DataFrame:
    """Like ``settle`` for wide rows: a compressed, column-pruned table in the same shared folder.

    The table is removed when the session's Python ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's Python ends."""
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a settled table, marked for broadcast where it has at most ``rows`` rows; else as it is, and Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has gone, and its folder with it
        pass

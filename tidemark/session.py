"""Session helpers.  The cluster's own settings always win over ours."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

AT_ONCE = 8  # calls that wait for their jobs side by side


def local_session(cores: int | str = "*", app: str = "tidemark", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC; day boundaries must not depend on the host."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a temporary one only in local mode, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        sc.setCheckpointDir(current)
    return current


def _own_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name below this application's part of the shared checkpoint folder."""
    return f"{_own_folder(spark)}/{kind}/{uuid.uuid4().hex}"


_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame that several queries over the folder ``source`` use, staged once until ``clear_scratch``."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _kept:
        _kept[key] = stage(make())
    return _kept[key]


def known(spark: SparkSession, name: str, source: str) -> bool:
    """Whether ``kept`` has the frame."""
    return (spark.sparkContext.applicationId, name, source) in _kept


def clear_scratch(spark: SparkSession) -> None:
    """Remove all folders this application staged; call it when no frame that reads them is in use any more."""
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        del _kept[key]
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def at_once(*calls: Callable[[], object]) -> list:
    """The results of calls that each wait for jobs of their own, run side by side on the driver."""
    inherits = inheritable_thread_target(SparkSession.active())  # job groups and the like
    with ThreadPoolExecutor(max(1, min(len(calls), AT_ONCE))) as pool:
        return [x.result() for x in [pool.submit(inherits(call)) for call in calls]]


def stage(df: DataFrame) -> DataFrame:
    """Write a frame that several branches of a plan reuse and read it back.

    The table lies in the shared checkpoint folder, so a lost executor re-reads it instead of
    recomputing the lineage, and every consumer gets column pruning and file statistics.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)

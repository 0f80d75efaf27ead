"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "sensorgate", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the session given by spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SENSORGATE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Sensor clocks are naive local times; hour and day arithmetic must not shift with the host zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if not getattr(sc, "_sensorgate_shipped", False):
        here = Path(__file__).parent
        base = Path(tempfile.mkdtemp(prefix="sensorgate-")) / "sensorgate_code"
        sc.addPyFile(shutil.make_archive(str(base), "zip", here.parent, here.name))
        sc._sensorgate_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that every executor can read: the cluster's spark.checkpoint.dir, or a temporary one in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    root = root or getattr(sc, "_sensorgate_scratch", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = sc._sensorgate_scratch = tempfile.mkdtemp(prefix="sensorgate-")
    return root.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path there, with its scheme: tasks that open files themselves reach the same file system as Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def clean_scratch(spark: SparkSession) -> None:
    """Remove what this application has stored; frames that read it are of no use afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(conf).delete(path, True)


def cut_lineage(df):
    """Store as Parquet in the shared folder and read back.

    Like a reliable checkpoint it survives the loss of executors; unlike one it is read column by column, with filters
    pushed down and statistics on disk.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

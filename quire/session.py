"""Session settings and storage helpers shared by all operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quire", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for one machine, as used by tests and the benchmark."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; without that an error is raised there. On one
    machine, as in tests, a temporary folder of this machine is set and returned. The folder of
    this application is removed when it ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
        path = spark._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return sc._jsc.sc().getCheckpointDir().get()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The archive is served to the executors by the driver, so its place need not be shared.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quire-"), package.name), "zip", package.parent, package.name)
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


def shipped(df: DataFrame) -> DataFrame:
    """``df`` itself, for a stage in Python: this package is shipped to the workers first."""
    ship_package(df.sparkSession)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a frame that reads it.

    Used where a result is read more than once or its lineage would be recomputed; the files
    survive the loss of executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame that reads it.

    Like :func:`cut`, for larger frames of which columns repeat their values or not all are read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Mark a small, cheaply recomputable frame for reuse on memory and disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

"""Session helpers: a local session for tests and benches, and the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "registra", work: str | None = None) -> SparkSession:
    """A single-machine session. A cluster brings its own session and settings.

    ``work`` is the folder for what is written between steps, as ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder if work is None else SparkSession.builder.config("spark.checkpoint.dir", work)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REGISTRA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package() -> None:
    """Send the package's own functions along with tasks, so executors need not have it installed."""
    from pyspark import cloudpickle

    import registra

    cloudpickle.register_pickle_by_value(registra)


def work_dir(spark: SparkSession) -> str:
    """The folder that holds what this application writes between steps.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``; where that is unset, in the
    warehouse, unless that is a local folder of a cluster, which its executors do not share. Never in
    a machine's temporary folder.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        parent = spark.conf.get("spark.sql.warehouse.dir")
        if parent.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{parent} is local to each machine: set spark.checkpoint.dir to a shared folder")
    return f"{parent.rstrip('/')}/registra-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in any store that Spark reaches."""
    where, store = _place(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark reaches."""
    where, store = _place(spark, path)
    store.delete(where, True)


def clear_work(spark: SparkSession) -> None:
    """Delete what this application wrote between steps. Frames that still read it end with this."""
    remove(spark, work_dir(spark))

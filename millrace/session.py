"""Session factory and the helpers that depend on session settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    The folder is the one all executors share (``spark.checkpoint.dir``). Where a local session names
    none, as in tests, a temporary one is set that goes with the process; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="millrace-checkpoints-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def rows_within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than it needs to tell, and the driver gets one number."""
    return df.limit(bound + 1).count() <= bound


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, unless the environment's PYTHONPATH already does.

    The package goes as one archive through the context, once.
    """
    import millrace

    package = os.path.dirname(os.path.abspath(millrace.__file__))
    context = spark.sparkContext
    on_path = os.path.dirname(package) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if on_path or not os.path.isdir(package) or getattr(context, "_millrace_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="millrace-")
    archive = shutil.make_archive(os.path.join(folder, "millrace_package"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._millrace_shipped = True

"""Session defaults for local runs; on a cluster pass your own session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a running session, where it isn't installed there; once per session.

    The same as `spark-submit --py-files sparktab.zip`, with the zip made here.
    """
    base = os.path.join(tempfile.mkdtemp(prefix="sparktab-"), "sparktab")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", ROOT, "sparktab"))


def local_session(cpus: int | str = "*", memory: str = "12g", **conf) -> SparkSession:
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:  # the workers start with this environment, from any folder
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sparktab")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Spark session used by tests, bench and scripts (a cluster brings its own)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("evidentry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give this package to all executors, so that Python workers can import it.

    Once per Spark context: the package is zipped on the driver and served by it. Needed
    when executors have no copy of their own and the driver's working folder is another one.
    """
    import os
    import shutil
    import tempfile

    context = spark.sparkContext
    if getattr(context, "_evidentry_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    base = os.path.join(tempfile.mkdtemp(prefix="evidentry-package-"), name)
    stage = tempfile.mkdtemp(prefix="evidentry-stage-")
    shutil.copytree(here, os.path.join(stage, name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(base, "zip", stage, name))
    context._evidentry_shipped = True

"""Session settings that the engine relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and pin the session settings that results depend on.

    On a cluster the package is installed or shipped with the job; the path only matters where it is run from a checkout.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # texts can be long: what a Python worker takes at a time is bounded by rows and by bytes
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    return spark

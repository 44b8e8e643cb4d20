"""Sessions: defaults for a new one, and the package's path for the Python workers of any."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def with_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did, if they can see that folder. On a cluster the
    package is installed or sent with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    return spark


def session(name: str = "clademill", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; whatever conf or spark-submit sets stays."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return with_package(builder.getOrCreate())

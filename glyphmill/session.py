"""Session factory: UTC, ANSI, AQE with skew handling, Arrow batches of a bounded size."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "glyphmill", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the defaults above; ``conf`` keys use ``__`` for dots."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    b = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

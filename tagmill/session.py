"""Session factory for scripts and tests; on a cluster, pass the session that is there."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tagmill", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """Local session with adaptive execution on, UTC and few shuffle partitions."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

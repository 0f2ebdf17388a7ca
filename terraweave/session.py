"""Session defaults for local runs; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "terraweave", cpus: int | None = None, **conf: str) -> SparkSession:
    """The active session, or a local one with adaptive execution and UTC time."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

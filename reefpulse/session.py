"""Session set-up and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "reefpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    No operator in this package uses a broadcast hint: a side is broadcast only
    when Catalyst or AQE finds it under ``spark.sql.autoBroadcastJoinThreshold``,
    and joined by shuffle (with AQE skew splitting) beyond it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Listing many folders takes tasks by the dozen, not one per folder.
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, label: str, root: str | None = None) -> str:
    """A new folder name under ``root``, by default the cluster's ``spark.checkpoint.dir``.

    Both name storage that every executor can reach; where neither is given, the
    warehouse folder takes their place.
    """
    root = (
        root
        or spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{root.rstrip('/')}/reefpulse-{label}-{uuid.uuid4().hex}"

"""Session helpers: time zone, checkpoint folder, local test sessions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Event time is stored and compared in UTC; all window boundaries assume it.
EVENT_TIME_ZONE = "UTC"


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone so casts between TIMESTAMP_NTZ and TIMESTAMP,
    day windows and ISO text are the same on every executor."""
    if spark.conf.get("spark.sql.session.timeZone", None) != EVENT_TIME_ZONE:
        spark.conf.set("spark.sql.session.timeZone", EVENT_TIME_ZONE)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent and the master is ``local`` (tests) a scratch
    folder is made and registered; on a cluster its absence is an error, as executors
    would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="driftwise-ckpt-", dir=os.environ.get("DRIFTWISE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def local_session(cores: int = 8, partitions: int = 8, app: str = "driftwise") -> SparkSession:
    """Session for tests and the local bench (no UI, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", EVENT_TIME_ZONE)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Session helpers: a configured local session for tests and benches, and the
checkpoint-directory rule used by operators that cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are written for. On a cluster they belong in the
# cluster's spark-defaults; ``local_session`` applies them for tests and benches.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoints (NTILE tags, RFM customer table, cohort long form, hot sessions) are
    # removed once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    # The Python call site of every column expression, for error messages, costs
    # a walk up the stack each time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """A ``local[cores]`` session with the recommended settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(
        shuffle_partitions or (os.cpu_count() if cores == "*" else cores))
    conf["spark.driver.memory"] = driver_memory
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    The cluster's setting (``spark.checkpoint.dir`` or ``setCheckpointDir``)
    always wins. Only a local-mode session without one gets a fresh scratch
    folder; on a cluster a machine-local folder would not survive executor
    loss, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared, reliable folder")

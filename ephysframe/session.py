"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(
    master: str | None = None,
    app_name: str = "ephysframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    shuffle partition count is then left to AQE's coalescing, which sizes
    partitions from runtime statistics instead of a fixed number.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # broadcast decided on the MEASURED size of a finished shuffle stage
        # (the static threshold, which trusts plan estimates, stays default)
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Only in local mode with nothing
    set (tests) do we create one; on a cluster an unset folder is an error,
    so no job ever writes to a machine-local folder that another executor
    cannot see.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a shared folder (HDFS, object store) for checkpoints")
    local = tempfile.mkdtemp(prefix="ephysframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local

"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local a temporary folder
    is made; on a cluster a machine-local folder would be unreadable elsewhere,
    so that case raises.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="glyphmill-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def python_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle before a Python stage.

    The session's number of shuffle partitions, stated so that adaptive execution
    does not merge partitions that are small in bytes but slow in Python.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

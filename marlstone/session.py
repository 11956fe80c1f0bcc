"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share, or the one set on the context.

    Without either a session in one process gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor doesn't bring its whole history back."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """How many partitions a shuffle has under the session's settings."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in at least as many partitions as there are cores, by a hash of `key`.

    Only an input of few files is moved, which is small; one that already keeps all cores busy stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

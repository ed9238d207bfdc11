"""Lineage cuts in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or that given to ``setCheckpointDir``.

    A session on one machine that names none gets a local one. Any other must name one, as
    a local folder would be a different one on each machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    given = sc._jsc.sc().getCheckpointDir()
    if named is None and not given.isEmpty():
        return given.get()
    if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    if given.isEmpty():
        sc.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return named or LOCAL_CHECKPOINTS


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Hint a broadcast where the counted ``rows`` fit ``max_rows``; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over a fixed number of tasks, which the adaptive planner leaves alone.

    For rows that weigh little as bytes and much as work or as hash tables: coalesced by
    bytes they land in a few large tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)

"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a folder of its own; on a cluster that would be a folder
    which executors cannot share, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for state that a job writes and reads again."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint ``df``: it survives lost executors and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, waves: int = 2) -> DataFrame:
    """Give CPU-heavy row-wise work enough tasks when the input has fewer splits than the cluster has cores.

    An input of more splits than cores, which is every large one, is returned as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * waves)

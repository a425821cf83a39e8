"""Reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may have one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing has been written to."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession, again: int = 0) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more; Spark removes them when they are collected.

    again: more rounds, after a pause each. The plan that ran last is still referred to until listeners have heard of its end.
    """
    for i in range(1 + again):
        time.sleep(1 if i else 0)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df as a Parquet table in that folder: lineage is cut as by `cut`, in less space; partitions aren't those of df any more."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

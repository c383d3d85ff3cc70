"""Cutting lineage: compute once, and let nothing that follows depend on an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share. Only a local session may get one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="phenospark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The table, computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as Parquet, for what goes round a loop: a checkpoint keeps the sizes that its plan was estimated at, and these multiply
    with every join of a round; a table that is read has its own."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() has made; nothing may read it any more."""
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

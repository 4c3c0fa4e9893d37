"""Intermediate tables of the operators, in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/rolesift-shared"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a fixed folder on a local master, as in tests,
    and an error on a cluster, whose machines share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_FOLDER)
    return LOCAL_FOLDER


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark deletes the files of a shuffle once the driver has no more reference to it, which it only
    notices when it collects its garbage. An iterative operator would pile them up until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several steps read, and read it back: this cuts the lineage and lost
    executors cost no more than the tasks they ran."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    df.write.parquet(path)
    del df
    free_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that no step still to come reads; other results stay."""
    path = getattr(df, "_staged_path", None)
    if path:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

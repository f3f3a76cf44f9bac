"""Tables that a job writes once and reads several times, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from palisade.session import SPLIT_BYTES


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/palisade-{name}-{uuid.uuid4().hex}"


def write_splittable(df: DataFrame, path: str) -> None:
    """Row groups no larger than a split, as a task reads whole row groups."""
    df.write.option("parquet.block.size", SPLIT_BYTES).parquet(path)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it again: the plan before it ends here, and a lost executor costs only its tasks."""
    path = new_folder(df.sparkSession, name)
    write_splittable(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables between two steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder of a local session; on a cluster nobody else could read one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_provenmark_tables", None) or tempfile.mkdtemp(prefix="provenmark-")
        spark.sparkContext._provenmark_tables = found
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table and read it again: what stands above is computed once, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

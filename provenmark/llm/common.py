"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`, used throughout.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in a local session where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_provenmark_shared", None) or tempfile.mkdtemp(prefix="provenmark-")
        spark.sparkContext._provenmark_shared = found
    return found.rstrip("/")


def cut_for_now(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """cut(), and a function that removes the table: for tables that nothing reads once the next ones are written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/provenmark/{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), drop


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    return cut_for_now(df)[0]


def with_digest_key(df: DataFrame, text: str = "text") -> Column:
    """128 bits of a text as a sortable string: equal texts, equal keys."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")

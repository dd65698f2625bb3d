"""Streams over growing tables: followed by schema, folded by key into tables under the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest
from ..sources.tables import new_folder, shared_folder
from .versions import Versions


def follow(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet folder (or one file by its name in the folder) as a stream; the checkpoint of its sink says where it goes on."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")


def progress(rows: DataFrame) -> DataFrame:
    """Counts by kind and the last event of each."""
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def _folder(spark: SparkSession, name: str | None) -> str:
    """A stream's folder: by its name, so that a driver that starts anew goes on there, or a new one."""
    return f"{shared_folder(spark)}/streams/{name}" if name else new_folder(spark, "streams")


def drained(rows: DataFrame, mode: str, name: str | None = None) -> DataFrame:
    """Run a stream over all that is there now; its result as a table. With a name, the next call goes on where this one ended.

    Appended rows go to a parquet sink. A complete result is a new version that takes the place of the one before in one step. Nothing
    comes to the driver.
    """
    spark = rows.sparkSession
    folder = _folder(spark, name)
    out, state = f"{folder}/rows", f"{folder}/checkpoint"
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(rows.schema).parquet(out)
    versions = Versions(spark, out)
    writer.foreachBatch(lambda df, epoch: versions.replace(epoch, "rows", df)).start().awaitTermination()
    return versions.read("rows", rows.schema)


def latest_state(rows: DataFrame, keys: list[str], order: str, name: str | None = None) -> DataFrame:
    """The last row of each key. A batch rewrites the buckets of the keys it holds and makes a new version; a batch that runs again finds
    its version there. With a name, the next call goes on where this one ended."""
    spark = rows.sparkSession
    folder = _folder(spark, name)
    versions = Versions(spark, f"{folder}/state")
    last = lambda both: latest(both, keys, [F.col(order)])
    rows.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(
        lambda df, epoch: versions.advance(epoch, {"rows": (df, keys, last)})
    ).start().awaitTermination()
    return versions.read("rows", rows.schema)


def distinct(rows: DataFrame, keys: list[str], at: str, delay: str = "40 days") -> DataFrame:
    """The first arrival of each key. State is kept for `delay` behind the newest row, so it does not grow for ever; the delay says
    how far apart copies may come."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def bursts(rows: DataFrame, limit: int = 5) -> DataFrame:
    """T5: addresses with so many failures in a sliding five minutes; late rows up to ten minutes count."""
    failed = rows.where("type = 'login_failed'").withWatermark("ts", "10 minutes")
    return failed.groupBy(F.window("ts", "300 seconds", "60 seconds").alias("w"), "address").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)


def stale(beats: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """T4: sessions of heartbeats(run, ts) that have ended: the run was interrupted after its last beat."""
    return beats.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("s"), "run").agg(
        F.max("ts").alias("last_beat"),
        F.count(F.lit(1)).alias("beats"),
    )


def corrected(results: DataFrame, apply, folder: str) -> DataFrame:
    """Each batch of new results goes through apply(df), the rules as they are then, to the table of corrected ones."""
    spark = results.sparkSession
    results.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(
        lambda df, epoch: apply(df).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")
    ).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")

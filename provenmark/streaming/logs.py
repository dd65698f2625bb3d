"""Logs of runs that grow while they are read. Each poll takes the whole lines that are new and folds them into tables; where it
stands is part of the same version as the tables, so a driver that starts anew goes on without losing or repeating a line."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import structure
from .versions import Versions

OFFSETS = StructType([StructField("file", StringType()), StructField("at", LongType())])
_SEQ = "struct<t:double,at:bigint>"
#: What is known of a file: the last listing, result, publication and activity, each with its place in the log.
STATE = f"room string, rel string, listed struct<seq:{_SEQ},size:bigint>, result struct<seq:{_SEQ},outcome:string,accuracy:double>, published {_SEQ}, act struct<seq:{_SEQ},type:string>"


def new_lines(spark: SparkSession, logs: str, offsets: DataFrame) -> DataFrame:
    """logs, a folder or pattern of text files, and offsets(file, at) to the lines behind the offsets that have their line feed: (file, at, value),
    `at` the bytes up to the line's end. Files that have not grown are not read.

    The driver sees the names of files that have grown, as it does in any file source; lines stay where they are. A line's place is
    the bytes of the splits before it and of the lines before it in its split.
    """
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(logs).select(F.col("path").alias("file"), "length")  # names and sizes only
    grown = [r[0] for r in there.join(offsets, "file", "left").where("length > coalesce(at, 0)").select("file").collect()]
    if not grown:
        return spark.createDataFrame([], "file string, at long, value string")
    lines = spark.read.option("lineSep", "\n").text(grown).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
    )
    bytes_ = (F.octet_length("value") + 1).cast("long")
    splits = lines.groupBy("file", "split").agg(F.sum(bytes_).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = lines.withColumn("end", F.sum(bytes_).over(Window.partitionBy("file", "split").orderBy("id")))
    placed = ends.join(splits.select("file", "split", before.alias("before")), ["file", "split"]).withColumn("at", F.col("before") + F.col("end"))
    known = placed.join(offsets.withColumnRenamed("at", "done"), "file", "left")
    fresh = known.where((F.col("at") > F.coalesce("done", F.lit(0))) & (F.col("at") <= F.col("size")))
    return fresh.select("file", "at", F.regexp_replace("value", r"\r$", "").alias("value"))


def states_of(events: DataFrame) -> DataFrame:
    """events(room, seq, type, rel, size, outcome, accuracy, files) to what they say of each file; the room itself is the file without a name."""
    kind, seq = F.col("type"), F.col("seq")
    listing = events.where("type = 'listing'")
    listed = listing.select("room", "seq", F.explode("files").alias("f")).select(
        "room",
        F.col("f.rel").alias("rel"),
        F.struct("seq", F.col("f.size").alias("size")).alias("listed"),
    )
    listed = listed.unionByName(listing.select("room", F.lit("").alias("rel"), F.struct("seq", F.lit(None).cast("bigint").alias("size")).alias("listed")))
    said = events.where("type <> 'listing' AND rel IS NOT NULL").select(
        "room", "rel", F.when(kind == "file", F.struct("seq", "outcome", "accuracy")).alias("result"), F.when(kind == "published", seq).alias("published"), F.struct("seq", "type").alias("act")
    )
    return merged(listed.unionByName(said, allowMissingColumns=True)).select(
        *[F.col(c).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in STATE.split(", "))]
    )


def merged(states: DataFrame) -> DataFrame:
    """The last of each, whatever the order in which parts come together."""
    return states.groupBy("room", "rel").agg(*[F.max(c).alias(c) for c in ("listed", "result", "published", "act")])


def files_of(states: DataFrame) -> DataFrame:
    """States to the files of each room, as structure.files_from_events() has them from the whole log."""
    last = states.where("rel = ''").select("room", F.col("listed.seq").alias("last"))
    files = states.where(
        "rel <> '' AND (listed IS NOT NULL OR result IS NOT NULL)"
    ).join(last, "room", "left").where("result.outcome IS NOT NULL OR listed.seq = last")
    confirmed = F.coalesce((F.col("published") > F.col("result.seq")) | (F.col("published").isNotNull() & F.col("result").isNull()), F.lit(False))
    return files.select(
        "room",
        "rel",
        "listed.size",
        F.when(F.col("act.type") == "start", "processing").alias("activity"),
        "result.outcome",
        "result.accuracy",
        confirmed.alias("confirmed"),
    )


class Follower:
    """Follows the logs of runs (JSON lines; `room` finds a file's room in its path, by default its name) into the table of files, kept under
    `folder`. A listing may come in parts that bear one time."""

    def __init__(self, spark: SparkSession, logs: str, folder: str, room: str = r"([^/]+?)(?:\.[^./]*)?$"):
        self.spark, self.logs, self.room, self.versions = spark, logs, room, Versions(spark, folder)
        self.state_schema = spark.createDataFrame([], STATE).schema

    def poll(self) -> bool:
        """Take in what is new; False if nothing is. A poll that breaks off leaves the version before, and the next one does its work."""
        have = self.versions.numbers()
        offsets = self.versions.read("offsets", OFFSETS)
        lines = new_lines(self.spark, self.logs, offsets).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if lines.isEmpty():
                return False
            room = F.regexp_extract("file", self.room, 1)
            events = structure.events(lines.select(room.alias("room"), "at", "value")).withColumn(
                "seq",
                F.struct("t", F.when(F.col("type") == "listing", F.lit(0).cast("long")).otherwise(F.col("at")).alias("at")),
            )
            stands = lines.groupBy("file").agg(F.max("at").alias("at"))
            last = lambda rows: rows.groupBy("file").agg(F.max("at").alias("at"))
            return self.versions.advance(
                (have[-1] if have else -1) + 1,
                {"files": (states_of(events), ["room", "rel"], merged), "offsets": (stands, ["file"], last)},
            )
        finally:
            lines.unpersist()

    def files(self) -> DataFrame:
        return files_of(self.versions.read("files", self.state_schema))

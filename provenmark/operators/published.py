"""Versions of a published tree: what is live, what a run replaced, and what accepted documents would replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(publications: DataFrame, rolled_back: DataFrame | None) -> DataFrame:
    """The last version of each path, one that takes it out too."""
    rows = publications if rolled_back is None else publications.join(rolled_back.select("run").distinct(), "run", "left_anti")
    return rows.groupBy("path").agg(F.max_by(F.struct("document", "run", "hash"), "seq").alias("v")).select("path", "v.*")


def live_tree(publications: DataFrame, rolled_back: DataFrame | None = None) -> DataFrame:
    """publications(run, seq, document, path, hash; a null hash takes a path out) to the live (path, document, run, hash): the last version of
    each path of runs that are not rolled_back(run). Earlier versions are the archive; nothing is ever overwritten."""
    return _last(publications, rolled_back).where("hash IS NOT NULL")


def rollback(publications: DataFrame, ledger: DataFrame, run, rolled_back: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M9: take a run out. (path, document, action, run, hash): `restore` what it replaced or took out, with the run that it comes back from, or
    `remove` what it brought; paths that a later run has written stay. And ledger(document, run, ...) without the documents whose last
    entry is that run's, so that they are done again."""
    gone = publications.where(F.col("run") == run).select("run").distinct()
    without = gone if rolled_back is None else rolled_back.select("run").unionByName(gone).distinct()
    now = _last(publications, rolled_back).where(F.col("run") == run).select("path", "document", F.col("hash").alias("was"))
    then = live_tree(publications, without).select("path", "run", "hash")
    met = now.join(then, "path", "left").where("was IS NOT NULL OR hash IS NOT NULL")
    return met.select(
        "path",
        "document",
        F.when(F.col("hash").isNull(), "remove").otherwise("restore").alias("action"),
        "run",
        "hash",
    ), ledger.where(F.col("run") != run)


def folders(paths: DataFrame) -> DataFrame:
    """paths(path) to all folders above them, each once."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("folder")).distinct()


def impact(keys: DataFrame, live: DataFrame) -> DataFrame:
    """keys(key) of accepted documents with `replaces`: whether a live path or one of the folders above live paths is that key, whatever
    the case. Live paths meet keys through their folders, by an equi-join."""
    low = live.select(F.lower("path").alias("path"))
    taken = low.select(F.col("path").alias("k")).unionByName(folders(low).select(F.col("folder").alias("k"))).distinct().withColumn("hit", F.lit(True))
    asked = keys.withColumn("k", F.lower(F.regexp_replace("key", "^/+|/+$", "")))
    return asked.join(taken, "k", "left").select(*keys.columns, F.coalesce("hit", F.lit(False)).alias("replaces"))

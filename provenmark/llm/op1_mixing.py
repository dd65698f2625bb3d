"""Mixing sources to target weights by Sainte-Laguë apportionment [native].

1. Size of every document; one written table of (doc_id, source, size, order keys), which all later steps read.
2. Targets: weights share `share` of all tokens; a target stops at `most` times its source's size and the excess is shared again
   by weight. The fixed point is found by one pass over the sources sorted by cap over weight.
3. Blocks of `block` tokens go to sources by the highest quotients target / (2 q + 1), and each source's blocks to its shards in
   the same way. Seats that a source has for certain are counted, only the last few quotients are compared, so the work is
   linear in sources and shards, not in blocks.
4. In each shard the documents stand in a seeded order, which is a stream of blocks: whole passes first, then the leading blocks.

Shards hold about `shard_docs` documents whatever the source's size, so a source with a third of all rows is many windows.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source, last in order; an empty table gives an empty
result; repeated rows are separate rows, each with its own size; a null doc_id is an ordinary value in the seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 8
SHARD_DOCS = 20_000
SEED = 20_261


def apportion(rows: DataFrame, group: list[str], weight: str, seats: str, order: list[Column], key: list[str]) -> DataFrame:
    """Sainte-Laguë: (group, key) rows with a weight and the group's seats, to the same rows with their `quota`.

    A quota differs from seats * weight / total by less than half the rows' number in proportion to the weight, plus one; so
    all seats under that bound are given at once, and the rest by rank of quotients. Rows of weight 0 get none.
    """
    whole = Window.partitionBy(*group)
    counted = (
        rows.withColumn("__k", F.count(F.lit(1)).over(whole))
        .withColumn("__share", F.col(weight) / F.greatest(F.sum(weight).over(whole), F.lit(1e-12)))
        .withColumn("__q0", F.greatest(F.lit(0), F.floor(F.col(seats) * F.col("__share") - F.col("__share") * F.col("__k") / 2 - 1)).cast("long"))
        .withColumn("__rest", F.col(seats) - F.sum("__q0").over(whole))
    )
    tries = counted.withColumn("__j", F.explode(F.when(F.col(weight) > 0, F.sequence(F.col("__q0"), F.col("__q0") + F.ceil(F.col("__share") * F.col("__k") + 3))).otherwise(F.array(F.lit(-1).cast("long")))))
    ranked = tries.withColumn("__quotient", F.when(F.col("__j") >= 0, F.col(weight) / (2 * F.col("__j") + 1)).otherwise(F.lit(-1.0))).withColumn(
        "__rank", F.row_number().over(whole.orderBy(F.col("__quotient").desc(), *order))
    )
    won = (F.col("__rank") <= F.col("__rest")) & (F.col("__j") >= 0)
    keep = [F.first(c, ignorenulls=False).alias(c) for c in rows.columns if c not in group + key]
    return ranked.groupBy(*group, *key).agg(*keep, (F.first("__q0") + F.sum(won.cast("long"))).alias("quota"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) to the same with weight and target. The table has a row a source, never a row a document."""
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__nr") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("__nr", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("__cap", F.lit(float(most)) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    by_ratio = every.orderBy("__ratio", "__nr")
    level = ranked.withColumn("__place", F.row_number().over(by_ratio)).withColumn(
        "__level",
        (F.lit(float(share)) * F.sum("source_size").over(every) - F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__cap"))
        / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    )
    free = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__place", "__level"))).over(every)
    return level.withColumn("target", F.least(F.col("__cap"), F.coalesce(free["__level"] * F.col("weight"), F.col("__cap")))).select("source", "source_size", "n_docs", "weight", "target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source) to doc_id, source, size, source_size, target, taken; one row a row."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("seeded")))
    sources = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, most))
    seats = sources.withColumn("__all", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    quota = apportion(seats, ["__all"], "target", "seats", [F.col("source").asc_nulls_last()], ["source"])
    quota = cut(quota.select("source", "source_size", "target", F.col("quota").alias("seats"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long").alias("n_shards")))
    # as many rows as sources: Spark broadcasts it under its own threshold and shuffles beyond
    placed = sizes.join(quota.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("shard", F.pmod(F.xxhash64("seeded", F.lit(7)), F.col("n_shards")))
    shards = placed.groupBy("__source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    shards = cut(apportion(shards, ["__source"], "shard_size", "seats", [F.col("shard")], ["shard"]).select(F.col("__source").alias("s"), F.col("shard").alias("h"), "shard_size", "quota"))
    rows = placed.join(shards, F.col("__source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")), "left")
    before = F.sum("size").over(Window.partitionBy("__source", "shard").orderBy("seeded", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    tokens = F.least(F.col("quota") * block, F.col("shard_size") * most)
    passes = F.when(F.col("shard_size") > 0, F.floor(tokens / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.coalesce(tokens, F.lit(0)) - passes * F.coalesce(F.col("shard_size"), F.lit(0))
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "seeded")


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

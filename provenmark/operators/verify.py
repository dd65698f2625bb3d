"""Checks on pages, tables and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .state import numbered


def sections(lines: DataFrame, is_heading: Column) -> DataFrame:
    """lines(rel, n, …) with the running number of their section."""
    return lines.withColumn("section", F.sum(is_heading.cast("long")).over(Window.partitionBy("rel").orderBy("n")))


def cell_check(src: DataFrame, md: DataFrame, table_key: list[str]) -> DataFrame:
    """cells(table…, r, c, v) of both sides: number of cells and of places whose keys differ, by table."""
    at = [*table_key, "r", "c"]
    both = src.withColumnRenamed("v", "a").join(md.withColumnRenamed("v", "b"), at, "full")
    return both.groupBy(*table_key).agg(F.count(F.lit(1)).alias("cells"), F.count_if(text.cell_key("a") != text.cell_key("b")).alias("mismatches"))


def band_key(c: str) -> Column:
    """A line as it compares across pages: digits are one mark."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\d", "#")


def running_lines(lines: DataFrame, least: int) -> DataFrame:
    """(doc, key, pages) of band lines(doc, page, y, text) on at least so many pages, with three letters or more."""
    keyed = lines.withColumn("key", band_key("text")).where(F.length(F.regexp_replace("key", "[^a-z]", "")) >= 3)
    return keyed.select("doc", "key", "page").distinct().groupBy("doc", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)


def even_sample(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Every (n // k)-th row of a group, the first k of them."""
    size = rows.groupBy(group).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / k)).alias("__step"))
    placed = numbered(rows, [group], [order], "__no").join(size, group)
    return placed.where("(__no - 1) % __step = 0 AND __no - 1 < __step * " + str(k)).drop("__no", "__step")


def back_steps(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Entries of a list and how often a value falls below the one before; neighbours meet by their number."""
    placed = numbered(rows, [group], [order], "__no").select(group, value, "__no")
    before = placed.select(group, (F.col("__no") + 1).alias("__no"), F.col(value).alias("__before"))
    met = placed.join(before, [group, "__no"], "left")
    return met.groupBy(group).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col(value) < F.col("__before")).alias("back_steps"))


def pack(units: Column, limit: int) -> Column:
    """Runs of consecutive units (n, size) up to a size limit; a unit over it stands alone.

    The fold keeps the size of the open run and grows a list only where a new one begins; sums come afterwards.
    """
    begin = F.struct(F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("starts"))
    numbered_units = F.transform(units, lambda u, i: F.struct(i.alias("i"), u["size"].cast("long").alias("size")))

    def step(acc, u):
        fits = (F.size(acc["starts"]) > 0) & (acc["size"] + u["size"] <= limit)
        return F.struct(
            F.when(fits, acc["size"] + u["size"]).otherwise(u["size"]).alias("size"),
            F.when(fits, acc["starts"]).otherwise(F.array_append(acc["starts"], u["i"])).alias("starts"),
        )

    starts = F.aggregate(numbered_units, begin, step)["starts"]

    def part(s, i):
        end = F.coalesce(F.get(starts, i + 1), F.size(units))
        own = F.slice(units, s + 1, end - s)
        total = F.aggregate(F.transform(own, lambda u: u["size"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.struct(F.get(own, F.lit(0))["n"].alias("first"), F.element_at(own, -1)["n"].alias("last"), total.alias("size"))

    return F.transform(starts, part)

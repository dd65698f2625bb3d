"""Vectors as rows: which take part, equal ones together, and matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_ID = 2**63 - 1  # stands for a null id in sorted lists, after all others


def usable(df: DataFrame, *more: str) -> DataFrame:
    """(vec_id, x, more) of rows whose vector has only finite numbers; x as doubles, without the sign of zero."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), *more)
    return rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def key(x: str = "x") -> list[Column]:
    """Two 64-bit hashes of a vector: equal vectors, equal keys."""
    return [F.xxhash64(F.lit(7), x).alias("h1"), F.xxhash64(F.lit(11), x).alias("h2")]


def together(rows: DataFrame, most: int, *more: str) -> DataFrame:
    """Rows (h1, h2, x, more) to one for each vector (and more), with the `most` smallest of its ids in order.

    All rows of a group are equally near to anything and ties go to smaller ids, so no answer of under `most` rows can need another.
    The limit holds before the shuffle too, so a vector that a third of all rows share is a few rows of each task.
    """
    same = Window.partitionBy("h1", "h2", *more).orderBy("vec_id")
    rows = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    rows = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= most)
    return rows.groupBy("h1", "h2", *more).agg(F.first("x").alias("x"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(column, size: int) -> np.ndarray:
    """An Arrow column of lists of numbers as rows of `size` numbers; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    n = len(column)
    if n and np.all(np.diff(at) == size):
        return values[at[0] : at[-1]].reshape(n, size).astype(np.float64)
    out = np.zeros((n, size))
    lengths = np.diff(at)
    row = np.repeat(np.arange(n), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values[at[0] : at[-1]]
    return out


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and values of an Arrow column of lists of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


def spread(places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For list numbers `places`: which of them each value belongs to, and the value's place among all values."""
    lengths = offsets[places + 1] - offsets[places]
    which = np.repeat(np.arange(len(places)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(offsets[places], lengths)


def leading(row: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` entries of each row, by ascending score, then id."""
    order = np.lexsort((ids, score, row))
    row = row[order]
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    nth = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
    return order[nth < most]

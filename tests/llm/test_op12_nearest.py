import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenmark.llm import op12_nearest as A

from .small import save

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, first=10, every=100):
    """Every row but the query's own, rows that repeat an id too."""
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if usable(v)]
    size = max(len(v) for _, v in rows)
    ids = np.array([A.NO_ID if i is None else i for i, _ in rows])
    x = np.array([np.pad(v, (0, size - len(v))) for _, v in rows])
    out = []
    for at, (i, _) in enumerate(rows):
        if i is not None and i % every == 0:
            score = np.sqrt(((x - x[at]) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, score)) if j != at][:first]
            out += [(i, n + 1, None if ids[j] == A.NO_ID else int(ids[j]), float(score[j])) for n, j in enumerate(order)]
    return sorted(out, key=str)


def clustered(n, size=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size)) * 2
    return [(int(i), (centres[rng.integers(12)] + rng.normal(size=size)).astype(np.float32).tolist(), int(i % 10)) for i in range(n)]


ODD = [
    (100, None, 1), (200, [], 1), (300, [0.0] * 16, 1), (400, [1.0, None] * 8, 1), (500, [float("nan")] * 16, 1), (600, [float("inf")] + [1.0] * 15, 1),
    (None, [1.0] * 16, None), (700, [1.0] * 16, None), (700, [1.0] * 16, None), (700, [1.0] * 16, None), (-800, [-1.0, -0.0] * 8, 1), (-801, [-1.0, 0.0] * 8, 1), (900, [3.0] * 5, 1), (901, [2.0] * 3, 1),
]


def test_exact_where_all_parts_are_asked(spark):
    rows = clustered(250) + ODD + [(i, [0.5] * 16, 2) for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"h1": F.lit(1), "x": F.lit("x"), "part": F.lit(0), "found": F.lit(None)})
    found = sorted((tuple(r) for r in A.nearest(df, mass=1.1, part_rows=60, sample=200, slice_rows=16).collect()), key=str)
    wanted = brute(rows)
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert np.allclose([r[3] for r in found], [r[3] for r in wanted], rtol=1e-12)


def test_few_rows_and_none(spark, tmp_path):
    rows = [(0, [1.0, 2.0], 1), (7, [1.0, 2.5], 1), (100, [5.0, 2.0], 1)]
    assert sorted(tuple(r) for r in A.nearest(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    assert A.nearest(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert A.op12_nearest(spark, save(spark.createDataFrame([], SCHEMA), tmp_path, "embeddings")).count() == 0


def test_recall_of_several_parts(spark):
    df = spark.createDataFrame(clustered(4000), SCHEMA)
    found = A.nearest(df, part_rows=250, sample=1500).cache()
    exact = spark.createDataFrame(brute(clustered(4000)), found.schema)
    assert A.recall(found, exact) >= 0.9


def test_parts_are_balanced_and_cut_few_edges():
    x = np.array([v for _, v, _ in clustered(1200)])
    near = A.graph(x, 10)
    exact = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(exact, np.inf)
    assert all(set(near[i]) == set(np.argsort(exact[i])[:10]) for i in range(0, 1200, 50))
    start = A.halved(x, 8)
    part = A.balanced(near, start, 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(150 * 1.05) and np.bincount(part, minlength=8).min() >= math.floor(150 * 0.95)
    assert (part[near] != part[:, None]).mean() < (start[near] != start[:, None]).mean()
    p = A.fit(x, 8).probabilities(x)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == part).mean() > 0.6


@pytest.mark.parametrize("most", [1e-30, 1e30])
def test_extreme_values(spark, most):
    rows = [(i, [most * (i + 1), most, 0.0], 0) for i in range(60)]
    found = sorted((tuple(r) for r in A.nearest(spark.createDataFrame(rows, SCHEMA), part_rows=20, sample=60, mass=1.1).collect()), key=str)
    assert [r[:3] for r in found] == [r[:3] for r in brute(rows)]

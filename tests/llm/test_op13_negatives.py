import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenmark.llm import op13_negatives as N

from .small import save
from .test_op12_nearest import ODD, SCHEMA, clustered

NONE = N.NO_ID


def brute(rows, every=100, held=N._CAP):
    usable = [(NONE if i is None else i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, c) in enumerate(usable):
        if i == NONE or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, d == c) for n, (j, w, d) in enumerate(usable) if n != at)  # noqa: B905
        for s, p, _ in [r for r in scored if r[2]][:5]:
            fit = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, None if p == NONE else p, n + 1, None if r[1] == NONE else r[1], max(-held, min(held, -s)), max(-held, min(held, -r[0]))) for n, r in enumerate(fit)]
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"h1": F.lit(1), "x": F.lit("x"), "cell": F.lit(0), "score": F.lit(None)})
    return sorted((tuple(r) for r in N.mine(df, **how).collect()), key=str)


def test_equals_brute_force(spark):
    hot = [(i, [0.5] * 16, i % 3) for i in range(1000, 1200)]
    rows = clustered(400) + [(i, v, 1 if c is None else c) for i, v, c in ODD] + [(5, None, None), (6, [1.0] * 16, None)] + hot
    got = found(spark, rows, slice_rows=32, anchor_rows=2)
    assert got == brute(rows) and len(got) > 50


def test_random_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.integers(-2, 3, 6) / 4).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(0, 3000, 10)]
    assert found(spark, rows) == brute(rows)


def test_few_rows_and_none(spark, tmp_path):
    rows = [(0, [1.0, 2.0], 1), (7, [1.0, 2.5], 1), (8, [1.0, 2.25], 2), (9, [9.0, 9.0], 2)]
    assert found(spark, rows) == brute(rows) == [(0, 7, 1, 8, 6 * 65536, int(5.5 * 65536))]
    assert found(spark, rows[:1]) == []
    assert N.op13_hard_negatives(spark, save(spark.createDataFrame([], SCHEMA), tmp_path, "embeddings")).count() == 0


@pytest.mark.parametrize("most", [3e4, 1e12])
def test_scores_beyond_doubles(spark, most):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(1, 1 << 24, 5) * most / (1 << 24)).astype(np.float32).tolist(), int(i % 2)) for i in range(0, 1500, 25)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 10


def test_bounds_hold_at_every_width():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 21)) + 0.3, rng.normal(size=(50, 21))
    exact, widths = x @ y.T, []
    for many in (1, 2, 4, 8, 16):
        low, high = N.bounds(N.segments(x, many), N.segments(y, many))
        assert (low <= exact + 1e-9).all() and (high >= exact - 1e-9).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)

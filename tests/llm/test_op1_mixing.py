from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from provenmark.llm import op1_mixing as M

from .small import CASES, SCHEMA, frame, save, words


def wanted_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("rows", [CASES, CASES[:1], [(i, "w " * (i % 7 + 1), "en", "abc"[i % 3], 0) for i in range(300)]])
def test_targets_and_taken(spark, tmp_path, rows):
    folder = save(frame(spark, rows), tmp_path)
    got = M.op1_source_mix(spark, folder).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = wanted_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    rich = M.mix(frame(spark, rows)).collect()
    taken = Counter()
    for r in rich:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]))
        assert 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= M.BLOCK + 1
    again = M.mix(frame(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in rich) == Counter((r.doc_id, r.taken) for r in again)


def test_empty(spark, tmp_path):
    assert M.op1_source_mix(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0


def test_apportion_is_sainte_lague(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 0.7, "f": 411.0}
    for seats in (0, 1, 7, 10, 100, 999):
        given = dict.fromkeys(weights, 0)
        for _ in range(seats):
            best = max(weights, key=lambda k: (weights[k] / (2 * given[k] + 1), -ord(k)))
            given[best] += 1
        df = spark.createDataFrame([(0, k, w, seats) for k, w in weights.items()], "g int, k string, w double, seats long")
        assert {r.k: r.quota for r in M.apportion(df, ["g"], "w", "seats", [F.col("k")], ["k"]).collect()} == given


def test_many_shards(spark):
    rows = [(i, "w " * (i % 5 + 1), "en", "a" if i % 3 else "b", 0) for i in range(600)]
    got = M.mix(frame(spark, rows), shard_docs=50).collect()
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= M.BLOCK + 1

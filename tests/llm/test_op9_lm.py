import math
import random
from collections import Counter

import numpy as np
import pytest

from provenmark.llm import op9_lm as L

from .small import CASES, SCHEMA, crc, frame, save, words


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)] + [None]


def brute(rows):
    learned = [r for r in rows if r[0] is not None and crc(r[0]) % 7 != 2]
    pairs, count = Counter(), Counter()
    for r in learned:
        t = tokens(r[1])
        count.update(t)
        pairs.update(zip([None, *t[:-1]], t, strict=True))
    nexts = Counter(w for _, w in pairs)
    context = Counter()
    kinds = {}
    for (v, w), c in pairs.items():
        context[v] += c
        kinds.setdefault(v, Counter())[min(c, 3)] += 1
    d = L.discounts(*(sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)))
    e = L.discounts(*(sum(c == k for c in nexts.values()) for k in (1, 2, 3, 4)))
    m, v1, n = sum(nexts.values()), len(count), sum(count.values())
    classes = Counter(min(c, 3) for c in nexts.values())

    def low(w):
        if not m:
            return 1 / (v1 + 1)
        return max(nexts[w] - e[min(nexts[w], 3)], 0) / m + sum(e[k] * classes[k] for k in (1, 2, 3)) / m / (v1 + 1)

    def high(v, w):
        if not context[v]:
            return low(w)
        gamma = sum(d[k] * kinds[v][k] for k in (1, 2, 3)) / context[v]
        return max(pairs[v, w] - d[min(pairs[v, w], 3)], 0) / context[v] + gamma * low(w)

    out = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((count[w] + 1) / (n + v1 + 1)) for w in t)
        score = sum(math.log10(high(v, w)) for v, w in zip([None, *t[:-1]], t, strict=True))
        out.append((r[0], r[0] is not None and crc(r[0]) % 7 == 2, len(t), sum(count[w] > 0 for w in t), n, base, score))
    total = sum(high("the", w) for w in [*count, "never seen"])
    return out, total


def corpus():
    rng = random.Random(3)
    say = [w for i in range(200) for w in [rng.choice(["The", "river", "Stone", "market", "of"]) if rng.random() < 0.6 else f"w{rng.randrange(300)}"] * 1]
    return list(CASES) + [(100 + i, " ".join(rng.choice(say) for _ in range(rng.randrange(1, 80))), "en", "s", 0) for i in range(150)]


@pytest.mark.parametrize("chunk_bytes", [10**9, 20_000])
def test_against_brute_force(spark, chunk_bytes):
    rows = corpus()
    want, total = brute(rows)
    assert total == pytest.approx(1)
    got = L.score_texts(frame(spark, rows), chunk_bytes=chunk_bytes).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6])


def test_query_empty_and_untrained(spark, tmp_path):
    assert L.op9_lm_scores(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    got = L.op9_lm_scores(spark, save(frame(spark, [(held, "a b", "en", "s", 0)]), tmp_path)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]


def test_packing():
    values = np.array([0, 5, 2**48 - 1], np.uint64)
    assert (L.unpack(L.pack(values)) == values).all() and (L.loosen(L.squeeze(np.array([3, 0, 10**12]))) == [3, 0, 10**12]).all()
    part = L.Slice(np.array([9, 3, 7], np.uint64), np.array([0.9, 0.3, 0.7]))
    assert list(part.find(np.array([7, 9, 3], np.uint64))) == [0.7, 0.9, 0.3]

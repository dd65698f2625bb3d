import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from provenmark.llm import op10_near as N
from provenmark.llm.components import components
from provenmark.llm.words import buffers, mix, split, windows

from .small import CASES, SCHEMA, frame, save, words


def bag(text):
    w = words(text)
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    """class_id of each row number."""
    bags, root = [bag(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (either and both / either >= 0.8 - 1e-12):
                root[find(i)] = find(j)
    classes = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            classes[find(i)] = min(classes.get(find(i), r[0]), r[0])
    return [(r[0], classes.get(find(i))) for i, r in enumerate(rows)]


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = list(CASES), 100
    for size in (12, 60, 300, 1500):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(9):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((n, " ".join(text), "en", "x", 0))
            n += 1
    for _ in range(40):
        rows.append((n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))), "en", "y", 0))
        n += 1
    return rows + [(n + 1, "a b", "en", "y", 0), (n + 2, "a\nb", "en", "y", 0), (n + 3, "again and again " * 50, "en", "y", 0), (n + 4, "again and again " * 49, "en", "y", 0), (n + 5, "again and again " * 9, "en", "y", 0)]


def test_classes_against_brute_force(spark, tmp_path):
    rows = corpus()
    got = N.op10_near_duplicates(spark, save(frame(spark, rows), tmp_path)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(key((r.doc_id, r.class_id)) for r in got) == sorted(key(x) for x in brute(rows))
    kept = N.keep_one(frame(spark, rows)).collect()
    wanted = {c for _, c in brute(rows)}
    assert Counter(r.doc_id for r in kept) == Counter(wanted) and "size" in kept[0].asDict()


def test_empty(spark, tmp_path):
    assert N.op10_near_duplicates(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    elements = mix(rng.integers(0, 2**62, 300).astype(np.uint64)) & np.uint64(2**48 - 1)
    a, b = rng.integers(0, 7, 300), rng.integers(0, 7, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    owner = np.repeat([0, 1], 300)
    weight = np.concatenate([a, b])
    on = weight > 0
    signed = N.signatures(owner[on], np.concatenate([elements, elements])[on], weight[on], 2, 20_000)
    assert np.mean(signed[0] == signed[1]) == pytest.approx(true, abs=0.02)


def test_windows():
    words_ = split(*buffers(pa.array(["a b c d e f", None, "a b", "b c d e f"])))
    values, owners = windows(words_, 5)
    assert list(owners) == [0, 0, 3, 2] and values[1] == values[2] and len(set(values.tolist())) == 3


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 9), (10, 10)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6} | {i: 100 for i in range(100, 131)}


def test_families_in_blocks(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "en", "x", 0))
    df = frame(spark, rows).select(N.text_key(N.F.col("text")).alias("key"), "text", "doc_id")
    keys = {r.doc_id: bytes(r.key) for r in df.collect()}
    hub = min(keys.values())
    meetings = spark.createDataFrame([(hub, k) for k in keys.values()], "a binary, b binary")
    found = N.across_classes(df.select("key", N.F.col("key").alias("root")), meetings, df.select("key", "text"), 0.8, block=7).collect()
    bags = {keys[r[0]]: bag(r[1]) for r in rows}
    want = {(a, b) for a in bags for b in bags if a < b and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()) - 1e-9}
    links = {(bytes(r.a), bytes(r.b)) for r in found}

    def classes(pairs):
        root = {k: k for k in bags}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        return sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))

    assert links <= want and classes(links) == classes(want) and len(want) > 50


def test_weights_of_very_many_texts():
    drawn = np.random.default_rng(5)
    values, owners = drawn.integers(0, 1 << 63, 500).astype(np.uint64)[drawn.integers(0, 500, 3000)], np.sort(drawn.integers(0, 40, 3000))
    few = N.weighted(values, owners)
    many = N.weighted(values, owners + 70_000)
    assert all((a == b).all() for a, b in zip(few, (many[0] - 70_000, *many[1:]), strict=True))

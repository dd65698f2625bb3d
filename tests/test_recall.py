"""Multiset recall of texts side by side, held against Counter."""

from collections import Counter

from pyspark.sql import functions as F

from provenmark.operators import align

# keys of one row, of several rows, and null (which meets nothing, as in a join)
ROWS = [
    ("a", "x y y z", "y x x"), ("b", "p q", "p q"), ("c", "", "p"), ("d", "k k", ""), ("e", None, "x"), ("f", "one two", "three"),
    ("g", "x y", "y"), ("g", "x x", "x z x"), ("h", "m", "m"), ("h", "n", ""), (None, "x", "x"), (None, "y", "z"),
]


def sides():
    left, right = {}, {}
    for rel, a, b in ROWS:
        left.setdefault(rel, Counter()).update((a or "").split())
        right.setdefault(rel, Counter()).update((b or "").split() if rel else [])
    return left, right


def tokens(c):
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda x: x != "")


def test_recall_missing_and_common_by_brute_force(spark):
    t = spark.createDataFrame(ROWS, "rel string, a string, b string")
    left, right = sides()
    got = {r.rel: r.recall for r in align.recall_of(t, tokens("a"), tokens("b")).collect()}
    assert got == {k: (n & right[k]).total() / n.total() for k, n in left.items() if n}
    got = Counter({(r.rel, r.token): r.missing for r in align.missing_tokens(t, tokens("a"), tokens("b")).collect()})
    assert got == Counter({(k, x): m for k, n in left.items() for x, m in (n - right[k]).items()})
    got = {r.rel: r.common for r in align.common_tokens(t, tokens("a"), tokens("b")).collect()}
    assert got == {k: (n & right[k]).total() for k, n in left.items() if n & right[k]}


def test_evaluation_of_keys_that_come_again(spark):
    rows = [("a", "12 mm and 7", "12 mm"), ("b", "no number", "no"), ("c", "3 4", "3"), ("c", "4 5", "4 4")]
    t = spark.createDataFrame(rows, "rel string, src_text string, md_text string")
    got = sorted((r.rel, r.src_words, r.md_words, round(r.coverage, 6), r.number_recall) for r in align.evaluate(t).collect())
    assert got == [("a", 4, 2, 0.5, 0.5), ("b", 2, 1, 0.5, None), ("c", 2, 1, 0.75, 0.75), ("c", 2, 2, 0.75, 0.75)]


def test_only_keys_that_come_again_are_exploded(spark, monkeypatch):
    t = spark.createDataFrame([(str(i // 2 if i < 4 else i), "x y", "y") for i in range(50)], "rel string, src_text string, md_text string")
    plain, seen = align.counted, []
    monkeypatch.setattr(align, "counted", lambda texts, *more: seen.append(texts.count()) or plain(texts, *more))
    for query in (align.recall_of, align.missing_tokens, align.common_tokens):
        query(t, tokens("src_text"), tokens("md_text"))
    align.evaluate(t)
    assert seen == [4] * 5

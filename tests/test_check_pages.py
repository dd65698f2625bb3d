"""Pages of both sides, held against Counter; and what the check shuffles."""

import random
import re
from collections import Counter

from provenmark.operators import pages


def test_pages_by_brute_force(spark):
    rng = random.Random(9)
    words = ["12", "3,5", "one", "Two", "ß", "--", "7", "7", "été"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    src = [(rel, page, text()) for rel in "ab" for page in range(1, 40)]
    md = [(rel, page, rng.choice([t, text()])) for rel, page, t in src if rng.random() > 0.2] + [("c", 1, "x 1")]
    frame = lambda rows: spark.createDataFrame(rows, "rel string, page int, text string")
    other = {(rel, page): t for rel, page, t in md}
    letters = lambda t: Counter(re.sub(r"[\W_]", "", t.lower()))
    numbers = lambda t: Counter(re.findall(r"\d+(?:[.,]\d+)*", t))
    want = {}
    for rel, page, t in src:
        m = other.get((rel, page), "")
        a, b, x, y = letters(t), letters(m), numbers(t), numbers(m)
        want[rel, page] = ((rel, page) in other, a.total(), (a - b).total(), (b - a).total(), x.total(), sorted((x - y).elements()))
    got = pages.check_pages(frame(src), frame(md), explain=False).collect()
    assert {(r.rel, r.page): (r.in_md, r.n, r.lost, r.extra, r.numbers, r.missing) for r in got} == want and len(got) == len(src)


def test_a_page_is_shuffled_once_a_side(spark, capsys):
    t = spark.createDataFrame([("a", 1, "x 1")], "rel string, page int, text string")
    pages.check_pages(t, t.selectExpr("rel", "page", "upper(text) AS text"), explain=False).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 2 and "explode" not in plan and "inline" not in plan

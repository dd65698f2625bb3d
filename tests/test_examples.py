import difflib
import random

from provenmark.operators import structure


def test_nearest_examples_by_brute_force(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcd ü😀") for _ in range(rng.choice([0, 1, 4, 9, 30, 220])))
    asked = [(rng.choice(["p", "q", None]), i, rng.choice([text(), None, "abcd ab"])) for i in range(120)]
    shown = [(rng.choice("pqr"), i, rng.randrange(40), rng.choice([text(), None, "abcd ab", "abcd a"])) for i in range(900)]
    want = set()
    for skill, i, t in asked:
        latest = sorted((-at, e, x) for s, e, at, x in shown if s == skill)[:300] if skill else []
        near = sorted((-difflib.SequenceMatcher(None, t, x).ratio(), k, e) for k, (_, e, x) in enumerate(latest) if None not in (t, x) and x != t)
        want |= {(i, e, r) for r, (s, _, e) in enumerate([x for x in near if x[0] <= -0.5][:3], 1)}
    got = structure.similar_examples(
        spark.createDataFrame(asked, "skill string, id int, text string"),
        spark.createDataFrame(shown, "skill string, example int, at int, text string"),
    ).collect()
    assert {(r.id, r.example, r["rank"]) for r in got} == want and len(got) == len(want) > 30, (len(got), len(want))


def test_few_texts_are_compared(monkeypatch):
    """Bounds leave out most of 300 examples; equal questions and equal examples are one text."""
    rng, calls, ratio = random.Random(4), [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    shown = ["".join(rng.choices(group, k=12)) for group in ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx") for _ in range(50)]
    structure._nearest(shown[::6], shown)
    assert 0 < len(calls) < 50 * 300 / 5
    calls.clear()
    structure._nearest(["hot ring"], ["old ring", "hot bolt"] * 150)
    assert len(calls) <= 2

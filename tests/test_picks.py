import difflib
import random

import pytest

from provenmark.operators import picks, readings
from provenmark.plans import registry

WORDS = "word string"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.7, 0.85, 0.5])
def test_no_similar_word_is_lost(spark, least):
    rng = random.Random(6)

    def changed(w):
        w = list(w)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "l", "I", "ü", "0", "rn"])
        return "".join(w)

    base = ["".join(rng.choice("aeiounrstlmd") for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 12, 13, 20, 24, 25, 30, 44]))) for _ in range(60)]
    known = sorted({changed(w) for w in base for _ in range(3)} | {"😀x", "x😀"})
    words = sorted({changed(w) for w in base} | {"", "x😀", "a"})
    got = {
        (r.word, r.near) for r in picks.similar_words(
            spark.createDataFrame([(w,) for w in words], WORDS),
            spark.createDataFrame([(w,) for w in known], WORDS),
            least
        ).collect()
    }
    assert got == {(w, k) for w in words for k in known if w and k and ratio(w, k) >= least} and len(got) > 50


@pytest.mark.parametrize("block", [7, 1000])
def test_first_similar_words_by_brute_force(spark, block):
    """Blocks of a few words and one of all find the same first words, whatever order they are in."""
    rng = random.Random(8)
    known = sorted({"".join(rng.choice("abcdeü😀") for _ in range(rng.choice([1, 3, 4, 5, 9, 30]))) for _ in range(150)} | {""})
    words = sorted({"".join(rng.choice("abcdeü😀") for _ in range(rng.choice([1, 3, 4, 5, 9, 30]))) for _ in range(60)} | {"", "zzz"})
    want = {(w, k) for w in words if w for k in [k for k in known if k and ratio(w, k) >= 0.7][:3]}
    got = picks.first_similar_words(spark.createDataFrame([(w,) for w in words], WORDS), spark.createDataFrame([(w,) for w in known], WORDS), 3, block=block)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 30


def test_words_are_compared_until_enough_are_found(monkeypatch):
    calls, real = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or real(self))
    assert picks._first_alike(["abcdefgh"], [f"abcdefg{x:05}"[:9] for x in range(5000)], 5, 0.7) and len(calls) == 5


def test_words_align_as_the_library_does_in_less_time(monkeypatch):
    """The same opcodes on random lists; a long line that repeats itself takes few steps."""
    rng = random.Random(5)
    for dense in [40] * 400 + [0] * 400:
        monkeypatch.setattr(readings, "DENSE", dense)
        a = rng.choices("abcdefg"[: rng.randrange(1, 8)], k=rng.randrange(30))
        b = [rng.choice("abx") if rng.random() < 0.2 else w for w in a][rng.randrange(3) :] + rng.choices("ab", k=rng.randrange(4))
        assert readings._blocks(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    a = "one two three four five two six".split() * 60
    b = [w + "x" if k % 13 == 0 else w for k, w in enumerate(a)]

    class Places(list):
        steps = 0

        def __iter__(self):
            for x in super().__iter__():
                Places.steps += 1
                yield x

        def __getitem__(self, k):
            Places.steps += 1
            return super().__getitem__(k)

    found = []
    for kind in (readings._Aligned, lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False)):
        matcher, Places.steps = kind(a, b), 0
        matcher.b2j = {w: Places(at) for w, at in matcher.b2j.items()}
        found.append((matcher.get_opcodes(), Places.steps))
    assert found[0][0] == found[1][0] and found[0][1] < found[1][1] / 4, [x for _, x in found]


def ask(spark, a, b, known=()):
    pairs = spark.createDataFrame([("r", 1, a, b)], "rel string, page int, a string, b string")
    return pairs, picks.questions(pairs, spark.createDataFrame([(w,) for w in known], WORDS))


def answer(spark, pairs, asked, pick, error=None):
    log = picks.picks(asked, asked.selectExpr("rel", "page", "at_a").crossJoin(spark.createDataFrame([(pick, error)], "pick string, error string")))
    text = picks.picked_texts(pairs, log).first()
    return text.a, text.b, [(r.outcome, r.pick) for r in log.collect()]


def test_one_reading_is_picked(spark):
    pairs, asked = ask(spark, "the point  Ioad is\tset", "the point load is set")
    assert answer(spark, pairs, asked, "load") == ("the point  load is\tset", "the point load is set", [("picked", "load")])
    assert asked.first().context == "the point [Ioad / load] is set"


def test_an_invented_word_is_rejected_and_a_failure_skipped(spark):
    pairs, asked = ask(spark, "the Ioad here", "the lcad here")
    assert answer(spark, pairs, asked, "road") == ("the Ioad here", "the lcad here", [("rejected", "road")])
    assert answer(spark, pairs, asked, None, "refused") == ("the Ioad here", "the lcad here", [("skipped", "refused")])
    assert [
        r.outcome for r in picks.picks(
            asked,
            spark.createDataFrame([], "rel string, page int, at_a int, pick string, error string"),
        ).collect()
    ] == ["skipped"]


def test_numbers_are_never_asked(spark):
    assert ask(spark, "riser 190 mm D2D13", "riser 180 mm D2D18", ["190"])[1].count() == 0
    assert ask(spark, None, "load")[1].count() == ask(spark, "", "load")[1].count() == 0


def test_glossary_words_are_candidates(spark):
    pairs, asked = ask(spark, "the (lcad)", "the Ioad", ["load", "lead", "lcad", "loads", "lcads", "zebra"])
    assert asked.first().candidates == ["(lcad)", "Ioad", "lcad", "lcads", "lead"]
    assert answer(spark, pairs, asked, "lead")[:2] == ("the lead", "the lead")


def test_query_takes_candidates_only(spark):
    rows = registry.queries()["v4_constrained_pick"](spark, "/root/testdata/sf0.001").collect()
    assert {r.outcome for r in rows} == {"picked", "rejected", "skipped"} and len(rows) > 100
    assert all((r.pick in r.candidates.split(" ")) == (r.outcome == "picked") for r in rows)
    assert not any(c.isdigit() for r in rows for c in r.a + r.b)


def test_a_block_is_searched_as_words_one_by_one():
    """letters of many words are counted and aligned as bits; letters that the block lacks, repeated ones, words over 64 letters, and none."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aabcdeü😀") for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 63, 64, 65, 90, 130, 300])))
    changed = lambda w: "".join(rng.choice(["", x, x, x, x, x, x + "z"]) for x in w)
    block = sorted({w for _ in range(120) for w in (word(), "x" * rng.randrange(1, 70))})
    asked = sorted({w for w in (changed(rng.choice(block)) for _ in range(150)) if w} | {"Ω", "a" * 64, "x" * 64, "ΩΩa"})
    for least in (0.7, 0.5, 0.95):
        want = [{"word": w, "near": k} for w in asked for k in [k for k in block if ratio(w, k) >= least][:3]]
        got = sorted(picks._first_alike(asked, block, 3, least), key=lambda x: (x["word"], x["near"]))
        assert got == want and len(want) > 20
    assert picks._first_alike([], block, 3, 0.7) == picks._first_alike(["a"], [], 3, 0.7) == []


def test_hardly_more_words_are_compared_than_are_alike(monkeypatch):
    """of words with the same letters in another order only those are compared that have them in the order of the asked one."""
    calls, real, rng = [], difflib.SequenceMatcher.ratio, random.Random(10)
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or real(self))
    block = sorted({"".join(rng.sample("abcdefghijkl", 12)) for _ in range(3000)})
    found = picks._first_alike(["abcdefghijkl"], block, 5000, 0.7)
    assert len(calls) <= 2 * len(found) + 10

import random
import re
from collections import Counter

import pytest

from provenmark.llm import op11_phrases as P

from .small import CASES, SCHEMA, frame, save

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, first=2000):
    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                count.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    out = []
    for lang in total:
        mine = []
        for (of, p), a in candidates.items():
            if of != lang or any(o == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in candidates.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:first])]
    return sorted(out)


def corpus(n=300):
    rng = random.Random(5)
    say = ["red", "Red", "fox", "über", "the", "of", "a", "x-1", "日本", "hop"]
    text = lambda: "".join(rng.choice(say) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", " ?! ", "\x1c"]) for _ in range(rng.randrange(60)))
    return list(CASES) + [(i, text(), rng.choice(["en", "de", None, "und"]), "s", 0) for i in range(n)]


@pytest.mark.parametrize("chunk_bytes", [3_000, 10_000_000])
def test_equals_brute_force(spark, chunk_bytes):
    rows = corpus()
    found = sorted(tuple(r) for r in P.mine(frame(spark, rows), least=30, chunk_bytes=chunk_bytes).collect())
    assert found == brute(rows, 30) and len(found) > 10
    assert {r[0] for r in found} == {"en", "de", "und"}


def test_first_ranks_only_and_ties(spark):
    rows = corpus(100)
    found = sorted(tuple(r) for r in P.mine(frame(spark, rows), least=3, first=7, chunk_bytes=5_000).collect())
    assert found == brute(rows, 3, 7)


def test_a_word_over_and_over(spark):
    rows = [(1, "ha " * 100, "en", "s", 0), (1, "ha " * 100, "en", "s", 0), (2, "go on " * 40, "en", "s", 0)]
    assert sorted(tuple(r) for r in P.mine(frame(spark, rows)).collect()) == brute(rows, 30)


def test_without_candidates(spark, tmp_path):
    assert P.op11_phrases(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0
    assert P.mine(frame(spark, CASES[:5])).count() == 0

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from provenmark.llm import op4_repeats as R

from .small import CASES, SCHEMA, frame, save


def brute(rows, least=200):
    raws = [(r[1] or "").encode() for r in rows]
    where = defaultdict(list)
    for i, raw in enumerate(raws):
        for s in range(len(raw) - least + 1):
            where[raw[s : s + least]].append((i, s))
    gone = [bytearray(len(raw)) for raw in raws]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + least] = b"\x01" * least
    out = []
    for r, raw, g in zip(rows, raws, gone, strict=True):
        spans = sum(g[j] and not (j and g[j - 1]) for j in range(len(g)))
        out.append((r[0] if r[0] is not None else -1, len(raw), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(raw, g, strict=True) if not x)).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["über", "river", "stone", "a", "market", "of", "garden"]) + str(rng.randrange(1000)) for _ in range(n))
    passage, other = say(60), say(26)
    rows = list(CASES[:5]) + [CASES[6], CASES[8], CASES[9]] + [(7000, "y" * 777, "en", "c", 0), (7001, "ab" * 400, "en", "c", 0)]
    for i in range(40):
        rows.append((100 + i, say(30) + (passage[i % 3 :] if i % 2 else other) + say(20 + i), "en", "x", 0))
    near = say(400)
    for i in range(6):
        at = rng.randrange(len(near))
        rows.append((200 + i, near[:at] + "#" + near[at + 1 :], "en", "x", 0))
    text = say(50)
    rows += [(300, text + " | " + text, "en", "x", 0), (301, say(300), "en", "x", 0), (302, say(3), "en", "x", 0), (303, say(80), "en", "z", 0), (303, say(80), "en", "z", 0)]
    return rows + [rows[-1]]


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_against_brute_force(spark, monkeypatch, heavy):
    rows = corpus()
    monkeypatch.setattr(R, "TEXT_BYTES", 5000)
    found = R.with_spans(R.keyed(frame(spark, rows)), heavy=heavy)
    got = found.select("doc_id", "text", "spans").mapInArrow(R._cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got) == brute(rows)


@pytest.mark.parametrize("heavy", [20_000, 0])
def test_short_periods_inside_one_run(spark, heavy):
    rng = random.Random(31)
    letters = iter("=-~+_^#@%&*/|<>§¶µ°ø")
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = []
    for period in (1, 7, 100):
        for n in (210, 260, 300, 301, 350, 400, 450):
            unit = next(letters) if period == 1 else own(period)
            part = (unit * n).encode()[:n].decode("utf-8", "ignore")
            rows += [(len(rows), part, "en", "p", 0)] if n % 100 else [(len(rows), own(90) + part + own(150), "en", "p", 0)]
    got = R.with_spans(R.keyed(frame(spark, rows)), heavy=heavy).select("doc_id", "text", "spans").mapInArrow(R._cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    want = brute(rows)
    assert sorted(tuple(r) for r in got) == want and sum(r[2] > 0 for r in want) >= 18


def test_query_and_empty(spark, tmp_path):
    rows = corpus()[:30]
    got = R.op4_repeated_passages(spark, save(frame(spark, rows), tmp_path)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got) == brute(rows)
    assert R.op4_repeated_passages(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0


def test_long_text_in_parts():
    rng = random.Random(2)
    raw = bytes(rng.randrange(97, 101) for _ in range(30_000))
    R_old, R.TEXT_BYTES = R.TEXT_BYTES, 4000
    try:
        covered = np.zeros(len(raw), int)
        for parts in R._pieces(np.array([0, len(raw)]), 200):
            for _, a, b in parts:
                start, count, _, _ = R.runs_of(np.frombuffer(raw[a:b], np.uint8), np.array([b - a]))
                for s, n in zip(start, count, strict=True):
                    covered[a + s : a + s + n] += 1
        assert (covered[: len(raw) - 199] == 1).all() and not covered[len(raw) - 199 :].any()
    finally:
        R.TEXT_BYTES = R_old


def test_maximal_repeats():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    least = 6
    raws = [s.encode() + b"#%d" % i for i, s in enumerate(strings)]
    tree = R.SuffixArray(raws, np.array([len(r) - least + 1 for r in raws]), least)
    got = {}
    for size, first, last in tree.maximal():
        places = [(int(tree.owner[p]), int(tree.offset[p])) for p in tree.order[first : last + 1]]
        i, o = places[0]
        got[raws[i][o : o + size]] = sorted(places)
    want = {}
    for size in range(least, 62):
        where = defaultdict(list)
        for i, r in enumerate(raws):
            for s in range(len(r) - size + 1):
                where[r[s : s + size]].append((i, s))
        for text, places in where.items():
            ahead = {raws[i][s + size : s + size + 1] or i for i, s in places}
            behind = {raws[i][s - 1 : s] if s else i for i, s in places}
            if len(places) > 1 and len(ahead) > 1 and len(behind) > 1:
                want[text] = sorted(places)
    assert got == want
    covered = {(i, o + k) for text, places in got.items() for i, o in places for k in range(len(text) - least + 1)}
    where = defaultdict(list)
    for i, r in enumerate(raws):
        for o in range(len(r) - least + 1):
            where[r[o : o + least]].append((i, o))
    assert covered == {p for places in where.values() if len(places) > 1 for p in places}


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_groups(spark, heavy):
    """Groups are equal bytes at two places or more, and together they cover what is removed."""
    rows = [(i, *r[1:]) for i, r in enumerate(corpus())]
    raws = {r[0]: (r[1] or "").encode() for r in rows}
    groups = defaultdict(set)
    for r in R.repeat_groups(frame(spark, rows), heavy=heavy).collect():
        groups[bytes(r.group), r.length].add((r.doc_id, r.start))
    gone = {i: bytearray(len(raw)) for i, raw in raws.items()}
    for (_, n), places in groups.items():
        assert n >= 200 and len(places) > 1 and len({raws[i][s : s + n] for i, s in places}) == 1
        for i, s in places:
            gone[i][s : s + n] = b"\x01" * n
    assert {i: sum(g) for i, g in gone.items()} == {i: n for i, _, n, *_ in brute(rows)}


def test_strip(spark):
    rows = corpus()
    out = {r.doc_id: r for r in R.strip_repeats(frame(spark, rows)).collect() if r.doc_id is not None}
    assert out[301].text == dict((r[0], r[1]) for r in rows)[301] and 300 in out and "7000" not in out and 7000 not in out
    want = {i: removed < size for i, size, removed, *_ in brute(rows) if i >= 100}
    assert {i for i in out if i >= 100} == {i for i, left in want.items() if left}
    assert list(R.strip_repeats(frame(spark, rows)).columns) == frame(spark, rows).columns


def shared_passages(rng, texts=30):
    """Short texts that take stretches of a few passages, which begin and end anywhere, so that texts end inside repeats of others."""
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(230, 420))) for _ in range(3)]
    out = []
    for _ in range(texts):
        p = rng.choice(passages)
        a = rng.choice([0, 0, rng.randrange(30)])
        b = min(len(p), a + rng.randrange(196, 330))
        out.append(rng.choice(["", "x", "yz", "".join(rng.choice("uvw") for _ in range(rng.randrange(9)))]) + p[a:b] + rng.choice(["", "", "q", "qr", "".join(rng.choice("stu") for _ in range(rng.randrange(9)))]))
    return out


def plain_spans(texts, least=200):
    """What the Spark jobs put together, for a handful of texts: runs, counts, and the trees of all strings at once."""
    runs, count = [], defaultdict(int)
    for d, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        for s, n, m, h in zip(*(v.tolist() for v in R.runs_of(raw, np.array([len(raw)]), least)), strict=True):
            runs.append((m, d, s, n, h))
            count[m, h] += 1
    spans, strings = defaultdict(list), {}
    for m, d, s, n, h in runs:
        if count[m, h] > 1:
            spans[d].append({"a": s, "b": s + n + least - 1})
        strings.setdefault((m, h), (m - 2**63, d, 0, s * 512 + n, h - 2**63, count[m, h] == 1, texts[d].encode()[s : s + n + least - 1]))
    batch = R._batch(list(zip(*sorted(strings.values()), strict=True)), R.LIGHT) if strings else None
    for found in R._scan([batch] if batch else [], least):
        for r in found.to_pylist():
            spans[r["d"]].append(r)
    return [R._merge(spans[d], 0) for d in range(len(texts))]


def test_no_byte_is_lost_where_texts_end_inside_repeats():
    """A suffix that ends must sort before those that go on, or it splits their interval."""
    for seed in range(1000):
        texts = shared_passages(random.Random(seed), 30 if seed < 300 else 12)
        got = [(i, len(t.encode()), sum(b - a for a, b in spans), len(spans)) for i, (t, spans) in enumerate(zip(texts, plain_spans(texts), strict=True))]
        assert got == [r[:4] for r in brute(list(enumerate(texts)))], seed


def test_texts_that_end_inside_repeats_through_spark(spark):
    texts = [t for seed in range(20) for t in shared_passages(random.Random(seed))]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = R.with_spans(R.keyed(frame(spark, rows))).select("doc_id", "text", "spans").mapInArrow(R._cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)

"""Candidates between unmatched lines, held against a plain search of all pairs."""

import random
import re
from collections import Counter

import pyarrow as pa

from provenmark.operators import align


def tokens(line):
    return set(re.findall(r"[a-z0-9]+", line.lower()))


def brute(src, md, most=30, dice=0.5):
    """Every source line against every Markdown line of its document."""
    out = set()
    for rel in {r for r, _, _ in src}:
        right = [(no, tokens(line)) for r, no, line in md if r == rel]
        df = Counter(t for _, toks in right for t in toks)
        kept = {t for t, n in df.items() if n <= max(500, len(right) // 2) and n <= 5000}
        for r, no, line in src:
            if r != rel:
                continue
            mine = tokens(line)
            shared = sorted((-len(mine & toks & kept), other, len(toks)) for other, toks in right if mine & toks & kept)
            for overlap, other, size in shared[:most]:
                score = -2 * overlap / (len(mine) + size)
                if score >= dice:
                    out.add((rel, no, other, round(score, 9)))
    return out


def lines(rng, rel, count, longest):
    words = [f"w{k}" for k in range(40)]
    out = []
    for no in range(count):
        picked = [words[min(int(rng.expovariate(0.2)), 39)] for _ in range(rng.randint(1, longest))]
        out.append((rel, no, " ".join(picked) if rng.random() > 0.03 else "--"))
    return out


def found(spark, src, md, **options):
    left = spark.createDataFrame(src, "rel string, src_no long, src string").selectExpr("rel", "src_no", "NULL AS md_no", "src", "NULL AS md")
    right = spark.createDataFrame(md, "rel string, md_no long, md string").selectExpr("rel", "NULL AS src_no", "md_no", "NULL AS src", "md")
    rows = align.candidates(left.unionByName(right), **options).collect()
    assert len(rows) == len({(r.rel, r.src_no, r.md_no) for r in rows})
    return {(r.rel, r.src_no, r.md_no, round(r.dice, 9)) for r in rows}


def test_candidates_lose_no_pair(spark):
    """Long lines outrank similar ones, some words are on too many lines, and some lines hold no word at all."""
    rng = random.Random(5)
    src, md = lines(rng, "a", 80, 9) + lines(rng, "b", 60, 14), lines(rng, "a", 1300, 12) + lines(rng, "b", 90, 25)
    want = brute(src, md)
    assert len(want) > 300
    assert found(spark, src, md) == want


def test_candidates_at_other_bounds(spark):
    rng = random.Random(6)
    src, md = lines(rng, "a", 70, 8), lines(rng, "a", 200, 10)
    for options in ({"dice": 0.8}, {"dice": 0.25, "most": 3}, {"dice": 2 / 3, "most": 1000}):
        assert found(spark, src, md, **options) == brute(src, md, **options)


def test_candidates_of_nothing(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [("a", 0, "one two")], []) == set()
    assert found(spark, [("a", 0, "--"), ("b", 0, "x")], [("a", 0, "--"), ("c", 0, "x")]) == set()


def test_open_lines_meet_in_one_exchange(spark):
    """no join of tokens; each open line goes through one exchange, by its document."""
    empty = spark.createDataFrame([], "rel string, src_no long, md_no long, src string, md string")
    plan = align.candidates(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_documents_and_hits_are_cut_without_loss(monkeypatch):
    """Documents over several batches, and source lines that have more hits than are counted together."""
    rng = random.Random(7)
    src, md, rows = [], [], []
    for rel, few, many in (("a", 3, 4), ("b", 90, 60), ("c", 1, 0), ("d", 0, 2), ("e", 30, 30)):
        src, md = src + lines(rng, rel, few, 9), md + lines(rng, rel, many, 12)
        rows += [(rel, of_src, no, list(tokens(line))) for side, of_src in ((src, True), (md, False)) for r, no, line in side if r == rel]
    table = pa.Table.from_pylist([dict(zip(("rel", "of_src", "no", "toks"), r, strict=True)) for r in rows])
    want = brute(src, md)
    for size, hits in ((1, 1), (7, 50), (40, 3000), (1000, 1_000_000)):
        monkeypatch.setattr(align, "HITS", hits)
        whole = list(align._whole_documents(table.to_batches(size)))
        assert sum(t.num_rows for t in whole) == len(rows)
        assert sum(len(set(t.column("rel").to_pylist())) for t in whole) == 5
        out = [r for t in whole for b in align._similar(t, 30, 0.5) for r in b.to_pylist()]
        assert {(r["rel"], r["src_no"], r["md_no"], round(r["dice"], 9)) for r in out} == want and len(out) == len(want) > 100


def test_segment_counts_leave_no_partner_out(spark):
    """a partner behind thirty lines that share more, and a token that is on all open lines."""
    wide = [("a", k, "p q r s " + " ".join(f"x{k}y{i}" for i in range(20))) for k in range(31)]
    src, md = [("a", 0, "p q r s")], [*wide, ("a", 31, "p q r t")]
    src, md = src + [("b", k, "t " * (k + 2)) for k in range(3)], md + [("b", k, f"T {'t ' * (k + 10)}") for k in range(1100)]
    kinds = "rel string, n long, line string"
    rows = align.segment_counts(spark.createDataFrame(src, kinds), spark.createDataFrame(md, kinds)).collect()
    assert {tuple(r) for r in rows} == {("a", 0, 0, 31, 1, 0.0), ("b", 0, 0, 1097, 3, 0.0)}


def test_all_pairs_of_no_bound(spark):
    rng = random.Random(8)
    src, md = lines(rng, "a", 70, 8) + lines(rng, "b", 50, 14), lines(rng, "a", 1100, 10) + lines(rng, "b", 90, 25)
    want = set()
    for (r, i, x), (q, j, y) in ((s, m) for s in src for m in md):
        a, b = tokens(x), tokens(y)
        if r == q and a & b and 2 * len(a & b) / (len(a) + len(b)) >= 0.5:
            want.add((r, i, j, round(2 * len(a & b) / (len(a) + len(b)), 9)))
    assert found(spark, src, md, most=None, stop=False) == want and len(want) > len(brute(src, md))

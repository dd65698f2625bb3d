"""Queries without SQL against plain Python on all rows of the smallest tables."""

import difflib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from provenmark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[a-z0-9]+")


def norm(line):
    return " ".join(line.split()).lower()


@pytest.fixture(scope="module")
def sides(spark):
    """rel -> (source lines, Markdown lines)."""
    out = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        src, md = r.text.split("\n"), []
        for n, line in enumerate(src):
            h = (r.doc_id * 31 + n) % 10
            md += [[], [re.sub(r"\s*\S+$", "", line)], ["- " + line], [line, line], [line, f"note {r.doc_id}"]][h] if h < 5 else [line]
        out[f"{r.source}/{r.lang}/doc_{r.doc_id}.pdf"] = (src, [re.sub(r"^(?:(?:#{1,6}\s)|(?:>\s)|(?:[-*+]\s)|(?:\d{1,3}\.\s))+", "", x) for x in md])
    return out


def aligned(src, md):
    """(pairs of equal lines, pairs of similar lines) by number."""
    where = defaultdict(list)
    for j, line in enumerate(md):
        if norm(line):
            where[norm(line)].append(j)
    equal = {}
    for i, line in enumerate(src):
        if norm(line) and where[norm(line)]:
            equal[i] = where[norm(line)].pop(0)
    left = {i: set(TOKEN.findall(x.lower())) for i, x in enumerate(src) if norm(x) and i not in equal}
    right = {j: set(TOKEN.findall(x.lower())) for j, x in enumerate(md) if norm(x) and j not in set(equal.values())}
    df = Counter(t for toks in right.values() for t in toks)
    good = {t for t, n in df.items() if n <= max(500, len(right) // 2) and n <= 5000}
    candidates = []
    for i, a in left.items():
        met = sorted(((-len(a & b & good), j) for j, b in right.items() if a & b & good))[:30]
        candidates += [(-2 * o / (len(a) + len(right[j])), -i, -j) for o, j in met if -2 * o / (len(a) + len(right[j])) >= 0.5]
    similar = {}
    for _, i, j in sorted((-d, i, j) for d, i, j in candidates):
        if -i not in similar and -j not in similar.values():
            similar[-i] = -j
    return equal, similar


def test_assignment_segments_and_counts(spark, sides):
    pairs, order, counts = set(), {}, {}
    for rel, (src, md) in sides.items():
        equal, similar = aligned(src, md)
        pairs |= {(rel, i, j) for i, j in similar.items()}
        used, back = set(similar.values()), {j: i for i, j in equal.items()}
        first, rest, anchor = [], [], -1
        for j, line in enumerate(md):
            if j in back:
                anchor = back[j]
            elif norm(line) and j not in used:
                first.append((anchor, j))
        for i, line in enumerate(src):
            if norm(line):
                rest.append(("match", i, equal[i]) if i in equal else ("changed", i, similar[i]) if i in similar else ("src_only", i, None))
        order[rel] = [("md_only", None, j) for _, j in sorted(first)] + rest
        kinds = Counter(s for s, *_ in order[rel])
        total = kinds["match"] + kinds["changed"] + kinds["src_only"]
        counts[rel] = (kinds["match"], kinds["src_only"], kinds["md_only"], kinds["changed"], kinds["match"] / total if total else None)
    q = registry.queries()
    assert {(r.rel, r.src_no, r.md_no) for r in q["j3_assignment"](spark, FOLDER).collect()} == pairs
    got = defaultdict(list)
    for r in sorted(q["o1_segments"](spark, FOLDER).collect(), key=lambda r: (r.rel, r.seq)):
        got[r.rel].append((r.status, r.src_no, r.md_no))
    assert dict(got) == {k: v for k, v in order.items() if v}
    found = {r.rel: (r.n_match, r.n_src_only, r.n_md_only, r.n_changed, r.line_match_ratio) for r in q["a1_segment_counts"](spark, FOLDER).collect()}
    assert found == {k: v for k, v in counts.items() if order[k]}


def test_packing(spark, sides):
    want = {}
    for rel, (src, _) in sides.items():
        parts = []
        for n, size in enumerate(map(len, src)):
            if parts and parts[-1][2] + size <= 1000:
                parts[-1] = (parts[-1][0], n, parts[-1][2] + size)
            else:
                parts.append((n, n, size))
        want[rel] = parts
    assert {r.rel: [tuple(p) for p in r.parts] for r in registry.queries()["w12_packing"](spark, FOLDER).collect()} == want


def test_glossary_choice(spark, sides):
    core = lambda w: re.sub(r"^\W+|\W+$", "", w)
    counts = Counter(c for src, _ in sides.values() for line in src for c in map(core, line.split(" ")) if len(c) >= 2)
    known = {w for w, n in counts.items() if n >= 3}
    want = Counter()
    for rel, (src, _) in sides.items():
        doc = int(re.search(r"doc_(\d+)", rel)[1])
        for n, line in enumerate(src):
            if (doc + n) % 50 == 0:
                continue
            w = line.split(" ")
            a = " ".join(w).split()
            b = " ".join(x.replace("l", "I") if (doc + n + i) % 13 == 0 else x for i, x in enumerate(w)).split()
            for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                if op == "replace" and j - i == m - k:
                    for d in range(j - i):
                        x, y = core(a[i + d]), core(b[k + d])
                        edits = sum(p != q for p, q in zip(x, y, strict=False))
                        if x != y and min(len(x), len(y)) >= 3 and len(x) == len(y) and edits <= 2 and not re.search(r"\d", x + y) and (x in known) != (y in known):
                            want[
                                (
                                    rel, n, "b", k + d, b[k + d], b[k + d].replace(y, x, 1),
                                ) if x in known else (rel, n, "a", i + d, a[i + d], a[i + d].replace(x, y, 1))
                            ] += 1
    assert Counter((r.rel, r.page, r.engine, r["at"], r.was, r.now) for r in registry.queries()["v2_glossary_choice"](spark, FOLDER).collect()) == want
    assert len(want) > 100


def test_stripped_markdown(spark):
    """Bodies of the given documents have emphasis, bars and lists, but no fences or comments."""
    pair = re.compile(r"(\*\*|~~|\*)(?=\S)(.+?)(?<=\S)\1")
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        out = []
        for line in r.text.split("\n"):
            s = re.sub(r"^(?:(?:#{1,6}\s)|(?:>\s)|(?:[-*+]\s)|(?:\d{1,3}\.\s))+", "", line.strip())
            s = s if "`" in s else pair.sub(r"\2", s)
            if "|" in s:
                s = re.sub(r"\s+", " ", " ".join(c.strip() for c in re.sub(r"^\|+|\|+$", "", s).split("|"))).strip()
            if s.strip() and not re.match(r"^\|?[\s:\-|]+\|[\s:\-|]*$", line.strip()):
                out.append(s.strip())
        want[r.doc_id] = "\n".join(out)
    assert {r.doc_id: r.body for r in registry.queries()["p2_strip_markdown"](spark, FOLDER).collect()} == want


def test_sampled_checks(spark, sides):
    """The first three documents of a rule, then every fifth by checksum."""
    by = defaultdict(list)
    for rel in sorted(sides):
        by[int(re.search(r"doc_(\d+)", rel)[1]) % 12].append(rel)
    want = {(rule, rel): k < 3 or zlib.crc32(f"{rule}|room|{rel}".encode()) % 5 == 0 for rule, rels in by.items() for k, rel in enumerate(rels)}
    assert {(r.rule, r.rel): r.sampled for r in registry.queries()["w14_sampled_checks"](spark, FOLDER).collect()} == want


def test_line_diff(spark, sides):
    want = {}
    for rel, (src, md) in sides.items():
        if src != md:
            ops = list(difflib.unified_diff(src, "\n".join(md).split("\n"), lineterm="", n=2))[2:]
            want[rel] = (sum(x[0] == "+" for x in ops), sum(x[0] == "-" for x in ops), len(ops) > 800)
    assert {r.rel: (r.added, r.removed, r.truncated) for r in registry.queries()["v6_line_diff"](spark, FOLDER).collect()} == want


def test_similar_examples(spark):
    parts, want = defaultdict(list), set()
    for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect():
        parts[r.p_brand].append((-r.p_partkey, r.p_name))
    for rows in parts.values():
        latest = sorted(rows)[:300]
        for k, name in rows:
            near = sorted((-difflib.SequenceMatcher(None, name, x).ratio(), i, -e) for i, (e, x) in enumerate(latest) if x != name)
            want |= {(-k, e, i + 1) for i, (s, _, e) in enumerate([x for x in near if x[0] <= -0.5][:3])}
    assert {(r.id, r.example, r["rank"]) for r in registry.queries()["j25_similar_examples"](spark, FOLDER).collect()} == want


def test_every_query_without_sql_is_tested_here():
    bare = set(registry.queries()) - set(registry.oracle_sql())
    assert bare == {
        "p2_strip_markdown", "j3_assignment", "o1_segments", "a1_segment_counts", "w12_packing", "w12_cut_sections",
        "w14_sampled_checks", "v2_glossary_choice", "v4_constrained_pick", "v6_line_diff", "j25_similar_examples",
    }

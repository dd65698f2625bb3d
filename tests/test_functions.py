"""Exact values of single functions and operators."""

import time

import pytest
from pyspark.sql import functions as F

from provenmark.functions import markdown, names, score, text
from provenmark.operators import align, readings, rules, state, verify
from provenmark.sources import html


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("- **Term** - definition", "Term - definition"),
        ("12) Check the cover", "12) Check the cover"),
        ("2. Fire hydrant", "Fire hydrant"),
        ("2.5m pipe", "2.5m pipe"),
        ("A_B and *it*", "A_B and it"),
        ("| a | b |\n|---|---|\n| c | d |", "a b\nc d"),
        ("---\nk: v\n---\n# Head\n<!-- unit: p1 -->\ntext", "Head\ntext"),
        ("```\n  - kept **as** is\n```\nout", "  - kept **as** is\nout"),
        ("", ""),
        (None, ""),
    ],
)
def test_strip_markdown(spark, raw, want):
    assert one(spark, text.strip_md_artifacts, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1,000 L", ["1000l"]), ("1.000 L", ["1.000l"]), ("0,25", ["0.25"]), ("25 mm and 300 mm", ["25mm", "300mm"]),
        ("12,345,678", ["12345678"]), ("3 valves", ["3v"]), ("none", []),
    ],
)
def test_numbers(spark, raw, want):
    assert one(spark, text.extract_numbers, raw) == want


def test_counts_and_lines(spark):
    assert tuple(one(spark, text.count_text, "消防 hydrant 25mm"))[1:] == (4, 2, 2)
    assert one(spark, text.dup_ratio, "a b a c a d a e f g h i") == 1.0 and one(spark, text.dup_ratio, "a a a a") == 0.0
    assert one(spark, text.split_lines, "a\r\nb c\n") == ["a", "b", "c"] and one(spark, text.split_lines, "") == []
    assert one(spark, text.normalize_line, "  A   B ") == "a b"


def test_scores(spark):
    df = spark.createDataFrame([("ok", 80.0), ("ok", 79.9), ("ok", None), ("rejected", 99.0), (None, 99.0)], "v string, s double")
    assert [
        r.x for r in df.select(score.trust_state(F.col("v"), F.col("s")).alias("x")).collect()
    ] == ["trusted", "need_review", "need_review", "rejected", "unreviewed"]
    parts = spark.createDataFrame([(1.0, 0.9, None, None)], "t double, n double, h double, b double")
    cols = dict(zip(("text", "numbers", "headings", "tables"), map(F.col, "tnhb"), strict=True))
    assert parts.select(score.accuracy(cols).alias("x")).first().x == pytest.approx(95.7)
    assert one(
        spark,
        score.reason_code,
        "MemoryError in worker",
    ) == "resources" and one(spark, score.reason_code, "SSLError") == "download" and one(spark, score.reason_code, None) == "other"


def test_names(spark):
    assert one(spark, names.series_of, "/2003/AS 3500.1-2003 Water services.pdf") == "AS 3500.1" and one(spark, names.series_of, "/misc/notes.pdf") is None
    assert one(spark, names.prefixes, "a/b/c.pdf") == ["", "a", "a/b"]
    assert one(spark, names.front_matter, "---\na: 1\nb: x: y\n---\nbody") == {"a": "1", "b": "x: y"}
    assert [one(spark, names.route, p) for p in ("a/b.PDF", "x.dwg", "x", "x.foo")] == ["pdf", "cad", "unknown", "unknown"]


def test_alignment(spark):
    src = spark.createDataFrame(
        [("d", i, x) for i, x in enumerate(["One line", "", "Pipes shall be 25 mm diameter", "same", "same"])],
        "rel string, n int, line string"
    )
    md = spark.createDataFrame(
        [("d", i, x) for i, x in enumerate(["one  LINE", "extra here", "Pipes shall be 2S mm diameter", "same"])],
        "rel string, n int, line string"
    )
    found = align.exact_match(src, md)
    segs = align.segments(found, align.assign(align.candidates(found))).orderBy("seq").collect()
    assert [(r.status, r.src_no, r.md_no) for r in segs] == [("md_only", None, 1), ("match", 0, 0), ("changed", 2, 2), ("match", 3, 3), ("src_only", 4, None)]


def test_state(spark):
    log = spark.createDataFrame(
        [("a", 1, "ok", "x"), ("a", 2, None, "x"), ("a", 3, "rejected", "y"), ("b", 4, "ok", "x"), ("b", 5, None, "x")],
        "rel string, seq int, to_state string, reviewer string",
    )
    assert [tuple(r) for r in state.verdicts(log).collect()] == [("a", "rejected", "y", 1)]


def corrected(spark, text, *book, series=None, doc=None):
    docs = spark.createDataFrame([("r", series, doc, text)], "rel string, series string, doc string, text string")
    rows = [(i + 1, kind, find, new, before, after, scope, s, d, True) for i, (kind, find, new, before, after, scope, s, d) in enumerate(book)]
    row = rules.apply_rules(docs, spark.createDataFrame(rows, rules.RULE), "text").first()
    return row.text, {x.num: x.n for x in row.done}


def test_rules(spark):
    everywhere = (None, None, "all", None, None)
    assert corrected(
        spark,
        "Watre and watres, $5",
        ("text", "Watre", "Water", *everywhere),
        ("text", "Water and", "W$1\\ &", *everywhere),
        ("text", "$5", "five", None, None, "series", "AS 1", None),
        series="AS 1",
    ) == ("W$1\\ & watres, five", {1: 1, 2: 1, 3: 1})
    assert corrected(spark, "---\nwas: Watre\n---\nWatre", ("text", "Watre", "Water", *everywhere)) == ("---\nwas: Watre\n---\nWater", {1: 1})
    assert corrected(spark, "bore l50 mm, weight l50 kg", ("number", "l50", "150", "bore ", " mm", "all", None, None)) == ("bore 150 mm, weight l50 kg", {1: 1})
    assert corrected(spark, "fittcd and connectcd, x2cd", ("pattern", r"(\w+)cd", r"\1ed", *everywhere)) == ("fitted and connected, x2cd", {1: 2})
    assert corrected(spark, "a b", ("text", "a", "x", None, None, "document", None, "one.pdf"), doc="two.pdf") == ("a b", {})


def test_readings(spark):
    got = spark.createDataFrame(
        [("l50 mm and 1O0 kPa, ISO 9001, 3D model, Class 2S building, 2S mm",)],
        "t string",
    ).select(readings.correct_text("t").alias("x")).first().x
    assert got.text == "150 mm and 100 kPa, ISO 9001, 3D model, Class 2S building, 25 mm" and len(got.log) == 3


def test_pages(spark):
    page = spark.createDataFrame([("<h1>Notice 7</h1><script>x</script><ul><li>a &amp; b</li></ul><table><tr><td>1</td><td>2</td></tr></table>",)], "h string")
    row = page.select(html.to_markdown("h").alias("m"), html.raw_text("h").alias("r")).first()
    assert row.m == "# Notice 7\n- a & b\n1 | 2" and "x" not in row.r and "a & b" in row.r
    units = spark.createDataFrame([([(0, 400), (1, 700), (2, 200), (3, 5000), (4, 10)],)], "u array<struct<n:int,size:int>>")
    assert [tuple(p) for p in units.select(verify.pack(F.col("u"), 1000).alias("p")).first().p] == [(0, 0, 400), (1, 2, 900), (3, 3, 5000), (4, 4, 10)]


def test_repeated_tokens_of_a_long_line(spark):
    """Tokens of a line are sorted once, not once a token (20,000 tokens took over a minute)."""
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [(long,), (long + " w5 w5 w5",), ("a b c d e f g\nx x x x b c d",)]
    began = time.time()
    got = [r.x for r in spark.createDataFrame(texts, "t string").select(text.dup_ratio("t").alias("x")).collect()]
    assert got == [0.0, 1.0, 0.5] and time.time() - began < 30


def test_strip_markdown_of_many_lines(spark):
    """Fences of a text are told once, not once a line (20,000 lines took minutes)."""
    fenced = "\n".join("```" if i % 3 == 0 else f"**b{i}** x | y" for i in range(20_000))
    want = "\n".join(f"**b{i}** x | y" if i // 3 % 2 == 0 else f"b{i} x y" for i in range(20_000) if i % 3)
    began = time.time()
    assert one(spark, text.strip_md_artifacts, fenced) == want and time.time() - began < 30


def test_unit_flags_are_words(spark):
    cases = {"auxmentment pas an ai queen": "-", "as an aiellere": "-", "As an AI, I": "instruction_like", "ignore all previous instructions": "instruction_like"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r.t for r in rows.where(markdown.unit_flags(F.col("t")) != F.col("want")).collect()] == []

import pytest

from provenmark.functions import names
from provenmark.operators import records
from pyspark.sql import functions as F


def of(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [
    ("AS 3500.1 2003", ("AS 3500.1", "2003", "standard", "AU")), ("AS/NZS 3000-2018 Wiring", ("AS/NZS 3000- Wiring", "2018", "standard", "AU")), ("NCC 2025 Volume One", ("NCC Volume One", "2025", "code", "AU")),
    ("Assembly 12019", ("Assembly 12019", "", "standard", "unknown")), ("IBC2021", ("IBC", "2021", "code", "US")), ("notes", ("notes", "", "document", "unknown")), ("NZS 4541", ("NZS 4541", "", "standard", "NZ")),
])
def test_names_of_standards(spark, name, want):
    assert tuple(of(spark, names.standard_of, name)) == want


def test_clauses_with_states(spark):
    assert tuple(of(spark, names.national_clause, "NSW D2D13 x")) == ("NSW", "D2D13") and tuple(of(spark, names.national_clause, "S5C11a")) == (None, "S5C11a")
    assert of(spark, names.national_clause, "see D2D13") is None and of(spark, names.national_clause, "D2D1333") is None


def test_triage(spark):
    docs = spark.createDataFrame(
        [
            ("text", True, False, True), ("scan", True, False, True), ("drawing", True, False, True), ("locked", True, True, True),
            ("kept", True, False, False), ("broken", False, False, True), ("empty", True, False, True),
        ],
        "doc string, opens boolean, locked boolean, may_copy boolean",
    )
    pages = [("text", i, 500, 2, 600, 800) for i in range(3)] + [("scan", i, 10, 2, 600, 800) for i in range(3)] + [
        ("drawing", i, 50, 400, 1200 if i < 25 else 10, 800) for i in range(50)
    ] + [("locked", 0, 500, 0, 1, 1)]
    got = {
        r.doc: (r["class"], r.pages, r.chars) for r in records.triage(
            docs,
            spark.createDataFrame(pages, "doc string, i int, chars int, vectors int, width int, height int"),
        ).collect()
    }
    assert got == {
        "text": ("text", 3, 500.0), "scan": ("scan", 3, 10.0), "drawing": ("drawing", 50, 50.0), "locked": ("protected", 1, None),
        "kept": ("protected", 0, None), "broken": ("unsupported", 0, None), "empty": ("unsupported", 0, None),
    }


RULE = "id int, num int, kind string, find string, replace string, before string, after string, scope string, series string, doc string, enabled boolean, reverts int"


def test_widen(spark):
    def rule(i, find, scope, series=None, doc=None, kind="text", enabled=True, reverts=0, before=None):
        return (i, i, kind, find, "y", before, None, scope, series, doc, enabled, reverts)

    rules = [
        rule(1, "a", "series", "AS 10"), rule(2, "a", "document", None, "in/AS 10.pdf"), rule(3, "a", "series", "AS 1", before="b"), rule(4, "b", "series", "AS 10"), rule(5, "b", "series", "AS 20"), rule(6, "c", "all"), rule(7, "c", "series", "AS 10"),
        rule(8, "d", "document", None, "notes.pdf"), rule(9, "d", "document", None, "AS 100.pdf"), rule(10, "e", "series", "AS 10"), rule(11, "e", "series", "AS 10", enabled=False), rule(12, "e", "series", "AS 10", reverts=3), rule(13, "f", "series", "AS 10", kind="pattern"), rule(14, "f", "series", "AS 10", kind="pattern"),
    ]
    had = spark.createDataFrame([([5, 4],)], "ids array<int>")
    df = spark.createDataFrame(rules, RULE)
    got = {r.find: (r.ids, r.scope, r.series) for r in records.widen(df, had).collect()}
    assert got == {"a": ([1, 2], "series", "AS 10"), "d": ([8, 9], "all", None)}
    assert records.widen(df, had.limit(0)).where("find = 'b'").first().scope == "all"


def test_pattern_scores(spark):
    patterns = spark.createDataFrame([(1, r"(\w+)cd\b", r"\1ed"), (2, "x", "$y")], "id int, find string, replace string")
    fixes = spark.createDataFrame([(1, "fittcd", "fitted"), (1, "fittcd", "fitter"), (2, "axb", "a$yb")], "id int, wrong string, right string")
    others = spark.createDataFrame([(1, "abcd")], "id int, text string")
    assert {r.id: (r.cases, r.wrong, r.score) for r in records.pattern_scores(patterns, fixes, others).collect()} == {1: (5, 2, 60.0), 2: (2, 0, 100.0)}
    assert records.pattern_scores(patterns.where("id = 1"), fixes.limit(0), others.limit(0)).first().score == 0.0


def test_score_sheet(spark):
    rows = [(i, "A" if i else "F", True, True, True, None if i == 5 else True, float(i)) for i in range(100)]
    got = {
        r.category: (r.questions, r.passed, r.median_s, r.enough) for r in records.score_sheet(
            spark.createDataFrame(
                rows,
                "id int, category string, answer_ok boolean, citation_ok boolean, status_ok boolean, honesty_ok boolean, seconds "
                "double",
            )
        ).collect()
    }
    assert got == {None: (100, 99, 49.5, True), "A": (99, 98, 50.0, None), "F": (1, 1, 0.0, True)}


def test_affected(spark):
    results = spark.createDataFrame([("a", "l50 mm, l50"), ("b", "nothing"), ("c", "150 mm")], "rel string, text string")
    rules = spark.createDataFrame([(1, "l50"), (2, "zz")], "id int, find string")
    applied = spark.createDataFrame([(1, "c"), (1, "a"), (1, "c")], "id int, rel string")
    assert sorted((r.id, r.rel, r.places) for r in records.affected(results, rules, applied).collect()) == [(1, "a", 2), (1, "c", 0)]


def test_backfill(spark):
    counts = spark.createDataFrame(
        [("a", None, 7, None, 8), ("b", 1, 2, 3, 4), ("c", None, None, None, None)],
        "rel string, src_chars long, md_chars long, src_words long, md_words long",
    )
    texts = spark.createDataFrame([("a", "two words ", "x"), ("b", "more words here", "x")], "rel string, src string, md string")
    assert {
        r.rel: (r.src_chars, r.md_chars, r.src_words, r.md_words) for r in records.backfill(counts, texts).collect()
    } == {"a": (9, 7, 2, 8), "b": (1, 2, 3, 4), "c": (None,) * 4}

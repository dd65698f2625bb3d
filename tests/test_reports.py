"""Reports, findings, outcomes, states, pages, structure and Markdown on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from provenmark.functions import markdown, reports, score, text
from provenmark.operators import pages, readings, state, structure

BASE = {"route": "text", "page_count": 100, "missing": [], "chars_recall": 1.0, "low": [], "extra": [], "numbers_recall": 1.0, "number_pages": [], "headings": 50, "unmatched": 0, "heading_examples": [], "cells": 200, "mismatches": 0, "table_examples": [], "unreadable": [], "readings": None, "review_pages": None, "source_ok": True}


def made(spark, rows):
    """rows of (report changes, verdict, triage, error)."""
    data = [(tuple((BASE | r).values()) if r is not None else None, *rest) for r, *rest in rows]
    return spark.createDataFrame(data, _schema())


def _schema():
    from pyspark.sql.types import StringType, StructField, StructType

    return StructType([StructField("report", StructType.fromDDL(reports.REPORT)), *[StructField(c, StringType()) for c in ("verdict", "triage", "error")]])


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, 100.0),
        ({"numbers_recall": 0.9}, 97.0),
        ({"unmatched": 5}, 98.0),
        ({"chars_recall": 0.985}, 99.4),
        ({"missing": [3, 4]}, 99.2),
        ({"cells": 0, "headings": 0}, 100.0),
        ({"chars_recall": None, "numbers_recall": None, "headings": 0, "cells": 0}, None),
        ({"route": "ocr", "readings": [(1, 0.9, []), (2, 1.0, [])]}, 95.0),
    ],
)
def test_accuracy(spark, change, want):
    got = made(spark, [(change, None, None, None)]).select(score.accuracy(reports.parts(F.col("report"))).alias("a")).first().a
    assert got == (want if want is None else pytest.approx(want))


def test_findings(spark):
    change = {
        "number_pages": [(4, ["25", "300"])],
        "low": [(2, 0.91, 40)],
        "extra": [(7, 99)],
        "heading_examples": [(3, "Scope")],
        "table_examples": [(5, "row 2")],
        "unreadable": [9, 8, 9],
        "route": "ocr",
        "readings": [(1, 0.9, [("2S mm", "25 mm"), ("", "")])],
        "review_pages": [1, 6],
    }
    rows = made(spark, [(change, None, None, None)]).select(F.inline(reports.findings(F.col("report")))).collect()
    assert [(r.kind, r.page) for r in rows] == [
        ("numbers", 4), ("text", 2), ("text", 7), ("headings", 3), ("tables", 5), ("formula", 8), ("formula", 9), ("reading", 1),
        ("text", 6),
    ]
    assert rows[0].detail == "missing: 25, 300" and rows[1].detail == "recall 0.91, 40 characters missing" and (rows[7].a, rows[7].b) == ("2S mm", "25 mm")
    many = made(spark, [({"extra": [(i, 50) for i in range(300)]}, None, None, None)]).select(F.size(reports.findings(F.col("report"))).alias("n")).first().n
    assert many == 200


def test_outcomes_and_states(spark):
    df = made(
        spark,
        [
            ({}, "PASS", None, None),
            ({}, "PASS", None, "MemoryError"),
            (None, None, None, None),
            ({}, "SKIP", "protected", None),
            ({}, "SKIP", "drawing", None),
            ({"source_ok": False}, "PASS", None, None),
            ({"number_pages": [(1, ["2"])]}, "FAIL", None, None),
        ],
    )
    c = F.col
    got = [r.o for r in df.select(reports.outcome(c("report"), c("verdict"), c("triage"), c("error")).alias("o")).collect()]
    assert [(o.outcome, o.reason) for o in got] == [
        ("result", ""), ("unprocessable", "resources"), ("unprocessable", "other"), ("unprocessable", "protected"),
        ("skipped", "unsupported"), ("unprocessable", "source_changed"), ("result", ""),
    ]
    assert got[0].accuracy == 100.0 and got[1].accuracy is None and got[6].number_diffs == 1
    files = spark.createDataFrame(
        [
            ("processing", "result", True, 99.0, 0, 0), (None, None, False, None, 0, 0), (None, "skipped", False, None, 0, 0),
            (None, "result", True, 10.0, 3, 0), (None, "result", False, 95.0, 0, 0), (None, "result", False, 95.0, 0, 1),
            (None, "result", False, 80.0, 0, 0),
        ],
        "activity string, outcome string, confirmed boolean, acc double, nd int, checks int",
    )
    states = files.select(reports.file_state(*map(F.col, files.columns), F.lit(90.0), F.lit(True)).alias("s"))
    assert [r.s for r in states.collect()] == ["processing", "pending", "unprocessable", "published", "ok", "below", "below"]


def test_pages(spark):
    say = "The pipe of 25 mm carries 120/120/1 and 20 litres over a distance that is long enough to count."
    src = spark.createDataFrame([("d", 1, say), ("d", 2, say), ("d", 3, "Same 7")], "rel string, page long, text string")
    md = spark.createDataFrame([("d", 1, say.replace("25 mm", "mm")), ("d", 3, "Same 7 " + "note " * 12)], "rel string, page long, text string")
    r = pages.report(pages.check_pages(src, md)).first().report
    assert r.missing == [2] and [x.page for x in r.low] == [1, 2] and [x.page for x in r.extra] == [3] and r.number_pages[0]["items"] == ["25"] and r.status == "FAIL"
    assert pages.report(pages.check_pages(src, src)).first().report.status == "PASS"
    cases = spark.createDataFrame(
        [
            (["4554", "0", "03"], ["0.4554", "0.03"]),
            (["120/120/1", "20"], ["120/120/120"]),
            (["5"], []),
            (["0", "0", "4554", "03"], ["0.4554", "0.03"]),
        ],
        "gone array<string>, spare array<string>",
    )
    got = [r.x for r in cases.select(pages.unexplained("gone", "spare").alias("x")).collect()]
    assert got[1] == [] and got[2] == ["5"] and got[3] == []


def test_markdown(spark):
    df = spark.createDataFrame([("---\ntitle: x\naudit_status: failed\nverified: no\naccuracy: 1\n---\nbody", 'An "A"')], "t string, who string")
    out = df.select(markdown.accepted(F.col("t"), F.col("who"), F.lit("today"), F.lit(91.5), F.lit(True)).alias("x")).first().x
    assert out == '---\ntitle: x\naudit_status: human_accepted\nverified: "accepted by An \\"A\\" on today at 91.5% accuracy (did not pass the automatic checks)"\naccuracy: 91.5\naccepted_by: "An \\"A\\""\naccepted_at: "today"\n---\nbody'
    line = spark.createDataFrame([("| a \\| b | c |",), ("|---|---|",), ("prose",)], "l string").select(pages.blocks(F.col("l")).alias("x")).collect()
    assert [r.x for r in line] == [["a | b", "c"], None, None]
    assert spark.createDataFrame([("ＡＢ－Ｃ “x”  *y*",)], "t string").select(markdown.grounding(F.col("t")).alias("x")).first().x == 'ab-c "x" y'


def test_readings(spark):
    pairs = spark.createDataFrame(
        [
            ("a", 1, "one two three", "one two three", 0.95),
            ("a", 2, "1000 litres", "1600 litres", 0.99),
            ("a", 3, "25 m. wide", "25m. wide", 0.99),
            ("a", 4, "“x” – y", '"x" -- y', 0.99),
            ("a", 5, "x", None, 0.99),
            ("a", 6, "", "", 0.99),
        ],
        "rel string, page int, a string, b string, conf double",
    )
    got = {r.page: (r.agreement, r.decision) for r in readings.vote(pairs).collect()}
    assert got == {1: (1.0, "ok"), 2: (0.5, "review"), 3: (1.0, "ok"), 4: (1.0, "ok"), 5: (None, "review"), 6: (1.0, "review")}
    words = spark.createDataFrame([("a", 1, "the Ioad, 100", "the load, 700")], "rel string, page int, a string, b string")
    chosen = readings.by_glossary(words, spark.createDataFrame([("load",)], "word string")).collect()
    assert [(r.engine, r["at"], r.was, r.now) for r in chosen] == [("a", 1, "Ioad,", "load,")]


def test_structure(spark):
    p = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a\r", "b", "", "c\n", "\n"])], "rel string, page int, text string")
    texts = ["a\r", "b", "", "c\n", "\n"]
    assert [r.lines for r in structure.cumulative_lines(p).orderBy("page").collect()] == [len("\n".join(texts[: i + 1]).splitlines()) for i in range(5)]
    log = spark.createDataFrame(
        [
            ("r", 0, "4 documents"), ("r", 1, "[1] a.pdf"), ("r", 2, "verification: PASS"), ("r", 3, "[2] b.pdf"),
            ("r", 4, "OCR page 1/2"),
        ],
        "run string, n int, line string",
    )
    r = structure.run_status(log).first()
    assert (r.total, r["index"], r.file, r.passed, r.percent) == (4, 2, "b.pdf", 1, 38.8)
    rows = spark.createDataFrame([("g", i, i % 7) for i in range(100)], "grp string, id int, v int")
    assert {
        (r.id, r.position) for r in state.numbered(rows, ["grp"], ["v", "id"]).collect()
    } == {(i, k + 1) for k, (_, i) in enumerate(sorted((i % 7, i) for i in range(100)))}


def test_numbers_exactly(spark):
    df = spark.createDataFrame([("25 mm and 300 mm",)], "t string")
    assert df.select(text.extract_numbers("t").alias("x")).first().x == ["25mm", "300mm"]

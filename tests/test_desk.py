import pytest

from provenmark.operators import desk


def status(spark, *lines):
    log = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run string, n int, line string")
    return desk.run_status(log).first()


def test_run_status_line_by_line(spark):
    lines = ["files to check: 8", "unchanged since last run: a", "[1] /in/a.pdf", "download 3 MB", "scanned document, 4 pages", "OCR page 3/4", "noise", ""]
    r = status(spark, *lines)
    assert (r.total, r["index"], r.file, r.stage, r.scan, r.page, r.pages, r.skipped, r.percent) == (8, 1, "/in/a.pdf", "ocr", True, 3, 4, 1, 24.7)
    r = status(spark, *lines, "verification: METADATA", "promoted a", "skip (format .zip)", "skip duplicate of b", "[2] /in/b.pdf")
    assert (r.metadata, r.skipped, r["index"], r.stage, r.scan, r.page, r.percent) == (1, 3, 2, "preparing", False, 0, 50.0)
    assert status(spark, "extracted 3", "verification: FAIL").stage == "next" and status(spark, "  verification: PASS ").stage == "uploading"
    r = status(spark, "hello")
    assert (r.total, r.stage, r.file, r.percent) == (0, "starting", "", 3.0)
    assert status(spark, "files to check: 2", "[1] a", "OCR page 5/?").percent == 5.0


def test_overview_of_nothing(spark):
    badges = spark.createDataFrame([], "rel string, state string, auto_score double, verdict string")
    r = desk.overview(
        badges,
        spark.createDataFrame([], "rel string, status string, salvage boolean"),
        spark.createDataFrame([], "rel string, decision string"),
    ).first()
    assert (r.files, r.trusted, r.unreviewed, r.mean_score, r.reviewed_pct, r.deferred, r.pending) == (0, 0, 0, None, 0.0, 0, 0)


def test_feed_is_newest_first(spark):
    rules = spark.createDataFrame(
        [(1, "l50", "150", "all", "ann", 5.0), (2, "x", "y", "all", "bob", None)],
        "num int, find string, replace string, scope string, by string, at double",
    )
    undone = spark.createDataFrame([(1, "a.pdf", "cat", 7.0)], "num int, rel string, by string, at double")
    calls = spark.createDataFrame(
        [("s", None, "adopted", "dan", 6.0), ("s", "b", None, "eve", 9.0)],
        "skill string, rel string, decision string, by string, at double",
    )
    files = spark.createDataFrame([("r", "c.pdf", "fay", 8.0), ("r", "d.pdf", None, None)], "room string, rel string, confirmed_by string, confirmed_at double")
    rooms = spark.createDataFrame([("r", "Room", "gil", 4.0)], "room string, name string, archived_by string, archived_at double")
    got = [tuple(r) for r in desk.audit_feed(rules, undone, calls, files, rooms).collect()]
    assert got == [
        (8.0, "fay", "accepted", "Room · c.pdf"),
        (7.0, "cat", "rule_undone", "#1 · a.pdf"),
        (6.0, "dan", "ai_adopted", "s · "),
        (5.0, "ann", "rule_created", "#1 l50 → 150 (all)"),
        (4.0, "gil", "archived", "Room"),
    ]
    assert desk.audit_feed(rules, undone, calls, files, rooms, 2).count() == 2


def test_notices_take_the_latest_run_of_a_room(spark):
    now, day = 100 * 86_400.0, 86_400.0
    runs = spark.createDataFrame(
        [
            (1, "a", "done", False, now - day), (2, "a", "error", False, now - 2 * day), (3, "b", "done", True, now - 29 * day),
            (4, "c", "done", False, now - 31 * day), (5, "a", "running", False, now), (6, "gone", "error", False, now),
        ],
        "id int, room string, status string, publish boolean, at double",
    )
    rooms = spark.createDataFrame(
        [("a", False, 2, 0, now - 5), ("b", True, 1, 1, now), ("c", False, 0, 3, now - 6)],
        "room string, archived boolean, unprocessable int, below int, at double",
    )
    budgets = spark.createDataFrame(
        [("x", 8.0, 10.0, "2024-01"), ("y", 7.9, 10.0, "2024-01"), ("z", 5.0, 0.0, "2024-01")],
        "skill string, spent double, budget double, month string",
    )
    rules = spark.createDataFrame(
        [(9, 4, True, True, None), (8, 4, True, False, None), (7, 1, False, True, 1.0)],
        "id int, reverts int, often_undone boolean, enabled boolean, at double",
    )
    read = spark.createDataFrame([("done:1",), ("done:1",)], "key string")
    got = {r.key: (r.type, r.tone, r.n, r.read) for r in desk.notices(runs, rooms, budgets, rules, read, now).collect()}
    assert got == {
        "done:1": ("done", "ok", None, True),
        "done:3": ("published", "ok", None, False),
        "bad:a:2": ("unprocessable", "bad", 2, False),
        "review:c:3": ("review", "warn", 3, False),
        "ai:2024-01:x": ("ai_budget", "ai", 80, False),
        "rule:9:4": ("rule_undone", "warn", 4, False),
    }
    assert [r.key for r in desk.notices(runs, rooms, budgets, rules, read, now, 1).collect()] == ["ai:2024-01:x"]


@pytest.mark.parametrize(("adopted", "rejected", "wrong_days", "words", "missing"), [
    (298, 2, None, 1, []), (290, 10, None, 1, ["adoption"]), (299, 0, None, 1, ["decided"]), (300, 0, 89, 1, ["wrong"]), (300, 0, 91, 0, ["glossary"]), (0, 0, None, 1, ["decided", "adoption"]),
])
def test_eligibility(spark, adopted, rejected, wrong_days, words, missing):
    now = 1000 * 86_400.0
    calls = spark.createDataFrame(
        [
            ("s", d, by) for d, by, n in (
                ("adopted", "p", adopted), ("rejected", None, rejected), ("rejected", "evaluation", 50), (None, "p", 3),
            ) for _ in range(n)
        ],
        "skill string, decision string, by string"
    )
    rules = spark.createDataFrame(
        [("s", True, "wrong", now - wrong_days * 86_400)] if wrong_days else [("s", False, "wrong", now)],
        "skill string, auto boolean, check string, checked_at double",
    )
    r = desk.eligibility(calls, rules, spark.createDataFrame([("w",)] * words, "word string"), now).first()
    assert (r.missing, r.eligible, r.decided) == (missing, not missing, adopted + rejected)


def test_folders_and_engines(spark):
    names = [
        "10 Section D/02 Part D2 [D2D1–D2P9] p230-240.md",
        "10 Section D/01 Part D1 [D1O1] p212.md",
        "10 Section D/00 Intro p210-211.md",
        "Definitions [d1–d2].md",
    ]
    got = sorted(tuple(r) for r in desk.folder_map(spark.createDataFrame([("v", n) for n in names], "doc string, path string")).collect())
    assert got == [("v", "", None, None, None, None, 1), ("v", "10 Section D/", "D1O1", "D2P9", 210, 240, 3)]
    pages = spark.createDataFrame(
        [
            (d, p, e, acc, 1.0, 0.5) for d, p, e, acc in (
                ("blur", 1, "a", 0.9), ("blur", 2, "a", 0.7), ("blur", 1, "b", 0.9), ("blur", 2, "b", 0.9), ("skew", 3, "a", 1.0),
                ("skew", 3, "b", 0.6), ("skew", 3, "c", 0.99),
            )
        ],
        "degradation string, page int, engine string, char_acc double, char_recall double, num_recall double"
    )
    outcomes = spark.createDataFrame(
        [("blur", 1, "ok", 0.9), ("blur", 2, "ok", 0.8), ("skew", 3, "review", 0.1)],
        "degradation string, page int, status string, published_acc double",
    )
    summary, ranked = desk.benchmark(pages, outcomes)
    assert {(r.degradation, r.engine): (r.char_acc, r.pages, r.accepted, r.worst_accepted) for r in summary.collect()}[("blur", "a")] == (0.8, 2, 2, 0.8)
    assert [(r.engine, r.chosen, r.published) for r in ranked.orderBy("rank").collect()] == [("c", True, True), ("a", True, False), ("b", False, False)]

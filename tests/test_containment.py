import random

from provenmark.operators import containment, structure
from provenmark.operators.containment import check_grounds, contained
from provenmark.plans import registry

from .oracle import compare, connect


def test_equals_a_search_of_every_text(spark):
    rng = random.Random(8)
    syllables = ["fo", "x", "quick", "ü", "a", "1.2", "be", "(", "."]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts = [
        (i, i % 3, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randrange(12)))) for i in range(150)
    ] + [(200, 0, None), (201, 1, ""), (202, 2, " ")]
    wants = [(900 + i, s, f) for i, (s, f) in enumerate(((0, None), (1, ""), (2, " "), (0, "\n"), (1, " a"), (2, "a ")))]
    for k in range(300):
        t = rng.choice(texts)[2] or "none"
        a = rng.randrange(len(t) or 1)
        wants.append((k, k % 3, t[a : a + rng.choice([1, 2, 3, 5, 8, 13, 40])]))
    wants += [(k, s, f) for k, s, f in wants[:5]]
    a, b = spark.createDataFrame(texts, "id long, part int, text string"), spark.createDataFrame(wants, "ask long, part int, find string")
    got = sorted(tuple(r) for r in contained(a, b, ["id"], ["ask"], ("part",)).collect())
    want = sorted({(p, k, i) for k, p, f in wants for i, q, t in texts if p == q and f is not None and t is not None and f in t})
    assert got == want and len(got) > 1000
    got = sorted(tuple(r) for r in contained(a, b.drop("part").where("ask < 50"), ["id"], ["ask"]).collect())
    assert got == sorted({(k, i) for k, p, f in wants if k < 50 for i, q, t in texts if f is not None and t is not None and f in t})


def test_no_product_of_both_sides(spark):
    a, b = spark.createDataFrame([(1, "quick foxes ran far")], "id int, text string"), spark.createDataFrame(
        [(1, "quick fox"), (2, "k foxes r"), (3, "")],
        "ask int, find string",
    )
    plan = contained(a, b, ["id"], ["ask"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_headings_that_are_short_or_in_pieces(spark):
    rows = [
        ("a", 1, 1, "Aim of this part"), ("a", 1, 2, "1.2 Scope"), ("a", 2, 1, "Fir"), ("a", 2, 2, "e safety"), ("a", 3, 1, "Ge"),
        ("a", 3, 2, "ner"), ("a", 3, 3, "al"),
    ]
    entries = [
        ("a", 1, "Aim", 1), ("a", 2, "1.2", 2), ("a", 3, "Fire safety", 2), ("a", 4, "General", 3), ("a", 5, "Gene", 3),
        ("a", 6, "Aim", 3), ("a", 7, "--", 1), ("a", 8, "Fire saf", 2),
    ]
    out = structure.unmatched_headings(
        spark.createDataFrame(entries, "rel string, seq int, title string, page int"),
        spark.createDataFrame(rows, "rel string, page int, y int, text string"),
    )
    assert sorted(r.seq for r in out.collect()) == [5, 6, 7, 8]


def test_audit_report_finds_texts_that_go_on(spark, tmp_path):
    bank = ["quick fox", "alpha", "nowhere to be found", "tail"]
    docs = [(0, "the quick foxes ran", "en", "s", 19), (1, "alpha beta", "en", "s", 10), (2, "curtails", "en", "s", 8)]
    spark.createDataFrame(list(enumerate(bank)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = registry.queries()["v8_audit_report"], registry.oracle_sql()["v8_audit_report"]
    con = connect(tmp_path / "none")
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), query, sql) is None
    assert {r.subject for r in query(spark, str(tmp_path)).collect() if r.report == "not grounded"} == {"2"}


def _bank(spark, published, *grounds):
    grounds = spark.createDataFrame(
        [(1, *g) for g in grounds],
        "question int, doc string, page int, contains array<string>, clause string, unreadable boolean, absent string, edition "
        "string"
    )
    pages = spark.createDataFrame(
        [("Vol.pdf", 1, "Cover"), ("Vol.pdf", 2, "D3D14 maximum  riser 190 mm and minimum\n115 mm, the ﬁnal ‘size’")],
        "doc string, page int, text string",
    )
    units = spark.createDataFrame([("Vol.pdf", 2, published)], "doc string, page int, text string")
    files = spark.createDataFrame(
        [("Vol/Vol · 01 Part D3 [D3D14] p2.md", "Vol.pdf", ["D3D14"], "published")],
        "path string, doc string, clauses array<string>, edition string",
    )
    questions = spark.createDataFrame([(1,)], "question int")
    return sorted((r.problem, r.subject) for r in check_grounds(questions, grounds, pages, units, files).collect())


def test_bank_on_both_sides(spark):
    md = "D3D14 maximum riser **190 mm** | and minimum 115 mm, the final 'size'"
    assert _bank(spark, md, ("Vol.pdf", 2, ["190 mm", "115 mm", "FINAL 'size'"], "D3D14", False, None, None)) == []
    assert _bank(
        spark,
        "D3D14 maximum riser 190 mm and minimum",
        ("Vol.pdf", 2, ["115 mm"], None, None, None, None),
    ) == [("not in the published text", "115 mm")]
    assert _bank(spark, "anything", ("Vol.pdf", 2, ["200 mm"], None, None, None, None)) == [
        ("not in the published text", "200 mm"),
        ("not on the source page", "200 mm"),
    ]
    assert _bank(spark, md, ("Vol.pdf", 1, ["cover"], "D9", True, None, None)) == [("clause not listed", "D9"), ("no marker", None), ("no unit", None)]
    assert _bank(spark, "The formula is not readable", ("Vol.pdf", 2, [], None, True, None, None)) == []


def test_bank_absence_edition_and_no_ground(spark):
    assert _bank(spark, "x", (None, None, None, None, None, "3500.2", None)) == []
    assert _bank(spark, "x", (None, None, None, None, None, "part d3", None)) == [("is in the library", "Vol/Vol · 01 Part D3 [D3D14] p2.md")]
    assert _bank(spark, "x", ("Vol.pdf", None, None, None, None, None, "draft")) == [("edition not found", "draft")]
    assert _bank(spark, "x", ("Vol.pdf", None, None, None, None, None, "published")) == []
    assert _bank(spark, "x") == [("no ground", None)]


def test_scopes_of_few_wants_need_no_words(spark, monkeypatch):
    """such a scope is searched as it stands; one that asks for more goes by words, with the same rows."""
    a = spark.createDataFrame([(p, i, f"quick foxes {i} ran far {p}") for p in range(4) for i in range(9)] + [(None, 1, "quick")], "part int, id int, text string")
    b = spark.createDataFrame([(p, k, f) for p in range(4) for k, f in enumerate((f"foxes {p} ran", "far", "", "x 1")[: p + 1])], "part int, ask int, find string")
    found = lambda: contained(a, b, ["id"], ["ask"], ("part",))
    assert "Generate" not in found()._jdf.queryExecution().executedPlan().toString()
    want = sorted(tuple(r) for r in found().collect())
    monkeypatch.setattr(containment, "FEW", 2)
    assert "Generate" in found()._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found().collect()) == want and len(want) > 40


def test_a_part_is_looked_up_by_a_long_stretch(spark, monkeypatch):
    """names that share short stretches meet no more wants than hold them."""
    kept, seen = containment.written, []
    monkeypatch.setattr(containment, "written", lambda df: seen.append(kept(df)) or seen[-1])
    a = spark.createDataFrame([(i, f"src1/en/doc_{i}.pdf") for i in range(1000, 1400)], "id int, text string")
    b = spark.createDataFrame([(i, f"oc_{i * 3}.p") for i in range(300, 500)], "ask int, find string")
    got = sorted(tuple(r) for r in contained(a, b, ["id"], ["ask"]).collect())
    assert got == [(i, i * 3) for i in range(300, 500) if 1000 <= i * 3 < 1400]
    assert all(t.count() <= 400 for t in seen)


def test_a_ground_is_checked_once(spark):
    """pages and units are formed once, whatever their grounds can lack."""
    q = spark.createDataFrame([("q",)], "question string")
    g = spark.createDataFrame([("q", "d", 1, ["wet", None, "dry"], "C", True, None, None), ("q", "d", 2, None, None, None, None, None)], "question string, doc string, page long, contains array<string>, clause string, unreadable boolean, absent string, edition string")
    t = spark.createDataFrame([("d", 1, "ＷＥＴ **fish**")], "doc string, page long, text string")
    f = spark.createDataFrame([("d", "d", ["C"], "published")], "path string, doc string, clauses array<string>, edition string")
    out = check_grounds(q, g, t, t, f)
    assert sorted((r.problem, r.page, r.subject) for r in out.collect()) == [
        ("no marker", 1, None), ("no unit", 2, None), ("not in the published text", 1, "dry"), ("not on the source page", 1, "dry"),
    ]
    assert out._jdf.queryExecution().executedPlan().toString().count("collect_list") <= 6


def test_affected_texts_are_searched_once(spark):
    """places are counted where a text is found; no second join of all texts."""
    from provenmark.operators import records

    docs = spark.createDataFrame([("a", "on and on"), ("b", "off")], "rel string, text string")
    rules = spark.createDataFrame([(1, "on"), (2, "off")], "id int, find string")
    out = records.affected(docs, rules, spark.createDataFrame([(1, "a"), (1, "b")], "id int, rel string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 2), (1, "b", 0), (2, "b", 1)]
    assert "text" not in out._jdf.queryExecution().optimizedPlan().toString()

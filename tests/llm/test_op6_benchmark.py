from provenmark.llm import op6_benchmark as B

from .small import CASES, SCHEMA, frame, save

ITEMS = [
    (1, "A train leaves Boston at 40 km per hour and reaches Albany after 3 hours. How far is Albany from Boston in the end?"),
    (2, "the quick brown fox jumps over the lazy dog while nine other animals watch from the hill"),
    (3, None),
    (4, ""),
    (5, "two words"),
    (6, "x " * 50),
    (1, "A train leaves Boston at 40 km per hour and reaches Albany after 3 hours. How far is Albany from Boston in the end?"),
]
FILL = "Some other prose stands here with plenty of plain words that no test has ever asked about. "
DOCS = [
    (10, FILL + ITEMS[0][1] + " " + FILL, "en", "s", 0),
    (11, FILL + "A train leaves Denver at 55 km per hour and reaches Dallas after 7 hours. How far is Dallas from Denver in the end? " + FILL, "en", "s", 0),
    (12, FILL + "A train leaves Denver at 55 km per hour and reaches Dallas after 7 hours. How far is Lisbon from Madrid in the end? " + FILL, "en", "s", 0),
    (13, FILL * 3, "en", "s", 0),
    (14, FILL + ITEMS[1][1].upper() + ". " + FILL, "en", "s", 0),
    (15, FILL + "the quick brown fox jumps over the lazy dog. " + FILL, "en", "s", 0),
    (16, "we spoke in two words or more of it", "en", "s", 0),
    (17, "two words", "en", "s", 0),
    (10, FILL + ITEMS[0][1] + " " + FILL, "en", "s", 0),
]


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_planted(spark, tmp_path):
    save(frame(spark, CASES + DOCS), tmp_path)
    save(spark.createDataFrame(ITEMS, "item_id long, text string"), tmp_path, "benchmark")
    found = B.op6_decontaminate(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(10, 1), (11, 1), (14, 2), (17, 5)}
    assert {r.doc_id for r in found} <= {10, 11, 14, 17}
    assert {r.doc_id: r.exact for r in found if r.item_id == 1} == {10: True, 11: False}
    kept = B.drop_contaminated(frame(spark, CASES + DOCS), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert sorted(r.doc_id for r in kept if (r.doc_id or 0) >= 10) == [12, 13, 15, 16] and len(kept) == len(CASES) + 4


def test_lists_of_slots(spark):
    """Places in a list meet their neighbours too; only the alignment counts."""
    item = "Sort these: 12 7 3 9 15 4 8 22 1 6 and say which of them comes out in the middle"
    other = "Sort these: 13 9 5 2 16 7 8 30 4 1 and say which of them comes out in the middle"
    mixed = "Sort these: 13 13 5 2 16 13 8 30 4 1 and say which of them comes out in the middle"
    docs = [(i, FILL + x + " " + FILL, "en", "s", 0) for i, x in enumerate([item, other, mixed])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: (r.n_windows == r.item_windows, r.exact) for r in B.contaminated(frame(spark, docs), bench).collect()}
    assert found == {0: (True, True), 1: (True, False)}


def test_names_that_open_sentences(spark):
    items = [(1, "Tom has 5 apples. Tom gives 2 to Ann. How many apples does Tom have?"), (2, "Yesterday the shop of Mary sold 14 red hats and 9 blue ones, so what did Mary earn in all?")]
    docs = [
        (0, FILL + "Bob has 7 apples. Bob gives 3 to Sue. How many apples does Bob have? " + FILL, "en", "s", 0),
        (1, FILL + "Bob has 7 apples. Sue gives 3 to Bob. How many apples does Ann have? " + FILL, "en", "s", 0),
        (2, FILL + "Yesterday the shop of Mary Ann Smith sold 11 red hats and 6 blue ones, so what did Mary Ann Smith earn in all? " + FILL, "en", "s", 0),
        (3, FILL + "Yesterday the shop of Mary Ann Smith sold 11 red hats and 6 blue ones, so what did John earn in all? " + FILL, "en", "s", 0),
        (4, items[0][1], "en", "s", 0),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.exact for r in B.contaminated(frame(spark, docs), bench).collect()}
    assert {x for x in found if x != (3, 2)} == {(0, 1), (2, 2), (4, 1)} and found[4, 1] and not found[0, 1]


def test_alignment_over_an_insertion():
    hit = lambda i, p, a, b: {"item_place": i, "place": p, "same": False, "slots": [{"kinds": 1, "item_words": a, "words": b}]}
    nodes = [hit(i, i + 5, "1", "4") for i in range(4)] + [hit(i, i + 6, "2", "5") for i in range(6, 10)] + [hit(5, 9, "3", "5")]
    assert B.longest(nodes, 6, 10, True) == 8 and B.longest(nodes, 9, 10, True) == 0


def test_shuffled_way_agrees(spark, tmp_path):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, CASES + DOCS)
    assert pairs(B.contaminated(docs, bench, max_windows=0)) == pairs(B.contaminated(docs, bench))


def test_given_tables_have_exact_leaks(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = pairs(B.op6_decontaminate(spark, "/root/testdata/sf0.001"))
    assert got >= want and {d for d, _ in got} == {d for d, _ in want}


def test_empty(spark, tmp_path):
    save(spark.createDataFrame([], SCHEMA), tmp_path)
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    assert B.op6_decontaminate(spark, str(tmp_path)).count() == 0
    save(frame(spark), tmp_path)
    assert B.op6_decontaminate(spark, str(tmp_path)).count() == 0

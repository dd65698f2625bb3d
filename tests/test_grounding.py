from provenmark.plans import registry

from .oracle import compare, connect


def test_first_and_last_words_go_on_in_the_page(spark, tmp_path):
    grounds = ["hello world", "extraordinary tale of it", "it was an extraordinary", "single", "no such text here", "", None]
    texts = [
        "He wrote (hello   World) there", "An (extraordinary tale of it!) was told", "so it was an extraordinary-looking day",
        "singled out", "other", "", None,
    ]
    spark.createDataFrame(list(enumerate(grounds)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = registry.queries()["j16_grounding"], registry.oracle_sql()["j16_grounding"]
    con = connect(tmp_path / "none")
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), query, sql) is None
    assert {r.item_id: r.pages for r in query(spark, str(tmp_path)).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 6, 6: 0}

"""Registered queries against their SQL on small tables with what the given ones hardly have."""

import duckdb
import pytest

from provenmark.plans import registry

from .oracle import compare

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def differs(spark, folder, name, texts):
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, KINDS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return compare(spark, con, folder, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["a2_page_verification", "a3_unit_verification", "p26_report_parts", "p27_outcomes"])
def test_missing_numbers_count_each(spark, tmp_path, name):
    """Two numbers of a line that is gone count, though another line of the page, written twice, has them as one."""
    page = "one 1 apart from 2\nsome words\n12 is written twice\nplain\nplain"
    assert differs(spark, str(tmp_path), name, [page] * 25) is None


def test_all_findings_of_a_long_document(spark, tmp_path):
    """Over 30 pages with findings of a kind, over 200 findings in all."""
    texts = ["\n".join(f"line {i} of {k} holds {i * 7} and some words" for i in range(1_200)) for k in range(3)]
    assert differs(spark, str(tmp_path), "p30_findings", texts) is None


@pytest.mark.parametrize("name", ["v1_reading_vote", "v5_adoptable_answers"])
def test_readings_of_lines_that_repeat_themselves(spark, tmp_path, name):
    """Words of both readings stand at the same place; longest blocks first would lose some of them."""
    texts = [" ".join(["la", "el", "x", "la", "b", "l", "el"][(i * i + k) % 7] for i in range(60 + k)) for k in range(120)]
    assert differs(spark, str(tmp_path), name, [f"{t}\n" * 16 + t for t in texts]) is None


def test_repeated_lines_of_odd_texts(spark, tmp_path):
    """documents without a line, other breaks than line feeds, separators at the ends of a line, and shares that lie between two roundings."""
    said = "a a a a b c d"
    odd = ["", "  \n \n", None, "\u00a0\n\u3000", "\t", f"{said}\rx\u2028y\x0bz", f"one two\x0c{said}\n\u2003x y", f"a\u00a0{said}", f"\u00a0a {said}\u00a0", "a\x0ba a a a b c d"]
    texts = [*odd, "\n".join([said] * 41 + ["x"] * 5079), said, "x"]
    rows = [(None if i > len(odd) else i, t, "en", "src0", 0) for i, t in enumerate(texts)] + [(0, said, "en", "src0", 0)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert con.execute(f"SELECT count(*) FROM ({registry.oracle_sql()['p9_dup_ratio']})").fetchone()[0] == 9
    query, sql = registry.queries()["p9_dup_ratio"], registry.oracle_sql()["p9_dup_ratio"]
    assert compare(spark, con, str(tmp_path), query, sql) is None
    got = {r.doc_id: r.dup for r in query(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(sql).fetchall()) and got[len(odd)] == 0.008007812  # to the last digit


def test_states_of_documents_with_many_odd_pages(spark, tmp_path):
    """eighty of a thousand pages hold more than their source; thirty of them would still be well enough."""
    kind = lambda k, n: (k * 31 + n) % 10
    line = lambda k, n: "" if kind(k, n) < 2 else "x" * 60 if kind(k, n) == 2 and n < 800 else "some words of a line"
    assert differs(spark, str(tmp_path), "p29_file_states", ["\n".join(line(k, n) for n in range(5_000)) for k in range(10)]) is None
    got = {r.rel: r.state for r in registry.queries()["p29_file_states"](spark, str(tmp_path)).collect()}
    assert [got[f"src0/en/doc_{k}.pdf"] for k in (1, 3, 7, 9)] == ["below"] * 4

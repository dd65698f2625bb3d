import importlib
from collections import Counter

import corpus_pipeline as P
from provenmark.llm import op1_mixing, op8_quality

from . import test_op4_repeats as T4
from . import test_op10_near as T10
from .small import CASES, SCHEMA, frame, save, words
from .test_op6_benchmark import DOCS, ITEMS
from .test_op8_quality import MORE


def test_stages_against_brute_force(spark, tmp_path):
    rows = CASES + MORE + T10.corpus()[11:40] + [(r[0] + 10_000, *r[1:]) for r in T4.corpus()[10:30]] + DOCS
    docs = frame(spark, rows, extra=False)
    folder = save(docs, tmp_path)
    save(spark.createDataFrame(ITEMS, "item_id long, text string"), tmp_path, "benchmark")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "source_mix"]
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        now = stage(spark, now, folder)
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
        if name != "source_mix":
            assert sorted(now.columns) == sorted(docs.columns)
    judged = {r.text: r.quality.kept for r in op8_quality.judge(docs.select("text")).collect()}
    assert len(seen["quality_rules"]) == sum(judged[r[1]] for r in rows)
    classes = T10.brute([(r.doc_id, r.text) for r in seen["quality_rules"]])
    assert Counter(r.doc_id for r in seen["near_duplicates"]) == Counter({c for _, c in classes})
    removed = {d: n - gone for d, n, gone, *_ in T4.brute([(r.doc_id, r.text) for r in seen["near_duplicates"]])}
    for r in seen["repeated_passages"]:
        assert abs(len(r.text.encode()) - removed[r.doc_id]) <= 8 and r.n_chars == len(r.text)
    leaked = {r.doc_id for r in seen["repeated_passages"]} - {r.doc_id for r in seen["benchmark_leaks"]}
    assert leaked <= {10, 11, 14, 17}
    assert {r.doc_id: r.size for r in seen["source_mix"]} == {r.doc_id: len(words(r.text)) for r in seen["benchmark_leaks"]}
    assert sum(r.taken for r in seen["source_mix"]) >= 1.4 * sum(r.size for r in seen["source_mix"]) - 10 * op1_mixing.BLOCK
    again = P.run(spark, folder).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in seen["source_mix"])


def test_empty(spark, tmp_path):
    save(spark.createDataFrame([], SCHEMA), tmp_path)
    save(spark.createDataFrame(ITEMS, "item_id long, text string"), tmp_path, "benchmark")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    found = entry.queries()
    assert "pipeline" in found and {int(n[2:].split("_")[0]) for n in found if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= set(found)

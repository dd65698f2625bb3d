import numpy as np
import pyarrow as pa

from provenmark.llm import op2_toxicity as T
from provenmark.llm.words import buffers

from .small import CASES, SCHEMA, crc, frame, save

CLEAN = "river stone market garden window letter morning travel copper silent yellow basket".split()
BAD = ["blorgish", "snarvel", "grumtok"]


def corpus(n=240):
    drawn = np.random.default_rng(1)
    rows = []
    for i in range(n):
        text = list(drawn.choice(CLEAN, 60))
        if i % 3 == 0:
            for k in drawn.integers(0, 60, 2):
                text[k] = BAD[int(drawn.integers(0, 3))]
        rows.append((i, " ".join(text), "en", "s", 0))
    return rows


def test_held_out_and_misspellings(spark, tmp_path):
    rows = corpus()
    extra = [(1000, "river stone market " * 30 + "snarvell " + "garden window " * 30, "en", "s", 0), (1001, "river stone " * 300, "en", "s", 0)]
    save(frame(spark, rows + extra + CASES), tmp_path)
    save(spark.createDataFrame([(r[0], 1, int(r[0] % 3 == 0)) for r in rows] + [(5, 1, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = T.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra) + len(CASES)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 9}
    held = [i for i in range(9, 240) if crc(i) % 3 == 1]
    assert all(by[i].held_out == (i in held) for i in range(9, 240))
    assert np.mean([by[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    assert by[1000].predicted == 1 and by[1001].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert min(r.score for r in got if r.doc_id == 1) == 0 and [r.held_out for r in got if r.doc_id is None] == [False]
    again = {r.doc_id: r.score for r in T.op2_toxicity(spark, str(tmp_path)).collect() if r.doc_id is not None and r.doc_id >= 9}
    assert again == {k: r.score for k, r in by.items()}


def test_no_labels_and_empty(spark, tmp_path):
    save(frame(spark), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert {r.score for r in T.op2_toxicity(spark, str(tmp_path)).collect()} == {0.0}
    save(spark.createDataFrame([], SCHEMA), tmp_path)
    assert T.op2_toxicity(spark, str(tmp_path)).count() == 0


def test_features_are_the_words_own():
    one = T.Bags(*buffers(pa.array(["alpha beta", "beta"])))
    two = T.Bags(*buffers(pa.array(["beta"])))
    values = np.random.default_rng(0).normal(size=T.BUCKETS)
    assert np.allclose(sorted(one.word_means(values[:, None])[:, 0]), sorted([*two.word_means(values[:, None])[:, 0], *T.Bags(*buffers(pa.array(["alpha"]))).word_means(values[:, None])[:, 0]]))


def test_scores_by_brute_force():
    rows = corpus(60)
    model, scale, shift = T.train([r[1] for r in rows], np.array([r[0] % 3 == 0 for r in rows]).astype(int), rounds=5)

    def mean(word):
        bag = T.Bags(*buffers(pa.array([word])))
        return float(np.mean(model[bag.buckets].astype(float)))

    texts = [r[1] for r in rows[:8]] + ["snarvell", "River " * 7 + "stone"]
    want = []
    for t in texts:
        w = t.lower().split()
        best = max(np.mean([mean(x) for x in w[i : i + T.PASSAGE]]) for i in range(0, len(w), T.PASSAGE))
        want.append(1 / (1 + np.exp(-(scale * best + shift))))
    assert np.allclose(T.score_batch((model, scale, shift), *buffers(pa.array(texts))), want)


def test_held_out_labels_of_the_given_documents(spark):
    """Recall of held-out toxic texts in four languages, from some 300 toxic texts learned; English has two thirds of them."""
    sf = "/root/testdata/sf0.1"
    got = T.op2_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.75 and np.mean([r.predicted for r in toxic if r.lang == "en"]) > 0.85
    assert np.mean([r.predicted for r in clean]) < 0.025

import random

import pytest

from provenmark.llm import op7_tokens as K

from .small import CASES, SCHEMA, frame, save

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
ODD = [(100 + i, t, "en", "z", 0) for i, t in enumerate(["a<|endoftext|>b", "<|endoftext|>", "don't  stop\n\n now", "  two", "tab\t\tend ", "1234 ½ ² ③", "日本語のテキスト", "\x1c\x1d a \x85 b\u2028c\u3000d", "e\u0301 combining", "😀😀 emoji", "it's we'll they've I'm", "A" * 3000, "\u00ad soft", "\ufeffbom", "ʼn'S"])]


def test_same_as_the_library(spark, tmp_path):
    rows = CASES + ODD
    library = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in K.op7_token_counts(spark, save(frame(spark, rows), tmp_path)).collect())
    want = []
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), n, n > 1024))
    assert got == sorted(want)


def test_given_documents(spark):
    library = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in K.op7_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in text.items()}


def test_memory_bound_and_empty(spark, tmp_path):
    path = str(public.path("byte_bpe_50k.json"))
    counter = K.Counter(path, K.whole_tokens(path), memory=10)
    library = tokenizers.Tokenizer.from_file(path)
    for i in range(50):
        text = f"zqxv{i} qqzzx{i * 7} vvkkj{i}"
        assert counter.count(text) == len(library.encode(text).ids)
        assert len(counter.spaced) <= counter.room + 20
    assert K.op7_token_counts(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0


def test_pieces_count_like_whole_texts():
    path = str(public.path("byte_bpe_50k.json"))
    counter, library = K.Counter(path, K.whole_tokens(path)), tokenizers.Tokenizer.from_file(path)
    drawn = random.Random(5)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "12", "\u00e9", ".", "!?", "\u00a0", "\u200b", "\u3000", "\u4e2d", "\x85", "e\u0301", "\r\n", "\U0001f600", "_", " x", " \n", "\u00aa", "\u0345"]
    for _ in range(5000):
        text = "".join(drawn.choices(parts, k=drawn.randint(0, 12)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_merges_agree_with_the_library_on_strings_like_words():
    path = str(public.path("byte_bpe_50k.json"))
    singles, library, drawn = K.whole_tokens(path), tokenizers.Tokenizer.from_file(path), random.Random(6)
    merge = K.merger(path, singles)
    pool = sorted(singles)
    for _ in range(5000):
        word = "".join(drawn.choices(pool, k=drawn.randint(2, 4))).strip()
        if len(K.regex.findall(K.PRE_TOKEN, word)) == 1:
            assert list(merge(word)) == library.encode(word, add_special_tokens=False).ids

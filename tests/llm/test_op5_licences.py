import re
from collections import Counter

from provenmark.llm import op5_licences as L

from .small import CASES, SCHEMA, frame, save

FILL = "River stones and market gardens fill the morning with quiet work."
DOCS = [
    (100, f"{FILL}\nLicensed under the Apache License, Version 2.0.\n{FILL}", "en", "s", 0),
    (101, f"{FILL}\nReleased under the MIT License.", "en", "s", 0),
    (102, "This work is licensed under the GNU General Public License, version 3.", "en", "s", 0),
    (103, f"Licensed under CC BY-NC 4.0.\n{FILL}", "en", "s", 0),
    (104, f"{FILL}\nThe clerk may license the van if permission is given.\n{FILL}", "en", "s", 0),
    (105, f"{FILL} {FILL}", "en", "s", 0),
    (107, f"{FILL} Copyright (c) 2024 Example Corp. Released under the MIT License. {FILL}", "en", "s", 0),
    (108, f"MIT License\n\n{FILL}", "en", "s", 0),
    (109, " ".join([f"{FILL[:-1]}"] * 40 + ["licensed under the mozilla public license version 2 0"] + [f"{FILL[:-1]}"] * 40), "en", "s", 0),
    (106, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in it", "en", "s", 0),
]
WANT = Counter({(100, 1, "Apache"): 1, (101, 1, "MIT"): 1, (102, 0, "GPL"): 1, (103, 0, "CC-BY-NC"): 1, (106, 0, "MIT"): 1, (107, 0, "MIT"): 1, (108, 0, "MIT"): 1})


def test_planted(spark, tmp_path):
    prose = [(200 + i, " ".join(f"{w}{(i * k) % 37}" for k, w in enumerate("alpha beta gamma delta omega".split() * 4)), "en", "s", 0) for i in range(60)]
    got = L.op5_licence_scan(spark, save(frame(spark, CASES + DOCS + prose), tmp_path)).collect()
    assert Counter((r.doc_id, r.paragraph_no, r.family) for r in got if r.doc_id != 109) == WANT
    assert {(r.paragraph_no, r.family) for r in got if r.doc_id == 109} == {(0, "MPL")}
    assert all(0.5 <= r.probability <= 1 and 0 <= r.similarity <= 1 for r in got)


def test_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache", "Released under the MIT License.": "MIT"}
    want = Counter((d, i, lines[x]) for d, t in docs.items() for i, x in enumerate(t.split("\n")) if x in lines)
    got = Counter((r.doc_id, r.paragraph_no, r.family) for r in L.op5_licence_scan(spark, "/root/testdata/sf0.001").collect())
    assert got == want


def test_empty(spark, tmp_path):
    assert L.op5_licence_scan(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0


def test_every_telling_gram_has_a_word_of_the_cover():
    long, short = L.cover()
    for texts in L.TEMPLATES.values():
        for g in (g for t in texts for g in L.telling(t)):
            assert any(x in g.split() for x in long) or re.search(short.replace(r"\p{L}\p{N}", "a-z0-9"), g), g


def test_the_pre_test_changes_nothing(spark, tmp_path):
    docs = frame(spark, CASES + DOCS + [(300, f"License {FILL} warranty\nthis copyright", "en", "s", 0)])

    def rows(tested):
        return sorted(tuple(r) for r in L.scan(docs, tested=tested).select("doc_id", "paragraph_no", "statement_no", "window_no", "family", "similarity").collect())

    assert rows(True) == rows(False)


def test_statements_by_brute_force(spark):
    said = L.statements(frame(spark, CASES + DOCS), tested=False).collect()
    want = Counter()
    for d, text, *_ in CASES + DOCS:
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            for j, s in enumerate(re.split(L.SENTENCE, line)):
                w = re.findall(r"[^\W_]+", s.lower())
                for k, a in enumerate(range(0, max(1, len(w) - L.WINDOW // 2), L.WINDOW // 2)):
                    if w:
                        want[d, i, j, k, tuple(w[a : a + L.WINDOW])] += 1
    assert Counter((r.doc_id, r.paragraph_no, r.statement_no, r.window_no, tuple(r["__w"])) for r in said) == want


def test_variants_are_found_and_prose_is_left_alone(spark):
    """Notices as they stand in the wild: reworded ends, other versions, other case, inside a sentence of their own."""
    notices = [
        ("Apache", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"),
        ("Apache", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
        ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the disclaimer below."),
        ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 License."),
        ("GPL", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of the program"),
        ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1"),
        ("public-domain", "This is free and unencumbered software released into the public domain by its author"),
    ]
    rows = [(i, f"{FILL} {t}", "en", "s", 0) for i, (_, t) in enumerate(notices)] + [(100 + i, t, "en", "s", 0) for i, t in enumerate(("The licence of the pub was free of charge.", "All rights of the author are free software for the public.", "A copy of the notice is in the documentation and other materials."))]
    got = {(r.doc_id, r.family) for r in L.scan(frame(spark, rows)).collect()}
    assert len(got & {(i, f) for i, (f, _) in enumerate(notices)}) >= 7
    assert not {d for d, _ in got if d >= 100}


def test_background_is_all_that_can_be_asked_about(spark):
    """Every text counts, however many there are: 900 texts of one statement each, all of them different."""
    rows = [(i, f"Stones of the river number {i} have no warranty here", "en", "s", 0) for i in range(900)] + [(1000, "Released under the MIT License.", "en", "s", 0)]
    found = {" ".join(r["__w"]) for r in L.background_of(L.statements(frame(spark, rows + rows))).collect()}
    assert found == {f"stones of the river number {i} have no warranty here" for i in range(900)}


def test_the_threshold_comes_from_both_halves(spark, monkeypatch):
    fitted, seen = L._fitted, []
    monkeypatch.setattr(L, "_fitted", lambda s, b: seen.append({r.h for r in b.collect()}) or fitted(s, b))
    background = L.background_of(L.statements(frame(spark, [(i, f"No warranty for stone {i}", "en", "s", 0) for i in range(60)])))
    assert 0.5 <= L.train(spark, background)[1] <= 0.9
    other, one, every = seen
    assert one | other == every and not one & other and len(every) == 60

import re
from collections import Counter

from provenmark.llm import op8_quality as Q

from .small import CASES, SCHEMA, frame, save, words

MORE = [
    (50, " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(20)), "en", "q", 0),
    (51, "a b c d e f g h i " * 9, "en", "q", 0),
    (52, "Same line here.\nSame line here.\n\n \nOther words.\nSame line here.", "en", "q", 0),
    (53, "# $ % & | < > * " * 10, "en", "q", 0),
    (54, "\n".join(f"Sentence number {i} has its own words {i * 3} and an end {i * 5}." for i in range(20)), "en", "q", 0),
    (55, "\n".join("Home%d | About%d | News%d | Shop%d | Help%d | More%d" % ((i,) * 6) for i in range(9)), "en", "q", 0),
]


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def fails(line):
    """The line rules, said once more in plain Python."""
    marks, parts = sum(c in "#*$%&|<>" for c in line), line.split(" ")
    separators = sum(c in "|»›•·" for c in line)
    shouts = len(re.findall(r"[!?]{2,}", line))
    return bool(
        words(line)
        and (
            marks * 12 > len(line)
            or (shouts and shouts * 3 >= len(parts))
            or (separators >= 3 and separators * 2 >= len(parts) - 1)
            or (len(line) < 40 and re.fullmatch(rf"\W*(?:{'|'.join(Q.MENU.values())})\W*", line, re.IGNORECASE))
            or any(p in line.lower() for phrases in Q.PHRASES.values() for p in phrases)
        )
    )


def cleaned(text):
    """(kept, text without failing lines)."""
    lines = (text or "").split("\n")
    bad = [fails(x) for x in lines]
    lost, whole = sum(len(x) for x, b in zip(lines, bad, strict=True) if b), sum(len(x) for x in lines if words(x))
    return not brute(text)[5] and lost <= 0.5 * whole, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b) if any(bad) else text


OTHER = [
    (70, "\n".join(["Wort und Satz über den Fluss und die Brücke am Morgen im Dorf"] + [f"Zeile {i} hat eigene Wörter {i * 7}" for i in range(9)] + ["Alle Rechte vorbehalten 2024", "Über uns", "Menü »"]), "de", "q", 0),
    (71, "\n".join([f"La phrase {i} parle de la rivière {i * 3} et du pont" for i in range(9)] + ["Conditions d'utilisation", "À propos", "Lire la suite !"]), "fr", "q", 0),
    (72, "\n".join([f"La frase {i} habla del río {i * 3} y de la torre" for i in range(9)] + ["Aviso legal y política de privacidad", "Iniciar sesión", "Leer más ??"]), "es", "q", 0),
]


def test_base_against_brute_force(spark, tmp_path):
    rows = CASES + MORE
    got = Q.op8_quality_rules(spark, save(frame(spark, rows), tmp_path)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(r[:7]) for r in got) == sorted(key((r[0], *brute(r[1]))) for r in rows)
    assert all(not r.kept for r in got if r.base_failed)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[54] and kept[4] is False and not kept[55] and kept[0] is False


def test_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in Q.op8_quality_rules(spark, "/root/testdata/sf0.001").collect():
        assert tuple(r[1:7]) == brute(docs[r.doc_id])


def test_lines_go_and_columns_stay(spark):
    out = Q.judge(frame(spark, [CASES[9]]).select("text", "key")).first()
    assert "Home" not in out.clean_text and "rights" not in out.clean_text and out.clean_text.count("\n") == 1 and out.key is None
    df = frame(spark, CASES + MORE + [(60, MORE[4][1] + "\nall rights reserved here", "en", "q", 0)])
    kept = Q.keep_good(df).collect()
    assert kept[0].asDict().keys() == df.first().asDict().keys()
    want = Counter((r[0], cleaned(r[1])[1]) for r in [*CASES, *MORE, (60, MORE[4][1] + "\nall rights reserved here")] if cleaned(r[1])[0])
    assert Counter((r.doc_id, r.text) for r in kept) == want and {54, 60} <= {d for d, _ in want}
    assert all("rights reserved" not in r.text for r in kept)


def test_empty(spark, tmp_path):
    assert Q.op8_quality_rules(spark, save(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0


def test_line_rules_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(frame(spark, CASES + MORE + OTHER), allowMissingColumns=True)
    got = Q.judge(docs.select("doc_id", "text")).collect()
    assert all((r.quality.kept, r.clean_text) == cleaned(r.text) for r in got)
    said = {r.doc_id: r.clean_text.split("\n") for r in got if r.doc_id in (70, 71, 72) and r.quality.kept}
    assert said.keys() == {70, 71, 72} and len(said[70]) == 10 and len(said[71]) == len(said[72]) == 9

"""P37 held against a plain reading of its rules."""

import random
import re

from pyspark.sql import functions as F

from provenmark.functions import markdown as M

WRAPPED = r"(\d+(?:/\d+)+)\n(\d{1,3})(?=\s|$)"


def spread(row):
    out, last = [], ""
    for c in row:
        last = last if c is None else c
        out.append(last)
    return out


def brute(rows):
    cell = lambda c: None if c is None else re.sub(WRAPPED, r"\1\2", re.sub(WRAPPED, r"\1\2", c)).replace("\n", " ").strip(" ")
    clean = [r for r in ([cell(c) for c in r] for r in rows) if any(r)]
    width = max(map(len, clean), default=0)
    clean = [r + [None] * (width - len(r)) for r in clean]
    is_note = lambda r: sum(c is not None for c in r) == 1 and len(r[0] or "") > 60
    notes, body = [r[0] for r in clean if is_note(r)], [r for r in clean if not is_note(r)]
    if not body:
        return [], notes
    two = len(body) > 2 and None in body[0][1:]
    head = spread(body[0])
    if two:
        head = [" — ".join(dict.fromkeys(x for x in pair if x)) for pair in zip(head, spread(body[1]), strict=True)]
    return [head] + [[c or "" for c in r] for r in body[2 if two else 1 :]], notes


def test_grids_by_brute_force(spark):
    rng = random.Random(3)
    cells = [None, "", " ", "a", "b c", "120/120/1\n20", "1/2\n3\n4", "50\n40", "x" * 61, "Name"]
    tables = [[[rng.choice(cells) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(0, 6))] for _ in range(300)]
    t = spark.createDataFrame(list(enumerate(tables)), "i int, rows array<array<string>>")
    got = {r.i: (r.g.grid, r.g.notes) for r in t.select("i", M.grid(F.col("rows")).alias("g")).collect()}
    assert got == {i: brute(rows) for i, rows in enumerate(tables)}


def test_a_step_is_named_once(spark):
    """Cells are cleaned at one place of the expression, however often later steps need them."""
    assert str(M.grid(F.col("cells"))).count("regexp_replace") == 3

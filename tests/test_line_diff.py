import difflib

from provenmark.operators import structure


def test_differences_leave_a_task_in_small_batches(spark):
    """one batch of many rows with many differences comes back whole and in order, with the other columns of its rows."""
    rows = [(k, "\n".join(f"line {i} of {k}" for i in range(40)), "\n".join(f"line {i * 2} of {k}" for i in range(40))) for k in range(900)]
    rows += [(900, None, "x"), (901, "x", None), (902, "same", "same"), (903, "\n".join(map(str, range(900))), ""), (904, "", None)]
    out = structure.line_diff(spark.createDataFrame(rows, "id long, old string, new string").coalesce(1))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r for r in out.collect()}
    for k, old, new in rows:
        if old != new:
            said = list(difflib.unified_diff((old or "").split("\n"), (new or "").split("\n"), lineterm="", n=2))[2:]
            ops = [("@", s) if s[:2] == "@@" else (s[:1], s[1:]) for s in said]
            r = got.pop(k)
            assert [tuple(x) for x in r["diff"]] == ops[:800]
            assert (r.added, r.removed, r.truncated) == (sum(o == "+" for o, _ in ops), sum(o == "-" for o, _ in ops), len(ops) > 800)
    assert not got

import json

import pytest
from pyspark.sql import functions as F

from provenmark.operators import structure
from provenmark.sources.tables import new_folder
from provenmark.streaming import jobs, logs, versions

ROWS = "k int, v int"


def last(rows):
    return rows.groupBy("k").agg(F.max("v").alias("v"))


def put(table, version, rows):
    return table.advance(version, {"t": (table.spark.createDataFrame(rows, ROWS), ["k"], last)})


def seen(table, version=None):
    return {r.k: r.v for r in table.read("t", table.spark.createDataFrame([], ROWS).schema, version).collect()}


def test_versions_keep_what_does_not_change(spark):
    folder = new_folder(spark, "tests")
    table = versions.Versions(spark, folder, buckets=8)
    assert table.numbers() == [] and seen(table) == {}
    assert put(table, 0, [(k, 0) for k in range(50)]) and put(table, 1, [(3, 5), (99, 1)])
    assert seen(table) == {k: 5 * (k == 3) for k in range(50)} | {99: 1} and seen(table, 0) == dict.fromkeys(range(50), 0)
    was, now = table._parts(0), table._parts(1)
    assert sum(was[b] != now[b] for b in was) <= 2
    assert put(table, 1, [(3, 9)]) is False and seen(table)[3] == 5  # a batch that runs again counts once
    assert put(table, 2, []) and seen(table)[99] == 1
    put(table, 3, [(k, 7) for k in range(200)])
    table.prune(1)
    assert table.numbers() == [3] and seen(versions.Versions(spark, folder, buckets=8)) == dict.fromkeys(range(200), 7)


def test_a_break_before_the_manifest_leaves_the_version_before(spark, monkeypatch):
    table = versions.Versions(spark, new_folder(spark, "tests"))
    put(table, 0, [(1, 1)])
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            put(table, 1, [(1, 2), (2, 2)])
    assert seen(table) == {1: 1}
    assert put(table, 1, [(1, 3)]) and seen(table) == {1: 3}


def event(kind, t, **more):
    return json.dumps({"type": kind, "t": t} | more) + "\n"


def listing(t, *rels):
    return event("listing", t, files=[{"rel": r, "kind": "pdf", "size": 5} for r in rels])


def files(follower):
    return {(r.room, r.rel): (r.activity, r.outcome, r.accuracy, r.confirmed) for r in follower.files().collect()}


def test_whole_lines_only_and_a_new_driver_goes_on(spark, tmp_path):
    folder = new_folder(spark, "tests")
    path = tmp_path / "logs"
    path.mkdir()
    assert logs.Follower(spark, str(path), folder).poll() is False
    (path / "a.jsonl").write_text(listing(1, "/a.pdf", "/ü.pdf") + event("start", 2, rel="/a.pdf") + '{"type": "fi', encoding="utf-8")
    assert logs.Follower(spark, str(path), folder).poll() is True
    assert files(logs.Follower(spark, str(path), folder)) == {("a", "/a.pdf"): ("processing", None, None, False), ("a", "/ü.pdf"): (None, None, None, False)}
    assert logs.Follower(spark, str(path), folder).poll() is False  # the half-written line waits
    with open(path / "a.jsonl", "a", encoding="utf-8") as f:
        f.write('le", "t": 3, "rel": "/a.pdf", "outcome": "result", "accuracy": 99.0}\r\n\nnot json\n' + event("published", 4, rel="/a.pdf"))
    (path / "b.jsonl").write_text(event("file", 9, rel="/x.pdf", outcome="unprocessable"), encoding="utf-8")
    assert logs.Follower(spark, str(path), folder).poll() is True
    got = files(logs.Follower(spark, str(path), folder))
    assert got[("a", "/a.pdf")] == (None, "result", 99.0, True) and got[("b", "/x.pdf")] == (None, "unprocessable", None, False)
    with open(path / "a.jsonl", "a", encoding="utf-8") as f:
        f.write(listing(5, "/new.pdf") + event("file", 6, rel="/a.pdf", outcome="result", accuracy=50.0) + event("unchanged", 7, rel="/new.pdf"))
    follower = logs.Follower(spark, str(path), folder)
    follower.poll()
    # a file without a result goes with the listing; one with a result stays and has to be confirmed anew
    assert files(follower) == {
        ("a", "/a.pdf"): (None, "result", 50.0, False),
        ("a", "/new.pdf"): (None, None, None, False),
        ("b", "/x.pdf"): (None, "unprocessable", None, False),
    }


def test_many_polls_over_many_splits_equal_the_whole_log(spark, tmp_path):
    said = "".join(
        event(
            ["start", "file", "published", "publish_failed", "unchanged"][i * 7 % 5],
            i,
            rel=f"/{i % 17}.pdf",
            outcome="result",
            accuracy=float(i),
        ) + (listing(i, *(f"/{j}.pdf" for j in range(i % 13))) if i % 40 == 0 else "") for i in range(400)
    ).encode()
    path, folder = tmp_path / "logs", new_folder(spark, "tests")
    path.mkdir()
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for end in (1000, 1001, 17_003, 30_000, len(said)):
            (path / "r.jsonl").write_bytes(said[:end])
            logs.Follower(spark, str(path), folder).poll()
        lines = spark.createDataFrame([("r", float(i), x) for i, x in enumerate(said.decode().splitlines())], "room string, n double, value string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    log = structure.events(lines).withColumn("seq", F.col("t") + F.when(F.col("type") == "listing", 0.5).otherwise(0.0))
    whole = {(r.room, r.rel): (r.activity, r.outcome, r.accuracy, r.confirmed) for r in structure.files_from_events(log).collect()}
    assert files(logs.Follower(spark, str(path), folder)) == whole and len(whole) == 17


def test_streams_go_on_by_name(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "id % 7 AS k", "CAST(id % 3 AS STRING) AS event_type", "id AS event_id")
    name, path = f"test-{tmp_path.name}", str(tmp_path / "in" / "rows")

    def stream():
        return jobs.follow(spark, path, rows(0, 0).schema)

    rows(0, 50).write.parquet(f"{path}1")
    assert jobs.latest_state(stream(), ["k"], "id", name).count() == 7
    assert jobs.drained(jobs.progress(stream()), "complete", f"{name}-n").agg(F.sum("n")).first()[0] == 50
    rows(50, 53).write.parquet(f"{path}2")
    assert {r.k: r.id for r in jobs.latest_state(stream(), ["k"], "id", name).collect()} == {k: max(i for i in range(53) if i % 7 == k) for k in range(7)}
    assert {
        r.event_type: (r.n, r.last_id) for r in jobs.drained(jobs.progress(stream()), "complete", f"{name}-n").collect()
    } == {str(t): (len(range(t, 53, 3)), max(range(t, 53, 3))) for t in range(3)}
    assert jobs.latest_state(stream(), ["k"], "id", name).count() == 7  # nothing new

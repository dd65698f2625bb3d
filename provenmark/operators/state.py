"""State as append-only logs folded to the latest row by key; selections, diffs and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by max_by so that copies combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*")


def numbered(rows: DataFrame, group: list[str], order: list[str], to: str = "position") -> DataFrame:
    """Rows with their number in their group by order (which must tell rows apart), however large a group is.

    Rows go to ranges of (group, order), so a hot group lies in many tasks; each task numbers its own and adds the counts of the tasks
    before, a table of one row a task and group.
    """
    placed = written(rows.repartitionByRange(*group, *order).withColumn("__task", F.spark_partition_id()))
    counts = placed.groupBy("__task", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = placed.withColumn("__i", F.row_number().over(Window.partitionBy("__task", *group).orderBy(*order)))
    return own.join(offsets, ["__task", *group]).withColumn(to, (F.col("__i") + F.col("__before")).cast("long")).drop("__task", "__i", "__before")


def exclusive_quantiles(rows: DataFrame, group: str, value: str, at: list[float]) -> DataFrame:
    """Quantiles at p * (n + 1) between neighbours, from counts of each value: only those are ordered, not the rows."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("cum", F.sum("c").over(Window.partitionBy(group).orderBy(value)))
    total = counts.groupBy(group).agg(F.sum("c").alias("n"))
    q = upto.join(total, group).withColumn("p", F.explode(F.array(*map(F.lit, at)))).withColumn("pos", F.col("p") * (F.col("n") + 1))
    q = q.withColumn("lo", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor("pos"))))
    holds = lambda rank: (F.col("cum") - F.col("c") < rank) & (rank <= F.col("cum"))
    part = F.when(
        holds(F.col("lo")),
        F.col(value) * (1 - (F.col("pos") - F.col("lo"))),
    ).otherwise(0) + F.when(holds(F.col("lo") + 1), F.col(value) * (F.col("pos") - F.col("lo"))).otherwise(0)
    return q.groupBy(group, "p").agg(F.round(F.sum(part), 6).alias(value))


def verdicts(log: DataFrame) -> DataFrame:
    """M2: log(rel, seq, to_state, reviewer) to the standing verdicts: none after an undo; rev_no counts rows since the last undo."""
    undo = log.groupBy("rel").agg(F.max(F.when(F.col("to_state").isNull(), F.col("seq"))).alias("undone"))
    since = log.join(undo, "rel").where(F.col("undone").isNull() | (F.col("seq") > F.col("undone")))
    return since.groupBy("rel").agg(
        F.max_by("to_state", "seq").alias("trust_state"),
        F.max_by("reviewer", "seq").alias("reviewer"),
        F.count(F.lit(1)).alias("rev_no"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, fields: list[str], key: str = "rel") -> DataFrame:
    """ADDED, REMOVED and CHANGED(field) between two listings."""
    o = old.select(key, F.lit(True).alias("__o"), *[F.col(f).alias(f"o_{f}") for f in fields])
    n = new.select(key, F.lit(True).alias("__n"), *fields)
    both = o.join(n, key, "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f)), F.lit(f"CHANGED({f})")) for f in fields]), lambda x: x.isNotNull())
    what = F.when(F.col("__o").isNull(), F.array(F.lit("ADDED"))).when(F.col("__n").isNull(), F.array(F.lit("REMOVED"))).otherwise(changed)
    return both.select(key, F.explode(what).alias("change"))


def duplicates(files: DataFrame) -> DataFrame:
    """files(rel, content_hash) that have the content of an earlier one; min and join, so a huge group is no window."""
    first = files.groupBy("content_hash").agg(F.min("rel").alias("first_rel"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return files.join(first, "content_hash").where("rel != first_rel").select("rel", "content_hash", "first_rel")


def work(files: DataFrame, evaluated: DataFrame, excluded: DataFrame, mode: str, limit: int) -> DataFrame:
    """Which files to do, and which of them are put off for their size. mode: all (not evaluated), defer, force."""
    rows = files.join(excluded, "rel", "left_anti")
    if mode == "all":
        rows = rows.join(evaluated, "rel", "left_anti")
    elif mode == "defer":
        rows = rows.join(evaluated.where("status = 'deferred'"), "rel", "left_semi")
    return rows.withColumn("task", F.when(F.col("size") > limit, "deferred").otherwise("evaluate"))


def ledger_todo(files: DataFrame, ledger: DataFrame, pipeline: str, any_verdict: bool = False) -> DataFrame:
    """files(rel, content_hash) that the ledger does not hold as done with the same content and pipeline."""
    done = ledger.where(F.col("pipeline") == pipeline)
    if not any_verdict:
        done = done.where("verdict IN ('PASS', 'SKIP')")
    return files.join(done.select("rel", "content_hash"), ["rel", "content_hash"], "left_anti")


def badges(files: DataFrame, evals: DataFrame, trust: DataFrame) -> DataFrame:
    """Score and state of each listed file."""
    from ..functions import score

    rows = files.join(evals, "rel", "left").join(trust, "rel", "left")
    return rows.withColumn("state", score.trust_state(F.col("verdict"), F.col("auto_score")))


def failures_in_window(log: DataFrame, limit: int = 5, seconds: int = 300) -> DataFrame:
    """Login attempts that meet `limit` failures in the `seconds` before, on the same address since its last success."""
    runs = Window.partitionBy("address").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    since = log.withColumn("run", F.coalesce(F.sum((F.col("type") == "login").cast("int")).over(runs), F.lit(0)))
    before = Window.partitionBy("address", "run").orderBy("t").rangeBetween(-seconds, -1)
    return since.withColumn(
        "recent",
        F.coalesce(F.sum((F.col("type") == "login_failed").cast("int")).over(before), F.lit(0)),
    ).withColumn("blocked", F.col("recent") >= limit)


def breaker(calls: DataFrame, seconds: float = 600.0) -> DataFrame:
    """Calls after which a skill pauses: the third error in a row within the time."""
    w = Window.partitionBy("skill").orderBy("t", "id")
    bad = (F.col("status") == "error").cast("int")
    return calls.withColumn(
        "paused",
        (F.sum(bad).over(w.rowsBetween(-2, 0)) == 3) & (F.col("t") - F.lag("t", 2).over(w) <= seconds),
    ).withColumn("until", F.when(F.col("paused"), F.col("t") + seconds))


def tree(files: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Counts by state of every folder, rolled up to all folders above; the root's counts combine before the shuffle."""
    from ..functions.names import prefixes

    rows = files.select("state", F.explode(prefixes(F.col("rel"))).alias("folder"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("state") == s).alias(s) for s in states])

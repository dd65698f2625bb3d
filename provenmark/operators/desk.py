"""What people see first: overview, the run under way, feeds of decisions and notices, records of models, engines and folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("trusted", "need_review", "diff_big", "rejected", "unreviewed")
# How the lines of a run's output begin, what each says, and the marks of clause and page ranges in file names.
TOTAL, ITEM, SCAN_PAGE, VERDICT = r"^files to check: (\d+)", r"^\[(\d+)\] (.+)$", r"^OCR page (\d+)/(\d+|\?)", r"^verification: (\w+)"
SKIPPED = r"^(?:unchanged since last run|skip duplicate|skip \(format)"
STAGES = (
    (TOTAL, "listing"),
    (ITEM, "preparing"),
    (r"^download", "downloading"),
    (r"^scanned document", "ocr"),
    (SCAN_PAGE, "ocr"),
    (r"^extracted", "verifying"),
    (r"^verification: (?:PASS|METADATA)\b", "uploading"),
    (r"^verification: \w", "next"),
    (r"^promoted", "publishing"),
)
CLAUSES, PAGES = r"\[([A-Z][A-Z0-9]*)(?:–([A-Z][A-Z0-9]*))?\]", r" p(\d+)(?:-(\d+))?\.md$"
PROMOTE, ADOPTED, WRONG_DAYS = 300, 98.0, 90
LATEST, NOTICES, DAYS, BUDGET = 200, 30, 30, 0.8


def overview(badges: DataFrame, evaluations: DataFrame, decisions: DataFrame) -> DataFrame:
    """A5: one row from badges(rel, state, auto_score, verdict), evaluations(rel, status, salvage) and decisions(rel, decision, null while
    it is open): files, all five states (with 0 where there is none), mean score, reviewed share, deferred, salvage, decisions by kind."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    reviewed, files = F.count("verdict"), F.count(F.lit(1))
    share = F.round(100 * reviewed / F.greatest(files, F.lit(1)), 1)
    a = badges.agg(
        files.alias("files"),
        *states,
        F.round(F.avg("auto_score"), 1).alias("mean_score"),
        F.count("auto_score").alias("evaluated"),
        reviewed.alias("reviewed"),
        share.alias("reviewed_pct"),
    )
    b = evaluations.agg(F.count_if(F.col("status") == "deferred").alias("deferred"), F.count_if("salvage").alias("salvage"))
    c = decisions.agg(
        F.count_if(F.col("decision").isNull()).alias("pending"),
        F.count_if(F.col("decision") == "include").alias("included"),
        F.count_if(F.col("decision") == "exclude").alias("excluded"),
    )
    one = [x.withColumn("__one", F.lit(1)) for x in (a, b, c)]  # a row each
    return reduce(lambda x, y: x.join(y, "__one"), one).drop("__one")


def run_status(log: DataFrame) -> DataFrame:
    """log(run, n, line) to a row a run: total, index, file, stage, scan, page, pages, passed, failed, metadata, skipped, percent.

    Lines that say nothing known change nothing; a file's page counts end with the next file. One aggregate a run: what was last said
    of each thing, and where.
    """
    line = F.trim("line")
    said = lambda pattern, group: F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))
    stage = reduce(lambda rest, s: F.when(line.rlike(s[0]), F.lit(s[1])).otherwise(rest), reversed(STAGES), F.lit(None).cast("string"))
    seen = log.select(
        "run", "n", stage.alias("stage"), said(TOTAL, 1).cast("int").alias("total"), said(ITEM, 1).cast("int").alias("index"), F.right(said(ITEM, 2), F.lit(200)).alias("file"),
        said(SCAN_PAGE, 1).cast("int").alias("page"), said(SCAN_PAGE, 2).try_cast("int").alias("pages"), said(VERDICT, 1).alias("verdict"), line.rlike(SKIPPED).alias("skip"), (line.rlike(SCAN_PAGE) | line.rlike(r"^scanned document")).alias("scan"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    scans = F.struct(F.col("n"), F.col("page"), F.coalesce("pages", F.lit(0)).alias("pages"))
    of = lambda *kinds: F.count_if(F.col("verdict").isin(*kinds))
    rolled = seen.groupBy("run").agg(
        F.coalesce(last("total"), F.lit(0)).alias("total"), F.coalesce(last("index"), F.lit(0)).alias("index"), F.coalesce(last("file"), F.lit("")).alias("file"), F.coalesce(last("stage"), F.lit("starting")).alias("stage"),
        F.max(F.when(F.col("index").isNotNull(), F.col("n"))).alias("begun"), F.max(F.when(F.col("page").isNotNull(), scans)).alias("at"), F.max(F.when(F.col("scan"), F.col("n"))).alias("scanned"),
        of("PASS").alias("passed"), of("FAIL").alias("failed"), of("METADATA").alias("metadata"), F.count_if("skip").alias("skipped"),
    )
    since = lambda n: n.isNotNull() & F.coalesce(n > F.col("begun"), F.lit(True))
    page, pages = (F.when(since(F.col("at.n")), F.col(f"at.{c}")).otherwise(0) for c in ("page", "pages"))
    within = F.when(pages > 0, page / pages).otherwise(0.0)
    done = F.greatest(F.col("index") - 1, F.lit(0)) + within + F.col("skipped")
    percent = F.when(F.col("total") == 0, 3.0).otherwise(F.round(F.least(5 + 90 * done / F.col("total"), F.lit(98.0)), 1))
    return rolled.select(
        "run", "total", "index", "file", "stage", since(F.col("scanned")).alias("scan"), page.alias("page"), pages.alias("pages"),
        "passed", "failed", "metadata", "skipped", percent.alias("percent"),
    )


def audit_feed(rules: DataFrame, undone: DataFrame, calls: DataFrame, files: DataFrame, rooms: DataFrame, most: int = LATEST) -> DataFrame:
    """U4: who decided what, newest first, from rules(num, find, replace, scope, by, at), undone(num, rel, by, at), calls(skill, rel, decision, by, at),
    files(room, rel, confirmed_by, confirmed_at) and rooms(room, name, archived_by, archived_at): (at, who, what, detail). The latest
    200, which is the feature; ties by what and detail."""
    row = lambda df, at, who, what, detail: df.select(F.col(at).cast("double").alias("at"), F.col(who).alias("who"), what.alias("what"), detail.alias("detail"))
    number = F.concat(F.lit("#"), "num")
    named = files.where("confirmed_by IS NOT NULL").join(rooms.select("room", "name"), "room", "left")
    all_ = [
        row(rules, "at", "by", F.lit("rule_created"), F.concat(number, F.lit(" "), "find", F.lit(" → "), "replace", F.lit(" ("), "scope", F.lit(")"))),
        row(undone, "at", "by", F.lit("rule_undone"), F.concat(number, F.lit(" · "), "rel")),
        row(calls.where("decision IS NOT NULL"), "at", "by", F.concat(F.lit("ai_"), "decision"), F.concat("skill", F.lit(" · "), F.coalesce("rel", F.lit("")))),
        row(named, "confirmed_at", "confirmed_by", F.lit("accepted"), F.concat(F.coalesce("name", F.lit("")), F.lit(" · "), "rel")),
        row(rooms.where("archived_by IS NOT NULL"), "archived_at", "archived_by", F.lit("archived"), F.col("name")),
    ]
    return reduce(DataFrame.unionByName, all_).where("at IS NOT NULL").orderBy(F.desc("at"), "what", "detail").limit(most)


def notices(runs: DataFrame, rooms: DataFrame, budgets: DataFrame, rules: DataFrame, read: DataFrame, now: float, most: int = NOTICES) -> DataFrame:
    """Notices (key, type, tone, at, n, read), newest first, the latest 30.

    From runs(id, room, status, publish, at) of the last 30 days, the latest that has ended for each room; rooms(room, archived,
    unprocessable, below, at); budgets(skill, spent, budget, month) of which 80 % or more are spent; rules(id, reverts, often_undone,
    enabled, at); and read(key), what this person has seen.
    """
    ended = runs.where(
        F.col("status").isin("done", "error", "interrupted") & (F.col("at") >= now - DAYS * 86_400)
    ).join(rooms.select("room"), "room", "left_semi")
    latest = ended.groupBy("room").agg(F.max(F.struct("at", "id", "status", "publish")).alias("r")).select("r.*")
    good = F.col("status") == "done"
    kind = F.when(good & F.col("publish"), "published").when(good, "done").when(F.col("status") == "interrupted", "interrupted").otherwise("failed")
    row = lambda df, key, kind, tone, at, n: df.select(key.alias("key"), kind.alias("type"), tone.alias("tone"), at.cast("double").alias("at"), n.cast("long").alias("n"))
    open_ = rooms.where("NOT archived")
    text = lambda *parts: F.concat_ws(":", *parts)
    all_ = [
        row(latest, text(F.when(good, "done").otherwise("fail"), "id"), kind, F.when(good, "ok").otherwise("bad"), F.col("at"), F.lit(None)),
        row(open_.where("unprocessable > 0"), text(F.lit("bad"), "room", "unprocessable"), F.lit("unprocessable"), F.lit("bad"), F.col("at"), F.col("unprocessable")),
        row(open_.where("below > 0"), text(F.lit("review"), "room", "below"), F.lit("review"), F.lit("warn"), F.col("at"), F.col("below")),
        row(budgets.where(f"budget > 0 AND spent >= {BUDGET} * budget"), text(F.lit("ai"), "month", "skill"), F.lit("ai_budget"), F.lit("ai"), F.lit(now), F.round(100 * F.col("spent") / F.col("budget"))),
        row(rules.where("often_undone AND enabled"), text(F.lit("rule"), "id", "reverts"), F.lit("rule_undone"), F.lit("warn"), F.coalesce("at", F.lit(0)), F.col("reverts")),
    ]
    first = reduce(DataFrame.unionByName, all_).orderBy(F.desc("at"), "key").limit(most)
    return first.join(read.select("key", F.lit(True).alias("read")).distinct(), "key", "left").withColumn("read", F.coalesce("read", F.lit(False)))


def eligibility(calls: DataFrame, rules: DataFrame, glossary: DataFrame, now: float) -> DataFrame:
    """Per skill of calls(skill, decision, by): decided, adopted, adoption %, wrong automatic rules(skill, auto, check, checked_at) of the last
    90 days, and what is missing for the next level: 300 decided, 98 % adopted, nothing wrong, a glossary. Evaluations do not count."""
    real = calls.where(F.col("decision").isin("adopted", "modified", "rejected") & (F.coalesce("by", F.lit("")) != "evaluation"))
    record = real.groupBy("skill").agg(F.count(F.lit(1)).alias("decided"), F.count_if(F.col("decision") == "adopted").alias("adopted"))
    wrong = rules.where(
        (F.col("auto")) & (F.col("check") == "wrong") & (F.col("checked_at") >= now - WRONG_DAYS * 86_400)
    ).groupBy("skill").agg(F.count(F.lit(1)).alias("wrong"), F.max("checked_at").alias("last_wrong"))
    known = glossary.limit(1).agg((F.count(F.lit(1)) > 0).alias("known")).withColumn("__one", F.lit(1))
    met = calls.select("skill").distinct().join(record, "skill", "left").join(wrong, "skill", "left").fillna(
        0,
        ["decided", "adopted", "wrong"],
    ).withColumn("__one", F.lit(1)).join(known, "__one")
    rate = F.when(F.col("decided") > 0, F.round(100 * F.col("adopted") / F.col("decided"), 1))
    lacks = F.array_compact(
        F.array(
            F.when(F.col("decided") < PROMOTE, "decided"),
            F.when(rate.isNull() | (rate < ADOPTED), "adoption"),
            F.when(F.col("wrong") > 0, "wrong"),
            F.when(~F.col("known"), "glossary"),
        )
    )
    return met.select(
        "skill", "decided", "adopted", rate.alias("adoption"), "wrong", "last_wrong", lacks.alias("missing"),
        (F.size(lacks) == 0).alias("eligible"),
    )


def folder_map(files: DataFrame) -> DataFrame:
    """files(doc, path below it) by sub-folder: first and last clause in name order, page span and number, from `[D1O1–D1P2]` and ` p2-7.md`
    in their names. Files beside the folders have the folder ''."""
    rest, name = F.col("path"), F.element_at(F.split("path", "/"), -1)
    number = lambda g: F.nullif(F.regexp_extract(name, PAGES, g), F.lit("")).cast("int")
    first, end = (F.nullif(F.regexp_extract(name, CLAUSES, g), F.lit("")) for g in (1, 2))
    seen = files.select(
        "doc",
        F.when(F.contains(rest, F.lit("/")), F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise("").alias("folder"),
        rest.alias("path"),
        first.alias("first"),
        F.coalesce(end, first).alias("last"),
        number(1).alias("p0"),
        F.coalesce(number(2), number(1)).alias("p1"),
    )
    ranged = F.when(F.col("first").isNotNull(), F.col("path"))
    return seen.groupBy("doc", "folder").agg(
        F.min_by("first", ranged).alias("first"), F.max_by("last", ranged).alias("last"), F.min("p0").alias("p0"),
        F.max("p1").alias("p1"), F.count(F.lit(1)).alias("n"),
    )


def benchmark(pages: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(degradation, page, engine, char_acc, char_recall, num_recall) and outcomes(degradation, page, status, published_acc) to a summary of
    each degradation and engine, with pages, those accepted by themselves and the worst of these; and the ranking of engines by their
    mean accuracy over the degradations, of which the best two are chosen and the first is published."""
    means = [F.round(F.avg(c), 5).alias(c) for c in ("char_acc", "char_recall", "num_recall")]
    engines = pages.groupBy("degradation", "engine").agg(*means)
    ok = F.col("status") == "ok"
    whole = outcomes.groupBy("degradation").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(ok).alias("accepted"),
        F.min(F.when(ok, F.col("published_acc"))).alias("worst_accepted"),
    )
    summary = engines.join(whole, "degradation", "left")
    score = engines.groupBy("engine").agg(F.round(F.avg("char_acc"), 5).alias("mean_char_acc"), F.avg("char_acc").alias("__exact"))
    rank = F.row_number().over(Window.orderBy(F.desc("__exact"), "engine"))  # a row an engine
    ranked = score.withColumn("rank", rank)
    return summary, ranked.select("engine", "mean_char_acc", "rank", (F.col("rank") <= 2).alias("chosen"), (F.col("rank") == 1).alias("published"))

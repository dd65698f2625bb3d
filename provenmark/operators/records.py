"""Records that people's work leaves: rules worth widening, checks that wait, patterns and answers scored, counts filled in, files triaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from ..sources.tables import written
from .containment import holding

# How files are told apart by their pages, and when a fix may be suggested or a bank of questions is passed.
SAMPLED, SCAN_CHARS, LARGE_SIDE, MANY_VECTORS = 24, 25, 1000, 300
TAKEN_BACK, SHARE = 3, 0.99
CHECKS = ("answer_ok", "citation_ok", "status_ok", "honesty_ok")


def triage(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents(doc, opens, locked, may_copy) and pages(doc, i from 0, chars, vectors, width, height) to (doc, class, pages, chars, vectors):
    unsupported, protected, drawing, scan or text, from every (n div 24)-th page, 24 at most, which the feature says."""
    sizes = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"))
    step = F.greatest(F.lit(1), F.floor(F.col("pages") / SAMPLED))
    some = pages.join(sizes, "doc").where((F.col("i") % step == 0) & (F.col("i") < step * SAMPLED))
    large = F.greatest("width", "height") >= LARGE_SIDE
    seen = some.groupBy("doc").agg(
        F.first("pages").alias("pages"), F.avg("chars").alias("chars"), F.avg("vectors").alias("vectors"),
        F.avg(large.cast("int")).alias("large"),
    )
    met = documents.join(seen, "doc", "left")
    kind = F.when(
        ~F.col("opens") | (~F.col("locked") & F.col("may_copy") & F.col("pages").isNull()),
        "unsupported",
    ).when(F.col("locked") | ~F.col("may_copy"), "protected")
    kind = kind.when((F.col("large") >= 0.5) & (F.col("vectors") >= MANY_VECTORS), "drawing").when(F.col("chars") < SCAN_CHARS, "scan").otherwise("text")
    told = kind.isin("drawing", "scan", "text")
    return met.select(
        "doc",
        kind.alias("class"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.when(told, F.round("chars", 1)).alias("chars"),
        F.when(told, F.round("vectors", 1)).alias("vectors"),
    )


def widen(rules: DataFrame, suggested: DataFrame) -> DataFrame:
    """Fixes that rules(id, num, kind, find, replace, before, after, scope, series, doc, enabled, reverts) hold twice or more, none of them for
    all documents, and that suggested(ids) has not had: (find, replace, before, after, kind, ids, scope, series). The scope is the one
    series of their documents, else all."""
    fix = ["kind", "find", "replace", "before", "after"]
    series = F.when(F.col("scope") == "series", F.col("series")).when(F.col("scope") == "document", names.series_of(F.coalesce("doc", F.lit(""))))
    live = rules.where(F.col("enabled") & (F.col("reverts") < TAKEN_BACK) & F.col("kind").isin("text", "number"))
    none = F.max((series.isNull() & F.col("scope").isin("series", "document")).cast("int"))
    groups = live.groupBy(*fix).agg(
        F.count(F.lit(1)).alias("n"),
        F.max((F.col("scope") == "all").cast("int")).alias("all"),
        F.array_sort(F.collect_list("id")).alias("ids"),
        F.array_sort(F.collect_set(series)).alias("of"),
        none.alias("none"),
    )
    one = (F.size("of") == 1) & (F.col("none") == 0)
    found = groups.where("n >= 2 AND all = 0").join(suggested.select(F.array_sort("ids").alias("ids")).distinct(), "ids", "left_anti")
    return found.select(*fix, "ids", F.when(one, "series").otherwise("all").alias("scope"), F.when(one, F.get("of", F.lit(0))).alias("series"))


def waiting_checks(rules: DataFrame, rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Automatic rules(id, num, find, replace, room, rel, auto, sampled, check, at) that were sampled and that nobody has checked, with the name of
    their room, and one row of totals: all automatic ones, right, wrong."""
    auto = rules.where("auto")
    open_ = auto.where(F.col("sampled") & F.col("check").isNull()).join(rooms.select("room", F.col("name").alias("room_name")), "room", "left")
    totals = auto.agg(
        F.count(F.lit(1)).alias("automatic"),
        F.count_if(F.col("check") == "right").alias("right"),
        F.count_if(F.col("check") == "wrong").alias("wrong"),
    )
    return open_.select("id", "num", "find", "replace", "room", "room_name", "rel", "at"), totals


def pattern_scores(patterns: DataFrame, fixes: DataFrame, others: DataFrame) -> DataFrame:
    """patterns(id, find, replace with \\1 for groups), fixes(id, wrong, right) that people confirmed, and others(id, text) that must stay:
    (id, cases, wrong, score). Each fix is to be made, what it makes is to be left alone, and so are the others."""
    cases = fixes.select("id", F.col("wrong").alias("text"), F.col("right").alias("want")).unionByName(
        fixes.select("id", F.col("right").alias("text"), F.col("right").alias("want"))
    ).unionByName(others.select("id", "text", F.col("text").alias("want")))
    put = F.regexp_replace(F.replace("replace", F.lit("$"), F.lit("\\$")), r"\\(\d)", r"\$$1")
    met = patterns.select("id", "find", put.alias("put")).join(cases, "id", "left")
    made = F.expr("regexp_replace(text, concat('(?U)', find), put)")
    rated = met.groupBy("id").agg(F.count("text").alias("cases"), F.count_if(~made.eqNullSafe(F.col("want")) & F.col("text").isNotNull()).alias("wrong"))
    return rated.select(
        "id",
        "cases",
        "wrong",
        F.when(
            F.col("cases") > 0,
            F.round(100 * (F.col("cases") - F.col("wrong")) / F.col("cases"), 1),
        ).otherwise(0.0).alias("score"),
    )


def score_sheet(rows: DataFrame, traps: str = "F") -> DataFrame:
    """rows(id, category, four checks, seconds) by category and in all (category null): questions, passed, pass_rate, median seconds, and
    whether that is enough: 99 % in all, every one of the traps. A question passes if all four checks do; one that is missing fails."""
    good = F.lit(True)
    for c in CHECKS:
        good = good & F.coalesce(F.col(c), F.lit(False))
    counted = rows.rollup("category").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(good).alias("passed"),
        F.percentile(F.col("seconds").cast("double"), F.lit(0.5)).alias("median_s"),
        F.grouping("category").alias("whole"),
    )
    rate = F.col("passed") / F.col("questions")
    enough = F.when(F.col("whole") == 1, rate >= SHARE).when(F.col("category") == traps, F.col("passed") == F.col("questions"))
    return counted.select("category", "questions", "passed", F.round(rate, 9).alias("pass_rate"), "median_s", enough.alias("enough"))


def affected(results: DataFrame, rules: DataFrame, applied: DataFrame) -> DataFrame:
    """Documents that a change of plain-text rules(id, find) touches: (id, rel, places) of results(rel, text) that hold the text, and, with
    0 places, of applied(id, rel) where the rule has already done its work.

    Rules meet texts by the containment index, so there is no product of rules and documents.
    """
    holds = holding(results.select("rel", "text"), rules, ["rel"], ["id"])
    places = F.floor((F.length("text") - F.length(F.replace("text", F.col("find"), F.lit("")))) / F.length("find"))
    found = written(holds.select("id", "rel", places.cast("long").alias("places")))  # counted where it is found, and read twice
    return found.unionByName(applied.select("id", "rel").distinct().join(found, ["id", "rel"], "left_anti").withColumn("places", F.lit(0).cast("long")))


def backfill(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """counts(rel, src_chars, md_chars, src_words, md_words) with what is null counted from texts(rel, src, md); other numbers stay as they are,
    and so do rows without a text. Only texts that are needed are counted."""
    lacks = F.col("src_chars").isNull() | F.col("src_words").isNull() | F.col("md_chars").isNull() | F.col("md_words").isNull()
    asked = texts.join(counts.where(lacks).select("rel"), "rel", "left_semi")
    new = asked.select("rel", *[F.when(F.col(s).isNotNull(), text.count_text(s)).alias(f"__{s}") for s in ("src", "md")])
    met = counts.join(new, "rel", "left")
    return met.select(
        "rel",
        *[
            F.coalesce(
                F.col(f"{s}_{k}"),
                F.col(f"__{s}.{k}").cast("long"),
            ).alias(f"{s}_{k}") for k in ("chars", "words") for s in ("src", "md")
        ]
    )

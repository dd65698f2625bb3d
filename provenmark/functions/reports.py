"""Column functions on verification reports: parts, findings, outcomes, states of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import score

MOST_FINDINGS, NUMBERS_SHOWN, PAIRS_SHOWN = 200, 6, 10
#: A report as a struct; a field that does not apply to a file is null.
REPORT = (
    "route string, page_count bigint, missing array<bigint>, chars_recall double, low array<struct<page:bigint,recall:double,lost:bigint>>, extra array<struct<page:bigint,chars:bigint>>, "
    "numbers_recall double, number_pages array<struct<page:bigint,items:array<string>>>, headings bigint, unmatched bigint, heading_examples array<struct<page:bigint,title:string>>, "
    "cells bigint, mismatches bigint, table_examples array<struct<page:bigint,detail:string>>, unreadable array<bigint>, readings array<struct<page:bigint,agreement:double,pairs:array<struct<a:string,b:string>>>>, review_pages array<bigint>, source_ok boolean"
)
FINDING = "array<struct<kind:string,page:bigint,detail:string,a:string,b:string>>"


def parts(r: Column) -> dict[str, Column]:
    """Share of each check that applies, null where it does not; for scans how far two readers agree."""
    lost = (F.coalesce(F.size(r["missing"]), F.lit(0)) + F.coalesce(F.size(r["extra"]), F.lit(0))) / F.nullif(r["page_count"], F.lit(0))
    read = F.aggregate(r["readings"], F.lit(0.0), lambda acc, p: acc + F.coalesce(p["agreement"], F.lit(0.0))) / F.nullif(F.size(r["readings"]), F.lit(0))
    scan, none = F.coalesce(r["route"] == "ocr", F.lit(False)), F.lit(None).cast("double")
    rest = lambda bad, of: F.when(of > 0, F.greatest(F.lit(0.0), 1 - F.coalesce(bad, F.lit(0)) / of))
    return {
        "text": F.when(scan, read).otherwise(F.when(r["chars_recall"].isNotNull(), F.greatest(F.lit(0.0), r["chars_recall"] - F.coalesce(lost, F.lit(0.0))))),
        "numbers": F.when(scan, none).otherwise(r["numbers_recall"]),
        "headings": F.when(scan, none).otherwise(rest(r["unmatched"], r["headings"])),
        "tables": F.when(scan, none).otherwise(rest(r["mismatches"], r["cells"])),
    }


def findings(r: Column, most: int | None = MOST_FINDINGS) -> Column:
    """The places that cost accuracy, in the order of the checks, at most `most` (None: all)."""

    def row(kind, page, detail, a=None, b=None):
        return F.struct(
            F.lit(kind).alias("kind"),
            page.alias("page"),
            detail.alias("detail"),
            (F.lit(None).cast("string") if a is None else a).alias("a"),
            (F.lit(None).cast("string") if b is None else b).alias("b"),
        )

    def of(items, make):
        return F.coalesce(F.transform(items, make), F.array().cast(FINDING))

    read = F.transform(
        F.when(r["route"] == "ocr", r["readings"]),
        lambda p: F.transform(
            F.filter(F.slice(p["pairs"], 1, PAIRS_SHOWN), lambda x: (x["a"] != "") | (x["b"] != "")),
            lambda x: row("reading", p["page"], F.concat(x["a"], F.lit(" / "), x["b"]), x["a"], x["b"]),
        ),
    )
    reading = F.coalesce(F.flatten(read), F.array().cast(FINDING))
    seen = F.transform(reading, lambda x: x["page"])
    every = F.concat(
        of(r["number_pages"], lambda p: row("numbers", p["page"], F.concat(F.lit("missing: "), F.array_join(F.slice(p["items"], 1, NUMBERS_SHOWN), ", ")))),
        of(r["low"], lambda p: row("text", p["page"], F.concat(F.lit("recall "), p["recall"], F.lit(", "), p["lost"], F.lit(" characters missing")))),
        of(r["extra"], lambda p: row("text", p["page"], F.concat(p["chars"], F.lit(" characters not on the source page")))),
        of(r["heading_examples"], lambda p: row("headings", p["page"], p["title"])),
        of(r["table_examples"], lambda p: row("tables", p["page"], p["detail"])),
        of(F.array_sort(F.array_distinct(r["unreadable"])), lambda p: row("formula", p, F.lit("text layer cannot be decoded"))),
        reading,
        of(F.filter(r["review_pages"], lambda p: ~F.array_contains(seen, p)), lambda p: row("text", p, F.lit("the two readers disagree"))),
    )
    return every if most is None else F.slice(every, 1, most)


def outcome(r: Column, verdict: Column, triage: Column, error: Column, most: int | None = MOST_FINDINGS) -> Column:
    """struct(outcome, reason, accuracy, diffs, number_diffs) of a file's result or error; at most `most` findings count (None: all)."""
    failed, skipped, moved = error.isNotNull() | r.isNull(), verdict == "SKIP", r["source_ok"] == F.lit(False)
    has = ~failed & ~F.coalesce(skipped, F.lit(False)) & ~F.coalesce(moved, F.lit(False))
    found = findings(r, most)
    state = F.when(failed, "unprocessable").when(
        skipped & (triage == "protected"),
        "unprocessable",
    ).when(skipped, "skipped").when(moved, "unprocessable").otherwise("result")
    reason = F.when(failed, score.reason_code(error)).when(
        skipped & (triage == "protected"),
        "protected",
    ).when(skipped, "unsupported").when(moved, "source_changed").otherwise("")
    count = lambda c: F.when(has, c).otherwise(0).cast("long")
    return F.struct(
        state.alias("outcome"),
        reason.alias("reason"),
        F.when(has, score.accuracy(parts(r))).alias("accuracy"),
        count(F.size(found)).alias("diffs"),
        count(F.size(F.filter(found, lambda x: x["kind"] == "numbers"))).alias("number_diffs"),
    )


def file_state(
    activity: Column, result: Column, confirmed: Column, acc: Column, number_diffs: Column, checks: Column, threshold: Column,
    guard: Column,
) -> Column:
    """What a person sees of a file. Numbers that a rule changed count as differences until somebody has checked them."""
    open_ = F.coalesce(number_diffs, F.lit(0)) + F.coalesce(checks, F.lit(0))
    return (
        F.when(activity.isin("processing", "publishing"), activity)
        .when(F.coalesce(result, F.lit("")) == "", "pending")
        .when(result.isin("unprocessable", "skipped"), "unprocessable")
        .when(F.coalesce(confirmed, F.lit(False)), "published")
        .otherwise(score.decide(acc, open_, threshold, guard))
    )

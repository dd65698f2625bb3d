"""Structure of documents: where texts stand, contents lists and headings, cross references, cumulative line counts, log and state tables."""

from __future__ import annotations

import difflib
import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..functions import names, text
from .containment import contained

EVENT = "t double, type string, rel string, kind string, size bigint, outcome string, accuracy double, diffs bigint, number_diffs bigint, out_dir string, content_hash string, files array<struct<rel:string,kind:string,size:bigint>>"
TYPES = ("listing", "start", "file", "unchanged", "published", "publish_failed")
#: Lines of a run's log by what they say.
TOTAL, ITEM, SCAN_PAGE, VERDICT = r"^(\d+) documents", r"^\[(\d+)\] (.+)$", r"^OCR page (\d+)/(\d+|\?)", r"^verification: (\w+)"


def pages_with(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """pages(rel, page, text) and wanted(rel, ask, find) to (rel, ask, page) of the pages that hold the text in its normal form."""
    norm = lambda df, c, *keep: df.select("rel", *keep, text.normalize_line(c).alias(c))
    return contained(norm(pages, "text", "page"), norm(wanted, "find", "ask"), ["page"], ["ask"], ("rel",))


def cross_references(chunks: DataFrame) -> DataFrame:
    """chunks(rel, file, defined, text) to (rel, file, clause, target): clauses that a file cites and another file of the document
    defines first; files in name order."""
    first = chunks.select("rel", "file", F.explode("defined").alias("clause")).groupBy("rel", "clause").agg(F.min("file").alias("target"))
    own = chunks.select("rel", "file", F.explode("defined").alias("clause"))
    cited = chunks.select("rel", "file", F.explode(F.array_distinct(names.clause_ids(F.col("text")))).alias("clause"))
    return cited.join(own, ["rel", "file", "clause"], "left_anti").join(first, ["rel", "clause"]).select("rel", "file", "clause", "target")


def line_states(boxes: DataFrame, states: DataFrame) -> DataFrame:
    """boxes(rel, page, y, text) take the states(rel, n, text, status) of equal lines in their order; what is left over is unmatched."""
    norm = text.normalize_line("text")
    k = lambda *order: F.row_number().over(Window.partitionBy("rel", "norm").orderBy(*order))
    a = boxes.withColumn("norm", norm).withColumn("k", k("page", "y"))
    b = states.withColumn("norm", norm).withColumn("k", k("n")).select("rel", "norm", "k", "status")
    return a.join(b, ["rel", "norm", "k"], "left").select("rel", "page", "y", F.coalesce("status", F.lit("unmatched")).alias("status"))


def unmatched_headings(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Contents entries(rel, seq, title, page) without a row(rel, page, y, text) on their page or next to it that prints them: equal
    by key, beginning with them, or as two or three rows one below the other."""
    w = Window.partitionBy("rel", "page").orderBy("y")
    key = lambda c: text.cell_key(c)
    near = rows.withColumn("k1", key("text")).withColumns({"k2": F.concat("k1", F.coalesce(F.lead("k1", 1).over(w), F.lit("")))})
    near = near.withColumn("k3", F.concat("k2", F.coalesce(F.lead("k1", 2).over(w), F.lit("")))).where("k1 <> ''")
    asked = entries.withColumn("key", key("title"))
    spread = asked.where("key <> ''").select("rel", "seq", "key", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"))
    # a row begins with an entry if its first letters, as many as the entry has, equal it; few lengths are asked for on a page
    lengths = spread.groupBy("rel", "page").agg(F.collect_set(F.length("key")).alias("lengths"))
    heads = near.join(lengths, ["rel", "page"]).select("rel", "page", "k1", "k2", "k3", F.explode("lengths").alias("n"))
    heads = heads.select(
        "rel",
        "page",
        F.explode(
            F.array_distinct(
                F.array_compact(
                    F.array(
                        *[
                            F.when(
                                F.length(k) >= F.col("n") if k == "k1" else F.length(k) == F.col("n"),
                                F.substring(k, F.lit(1), F.col("n")),
                            ) for k in ("k1", "k2", "k3")
                        ]
                    )
                )
            )
        ).alias("key")
    )
    found = spread.join(heads, ["rel", "page", "key"]).select("rel", "seq").distinct()
    return asked.join(found, ["rel", "seq"], "left_anti").select("rel", "seq", "title", "page")


def fallback_headings(rows: DataFrame) -> DataFrame:
    """rows(rel, n, bold, text) to headings(rel, n, clause, part): bold rows with a clause id; a part begins where its prefix changes."""
    clause = F.regexp_extract("text", r"^([A-Z]?\d+(?:\.\d+)*)\b", 1)
    heads = rows.where(F.col("bold") & (clause != "")).withColumns({"clause": clause, "prefix": F.regexp_extract(clause, r"^[A-Z]?\d+", 0)})
    w = Window.partitionBy("rel").orderBy("n")
    fresh = F.coalesce((F.col("prefix") != F.lag("prefix").over(w)).cast("long"), F.lit(1))
    return heads.withColumn("fresh", fresh).select("rel", "n", "clause", F.sum("fresh").over(w).alias("part"))


def cumulative_lines(pages: DataFrame) -> DataFrame:
    """pages(rel, page, text) to (rel, page, lines): how many lines splitlines() sees in all pages so far, joined by line feeds. A
    page that ends in a carriage return makes one break with the feed after it."""
    w = Window.partitionBy("rel").orderBy("page")
    t = F.coalesce("text", F.lit(""))
    breaks = F.regexp_count(t, F.lit(text.LINE_BREAK))
    open_end = F.when((t != "") & ~t.rlike(f"(?:{text.LINE_BREAK})$"), 1).otherwise(0)
    # the feed before a page; it is part of the break that a carriage return at the end of the page before has begun
    joint = F.when(F.lag(t).over(w).isNull() | F.lag(t).over(w).rlike(r"\r$"), 0).otherwise(1)
    counted = pages.select("rel", "page", F.col("text"), (breaks + joint).alias("b"), open_end.alias("o"))
    return counted.select("rel", "page", (F.sum("b").over(w) + F.col("o")).cast("long").alias("lines"))


def events(lines: DataFrame, c: str = "value") -> DataFrame:
    """JSON lines of a run's log as typed rows; broken lines and unknown types are left out."""
    read = lines.withColumn("__e", F.from_json(c, EVENT, {"mode": "PERMISSIVE"}))
    return read.where(F.col("__e.type").isin(*TYPES)).select(*[x for x in lines.columns if x != c], "__e.*")


def latest_reports(reports: DataFrame, schema: str) -> DataFrame:
    """reports(sid, rel, at, raw) to the latest readable one of each file."""
    read = reports.withColumn("report", F.from_json("raw", schema)).where(
        F.col("report").isNotNull() & F.coalesce(F.col("raw").rlike(r"^\s*\{.*\}\s*$"), F.lit(False))
    )
    return read.groupBy("sid", "rel").agg(F.max("at").alias("at"), F.max_by("report", "at").alias("report"))


def run_status(log: DataFrame) -> DataFrame:
    """log(run, n, line) to a row a run: total, index, file, verdict counts, skipped, percent done."""
    first = lambda pattern, group: F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))
    seen = log.select(
        "run",
        "n",
        first(TOTAL, 1).cast("int").alias("total"),
        first(ITEM, 1).cast("int").alias("idx"),
        first(ITEM, 2).alias("file"),
        first(SCAN_PAGE, 1).cast("int").alias("page"),
        first(SCAN_PAGE, 2).alias("of"),
        first(VERDICT, 1).alias("verdict"),
        F.startswith("line", F.lit("unchanged since last run")).alias("skip"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    at = F.max(F.when(F.col("idx").isNotNull(), F.col("n")))
    page_at = F.max(F.when(F.col("page").isNotNull(), F.col("n")))
    rolled = seen.groupBy("run").agg(
        last("total").alias("total"),
        last("idx").alias("idx"),
        last("file").alias("file"),
        F.count_if(F.col("verdict") == "PASS").alias("passed"),
        F.count_if(F.col("verdict") == "FAIL").alias("failed"),
        F.count_if("skip").alias("skipped"),
        F.when(page_at > at, last("page")).alias("page"),
        F.when(page_at > at, last("of")).alias("of"),
    )
    within = F.coalesce(F.col("page") / F.nullif(F.col("of").try_cast("int"), F.lit(0)), F.lit(0.0))
    done = F.greatest(F.coalesce("idx", F.lit(0)) - 1, F.lit(0)) + within + F.col("skipped")
    percent = F.when(F.coalesce("total", F.lit(0)) == 0, 3.0).otherwise(F.round(F.least(5 + 90 * done / F.col("total"), F.lit(98.0)), 1))
    return rolled.select("run", "total", F.col("idx").alias("index"), "file", "passed", "failed", "skipped", percent.alias("percent"))


def paired(sources: DataFrame, mirror: DataFrame) -> DataFrame:
    """sources(rel, size) with the Markdown of the same path in the mirror(path, …), null where there is none; folders whose name begins
    with `_` are not part of it."""
    real = mirror.where(~F.exists(F.split("path", "/"), lambda x: F.startswith(x, F.lit("_"))) & F.endswith("path", F.lit(".md")))
    return sources.join(real.withColumn("rel", F.regexp_replace("path", r"\.md$", "")), "rel", "left")


def error_notes(reports: DataFrame) -> DataFrame:
    """reports(name, text) to one row a report: its fields, continuation lines joined; `readable` is false without a question. A report
    that arrives twice counts once."""
    once = reports.groupBy("name").agg(F.min("text").alias("text"))
    fields = ("question", "answer_given", "sources_cited", "user_says", "recheck")
    ends = "|".join(fields)
    value = lambda f: F.regexp_replace(F.trim(F.regexp_extract("text", rf"(?s)(?:^|\n){f}:[ \t]*(.*?)(?=\n(?:{ends}):|$)", 1)), r"\s*\n\s*", " ")
    return once.select("name", *[value(f).alias(f) for f in fields]).withColumn("readable", F.col("question") != "")


def files_from_events(log: DataFrame) -> DataFrame:
    """M5: an event log(room, seq, type, rel, outcome, accuracy, size, files) folded to the files of each room.

    A listing adds its files; a file that the last listing lacks and that has no outcome is gone. A result takes back the confirmation,
    a publication gives it. One aggregate a file: no state is read back.
    """
    listed = log.where("type = 'listing'").select("room", "seq", F.explode("files").alias("f")).select(
        "room", "seq", F.lit("listing").alias("type"), F.col("f.rel").alias("rel"), F.col("f.size").alias("size"),
        F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("double").alias("accuracy"),
    )
    rows = listed.unionByName(
        log.where("type <> 'listing' AND rel IS NOT NULL").select(
            "room", "seq", "type", "rel", F.lit(None).cast("bigint").alias("size"), "outcome", "accuracy",
        )
    )
    kind = F.col("type")
    at = lambda *kinds: F.when(kind.isin(*kinds), F.col("seq"))
    folded = rows.groupBy("room", "rel").agg(
        F.max_by("size", at("listing")).alias("size"), F.max(at("listing")).alias("listed"), F.max_by("outcome", at("file")).alias("outcome"), F.max_by("accuracy", at("file")).alias("accuracy"),
        F.coalesce(F.max(at("published")) > F.coalesce(F.max(at("file")), F.lit(-1)), F.lit(False)).alias("confirmed"), F.when(F.max_by("type", at("start", "file", "unchanged", "published", "publish_failed")) == "start", "processing").alias("activity"), F.max(at("file", "listing")).alias("known"),
    )
    last = log.where("type = 'listing'").groupBy("room").agg(F.max("seq").alias("last"))
    kept = folded.where("known IS NOT NULL").join(last, "room", "left")
    return kept.where("outcome IS NOT NULL OR listed = last").select("room", "rel", "size", "activity", "outcome", "accuracy", "confirmed")


def accept_plan(files: DataFrame, asked: DataFrame) -> DataFrame:
    """M8: files(rel, state, out_dir, content_hash) and asked(rel, force) to (rel, decision): publish, force publish, or why not."""
    joined = asked.groupBy("rel").agg(F.max("force").alias("force")).join(files, "rel", "left")
    take = (F.col("state") == "ok") | ((F.col("state") == "below") & F.col("force"))
    return joined.select(
        "rel",
        F.when(F.col("state").isNull(), "no such file").when(take & F.col("out_dir").isNull(), "result missing").when(
            take,
            F.when(F.col("state") == "ok", "publish").otherwise("forced"),
        ).when(F.col("state") == "below", "below threshold").when(
            F.col("state").isin("published", "publishing"),
            "already sent",
        ).otherwise("no result").alias("decision"),
    )


def layout(size: Column, limit: int = 100_000) -> Column:
    """One file, or a folder of chapters beyond the limit."""
    return F.when(size <= limit, "file").otherwise("folder")


def titled_sections(texts: DataFrame) -> DataFrame:
    """texts(rel, text) to (rel, section, title, body): a section begins at a heading of level one or two once it has a word; titles
    are `section N: heading`, `Start` before the first. One pass over lines with a running number, no look at the whole text."""
    w = Window.partitionBy("rel").orderBy("n")
    lines = texts.select("rel", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    title = F.when(F.col("line").rlike(r"^#{1,2}\s+\S"), F.trim(F.regexp_replace("line", r"^#{1,2}\s+", "")))
    marked = lines.withColumn("head", title).withColumn("block", F.count("head").over(w))
    blocks = marked.groupBy("rel", "block").agg(
        F.max("head").alias("head"),
        F.trim(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
        ).alias("body"),
    ).where("body <> ''")
    number = F.row_number().over(Window.partitionBy("rel").orderBy("block"))
    return blocks.select(
        "rel",
        number.alias("section"),
        F.concat(F.lit("section "), number, F.lit(": "), F.substring(F.coalesce("head", F.lit("Start")), 1, 60)).alias("title"),
        "body",
    )


def pages_of_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines(rel, n) take the page of pages(rel, page, lines) whose cumulative count first exceeds their number; null behind the last.

    Both kinds of rows are sorted together by document, so no line is held against more than one page.
    """
    ends = pages.select("rel", (F.col("lines") - 1).alias("n"), F.lit(1).alias("__kind"), "page")
    both = lines.select(
        "rel", F.col("n").cast("long").alias("n"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("page"),
    ).unionByName(ends.withColumn("page", F.col("page").cast("long")))
    later = Window.partitionBy("rel").orderBy("n", "__kind", "page").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("page", F.first("page", ignorenulls=True).over(later)).where("__kind = 0").select("rel", "n", "page")


def promotion_plan(wanted: DataFrame, staged: DataFrame, live: DataFrame) -> DataFrame:
    """wanted(document, path, size) and staged(path, size) to documents: promoted only if every file is there in its size; `archived` is
    how many live(path) keys give way: the same path, or its twin as a folder of chapters or as one file."""
    there = wanted.join(
        staged.select("path", F.col("size").alias("got")),
        "path",
        "left",
    ).withColumn("good", F.coalesce(F.col("got") == F.col("size"), F.lit(False)))
    plan = there.groupBy("document").agg(F.bool_and("good").alias("promote"), F.count(F.lit(1)).alias("files"))
    twins = wanted.select(
        "document",
        F.explode(
            F.array_distinct(
                F.array(
                    F.col("path"),
                    F.regexp_replace("path", r"\.md$", "/index.md"),
                    F.regexp_replace("path", r"/index\.md$", ".md"),
                )
            )
        ).alias("path"),
    ).distinct()
    gone = twins.join(live.select("path").distinct(), "path").groupBy("document").agg(F.count_distinct("path").alias("archived"))
    return plan.join(gone, "document", "left").select(
        "document",
        "promote",
        "files",
        F.when(F.col("promote"), F.coalesce("archived", F.lit(0))).otherwise(0).cast("long").alias("archived"),
    )


def accept_preview(files: DataFrame, running: DataFrame) -> DataFrame:
    """files(room, state, rule_checks, out_dir) to a row a room: what would go, what needs a person, and the reasons why a room may
    not be archived."""
    per = files.groupBy("room").agg(
        F.count_if(F.col("state") == "ok").alias("ok"),
        F.count_if(F.col("state") == "below").alias("below"),
        F.count_if(F.col("state").isin("pending", "processing")).alias("open"),
        F.count_if(F.col("state") == "publishing").alias("sending"),
        F.sum(F.coalesce("rule_checks", F.lit(0))).alias("checks"),
    )
    busy = per.join(running.select("room", F.lit(True).alias("busy")).distinct(), "room", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("busy"), "running"), F.when(F.col("sending") > 0, "sending"), F.when(F.col("ok") > 0, "not accepted yet"),
            F.when(F.col("checks") > 0, "checks open"),
        )
    )
    return busy.select("room", "ok", "below", "open", F.array_join(reasons, ", ").alias("blockers"))


MOST_DIFF_LINES = 800
#: Lines of differences that leave a task together, so that its memory does not grow with the rows of a batch.
DIFF_LINES_TOGETHER = 20_000
_OPS = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())]))
_DIFF = StructType([StructField("diff", _OPS), StructField("added", LongType()), StructField("removed", LongType()), StructField("truncated", BooleanType())])


def _diff_of(x: str, y: str) -> tuple[list[tuple[str, str]], int, int, bool]:
    shown, added, removed, lines = [], 0, 0, 0
    for s in itertools.islice(difflib.unified_diff(x.split("\n"), y.split("\n"), lineterm="", n=2), 2, None):
        op = "@" if s[:2] == "@@" else s[:1]
        added, removed, lines = added + (op == "+"), removed + (op == "-"), lines + 1
        if lines <= MOST_DIFF_LINES:
            shown.append((op, s if op == "@" else s[1:]))
    return shown, added, removed, lines > MOST_DIFF_LINES


def line_diff(pairs: DataFrame, before: str = "old", after: str = "new") -> DataFrame:
    """V6: a unified line diff with two lines of context for each row whose texts differ: (…, diff array of (op, text), added, removed,
    truncated). At most 800 lines are shown, which the feature says; counts are of all. Equal rows never leave the JVM."""
    keep = [c for c in pairs.columns if c not in (before, after)]

    def compared(batches):
        for batch in batches:
            old, new, first, rows, size = batch.column(before), batch.column(after), 0, [], 0
            for k in range(batch.num_rows):
                rows.append(_diff_of(old[k].as_py() or "", new[k].as_py() or ""))
                size += len(rows[-1][0]) + 1
                if size > DIFF_LINES_TOGETHER or k + 1 == batch.num_rows:
                    kept = [batch.column(c).slice(first, len(rows)) for c in keep]
                    diff = pa.array([[{"op": op, "text": said} for op, said in r[0]] for r in rows], told)
                    counts = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([*kept, diff, *counts], names=[*keep, *_DIFF.names])
                    first, rows, size = k + 1, [], 0

    told = pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())]))
    shape = StructType([*(pairs.schema[c] for c in keep), *_DIFF])
    return pairs.where(~F.col(before).eqNullSafe(F.col(after))).mapInArrow(compared, shape)


LATEST_EXAMPLES, NEAR, SHOWN = 300, 0.5, 3
#: Different texts of a skill that are compared in one row.
ASKED_TOGETHER = 200


def _nearest(asked: list[str], shown: list[str | None]) -> list[dict]:
    """For each asked text its SHOWN most similar other shown ones, NEAR alike at least, as (text, place from 1, similarity); ties to the
    first place. Texts are compared in the order of the letters that they have in common, which bound the ratio from above, until no
    bound left can change the result."""
    places: dict[str, list[int]] = {}
    for k, t in enumerate(shown, 1):
        if t is not None:
            places.setdefault(t, []).append(k)
    others = list(places)
    column = {x: k for k, x in enumerate(sorted(set("".join(others))))}
    held = np.zeros((len(others), len(column)), dtype=np.int32)
    for k, t in enumerate(others):
        for x, n in Counter(t).items():
            held[k, column[x]] = n
    size, matchers, found = np.array([len(t) for t in others], dtype=np.int64), {}, []
    for t in asked:
        has = np.zeros(len(column), dtype=np.int32)
        for x, n in Counter(t).items():
            if x in column:
                has[column[x]] = n
        bound = 2.0 * np.minimum(held, has).sum(axis=1) / np.maximum(size + len(t), 1)
        best: list[tuple[float, int]] = []
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < NEAR or (len(best) == SHOWN and bound[k] < -best[-1][0]):
                break
            if others[k] == t:
                continue
            if k not in matchers:
                matchers[k] = difflib.SequenceMatcher(None, "", others[k])
            matchers[k].set_seq1(t)
            alike = matchers[k].ratio()
            if alike >= NEAR:
                best = sorted([*best, *((-alike, at) for at in places[others[k]][:SHOWN])])[:SHOWN]
        found += [{"text": t, "at": at, "similarity": -alike} for alike, at in best]
    return found


def similar_examples(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """questions(skill, id, text) and examples(skill, example, at, text) to the three most similar examples of each question, at least
    half alike and not the question itself. Only the latest 300 examples of a skill are looked at, which the feature says, so a question
    meets a bounded number of rows. The different texts of a skill are asked once, some hundred a row, however many questions have them."""
    newest = Window.partitionBy("skill").orderBy(F.desc("at"), "example")
    kept = examples.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= LATEST_EXAMPLES)
    shown = kept.groupBy("skill").agg(F.sort_array(F.collect_list(F.struct("__r", "example", "text"))).alias("__shown"))

    @F.pandas_udf("array<struct<text:string,at:int,similarity:double>>")
    def nearest(asked: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_nearest(list(a), list(t)) for a, t in zip(asked, texts, strict=True)], dtype="object")

    asked = questions.where("skill IS NOT NULL AND text IS NOT NULL").select("skill", "text").distinct()
    rows = F.ceil(F.col("__n") / ASKED_TOGETHER)
    together = asked.join(asked.groupBy("skill").agg(F.count(F.lit(1)).alias("__n")), "skill").groupBy(
        "skill",
        F.pmod(F.xxhash64("text"), rows).alias("__part"),
    ).agg(F.collect_list("text").alias("__asked"))
    tasks = together.join(shown, "skill").repartition("skill", "__part")
    near = tasks.select("skill", "__shown", F.explode(nearest("__asked", F.transform("__shown", lambda x: x["text"]))).alias("__x"))
    near = near.select("skill", "__x.text", F.element_at("__shown", F.col("__x.at"))["example"].alias("example"), F.col("__x.at").alias("__r"), "__x.similarity")
    by_text = near.groupBy("skill", "text").agg(F.collect_list(F.struct("example", "__r", "similarity")).alias("__near"))
    met = questions.join(by_text, ["skill", "text"]).select("id", F.inline("__near"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "__r")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SHOWN).select(
        "id", "example", "rank", F.round("similarity", 6).alias("similarity"),
    )

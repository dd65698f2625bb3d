"""Further queries: units, structure, rules, calls and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import state, verify
from . import fixtures as X
from .registry import register


@register("s2_decode_bytes", "SELECT doc_id, length(text) AS n FROM documents")
def s2(spark, sf):
    """Bytes as UTF-8 where they are valid, else as cp1252."""
    raw = X.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return raw.select(
        "doc_id",
        F.length(
            F.when(F.is_valid_utf8(F.col("b").cast("string")), F.decode("b", "UTF-8")).otherwise(F.decode("b", "windows-1252"))
        ).cast("long").alias("n"),
    )


@register("s4_units_from_markdown", X.with_("docs s", "SELECT rel, n + 1 AS page, length(trim(line)) AS chars FROM s"))
def s4(spark, sf):
    """Markdown with a marker before each unit, exploded to units again."""
    marked = X.docs(spark, sf).select(
        "rel",
        F.array_join(
            F.transform(
                F.split("text", "\n"),
                lambda x, i: F.concat(
                    F.lit("<!-- unit: p"), i + 1, F.lit(" | src: p."), i + 1, F.lit(" | chars: 0 | flags: none -->\n"), x,
                ),
            ),
            "\n",
        ).alias("md"),
    )
    mark = r"(?m)^<!-- unit: p\d+ \| src: p\.(\d+)(?: \| printed: [^|]+?)? \| chars: \d+ \| flags: [^>]*?-->\s*$"
    pages = F.regexp_extract_all("md", F.lit(mark), F.lit(1))
    bodies = F.slice(F.split("md", mark), 2, 1_000_000_000)
    return marked.select("rel", F.inline(F.arrays_zip(pages.alias("page"), bodies.alias("body")))).select(
        "rel",
        F.col("page").cast("long").alias("page"),
        F.length(F.trim(F.regexp_replace("body", r"^\n|\n$", ""))).cast("long").alias("chars"),
    )


@register(
    "p12_instructions",
    r"SELECT doc_id, regexp_matches(text, '(?i)ignore (all )?(the )?(previous|above) instructions|you are an? (ai|assistant)|as "
    r"an ai') AS hit FROM documents",
)
def p12(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id",
        F.col("text").rlike(
            r"(?i)ignore (all )?(the )?(previous|above) instructions|you are an? (ai|assistant)|as an ai"
        ).alias("hit"),
    )


@register(
    "p14_standard_of_title",
    X.with_(
        "docs",
        "SELECT rel, 'AS ' || (3500 + doc_id % 7) AS id, CAST(2000 + doc_id % 12 AS INTEGER) AS year, doc_id % 9 = 0 AS draft "
        "FROM docs",
    ),
)
def p14(spark, sf):
    title = F.concat(
        F.lit("AS "),
        (3500 + F.col("doc_id") % 7).cast("string"),
        F.lit(" : "),
        (2000 + F.col("doc_id") % 12).cast("string"),
        F.when(F.col("doc_id") % 9 == 0, " draft").otherwise(""),
    )
    return X.docs(spark, sf).select("rel", names.parse_standard(title).alias("p")).select("rel", "p.id", "p.year", "p.draft")


@register("p21_body", X.with_("docs library", "SELECT rel, length(text) AS chars FROM docs"))
def p21(spark, sf):
    return X.library(spark, sf).select("rel", F.length(names.body_of(F.col("md_raw"))).cast("long").alias("chars"))


@register(
    "p31_triage",
    "SELECT source, CASE WHEN avg(n_chars) < 1500 THEN 'scan' WHEN avg(n_chars) < 2000 THEN 'drawing' ELSE 'text' END AS class "
    "FROM documents GROUP BY source",
)
def p31(spark, sf):
    mean = F.avg("n_chars")
    return X.table(spark, sf, "documents").groupBy("source").agg(F.when(mean < 1500, "scan").when(mean < 2000, "drawing").otherwise("text").alias("class"))


@register("j13_impact", X.with_("snap", "SELECT new.rel, old.rel IS NOT NULL AS replaces FROM new LEFT JOIN old ON old.rel = new.rel"))
def j13(spark, sf):
    old, new = X.snapshots(spark, sf)
    return new.select("rel").join(
        old.select("rel", F.lit(True).alias("__live")),
        "rel",
        "left",
    ).select("rel", F.coalesce("__live", F.lit(False)).alias("replaces"))


@register("j26_library_document", X.with_("docs", "SELECT lower(split_part(rel, '/', 3)) AS name, count(*) AS documents FROM docs GROUP BY 1"))
def j26(spark, sf):
    """Source file names meet library documents with or without extension, whatever the case."""
    d = X.docs(spark, sf).select("rel", names.file_name(F.col("rel")).alias("file"))
    known = d.select(F.explode(F.array(F.lower("file"), F.regexp_replace(F.lower("file"), r"\.[^.]+$", ""))).alias("name"), "rel")
    return d.select(F.lower(F.upper("file")).alias("name")).distinct().join(known, "name").groupBy("name").agg(F.count_distinct("rel").alias("documents"))


@register(
    "j27_live_against_new",
    X.with_(
        "snap",
        "SELECT coalesce(old.rel, new.rel) AS rel, CASE WHEN old.rel IS NULL THEN 'new' WHEN new.rel IS NULL THEN 'removed' WHEN "
        "old.size = new.size THEN 'same' ELSE 'changed' END AS status FROM old FULL JOIN new ON old.rel = new.rel",
    ),
)
def j27(spark, sf):
    old, new = X.snapshots(spark, sf)
    both = old.select("rel", F.col("size").alias("was")).join(new.select("rel", F.col("size").alias("now")), "rel", "full")
    return both.select(
        "rel",
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(
            F.col("was") == F.col("now"),
            "same",
        ).otherwise("changed").alias("status"),
    )


@register(
    "j28_latest_suggestion",
    X.with_(
        "calls",
        "SELECT user_id, skill, arg_max(event_id, event_id) AS event_id FROM calls WHERE decision IS NOT NULL "
        "GROUP BY user_id, skill",
    ),
)
def j28(spark, sf):
    rows = X.calls(spark, sf).where("decision IS NOT NULL").select("user_id", "skill", "event_id")
    return state.latest(rows.withColumn("at", F.col("event_id")), ["user_id", "skill"], [F.col("at")]).drop("at")


@register(
    "j31_waiting_checks",
    X.with_(
        "calls",
        "SELECT skill, count(*) AS adopted, count(*) FILTER (event_id % 10 = 0) AS waiting FROM calls WHERE decision = 'adopted' "
        "GROUP BY skill",
    ),
)
def j31(spark, sf):
    return X.calls(spark, sf).where("decision = 'adopted'").groupBy("skill").agg(
        F.count(F.lit(1)).alias("adopted"),
        F.count_if(F.col("event_id") % 10 == 0).alias("waiting"),
    )


@register(
    "a7_room_counts",
    X.with_(
        "docs evals",
        "SELECT source AS room, count(*) AS files, count(*) FILTER (status = 'evaluated') AS finished, round(avg(auto_score), 6) "
        "AS mean_accuracy FROM evals GROUP BY source",
    ),
)
def a7(spark, sf):
    return X.evals(spark, sf).groupBy(F.col("source").alias("room")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == "evaluated").alias("finished"),
        F.round(F.avg("auto_score"), 6).alias("mean_accuracy"),
    )


@register(
    "a13_model_score",
    X.with_(
        "calls",
        "SELECT skill, round(100 * avg(CASE WHEN decision = 'adopted' THEN 1.0 ELSE 0.0 END), 6) AS score FROM calls "
        "WHERE decision IS NOT NULL GROUP BY skill",
    ),
)
def a13(spark, sf):
    return X.calls(spark, sf).where("decision IS NOT NULL").groupBy("skill").agg(
        F.round(100 * F.avg((F.col("decision") == "adopted").cast("double")), 6).alias("score")
    )


@register(
    "a18_folder_map",
    X.with_(
        "docs",
        "SELECT source, min(doc_id) AS first_page, max(doc_id) AS last_page, arg_min(rel, doc_id) AS first_file, count(*) AS "
        "files FROM docs GROUP BY source",
    ),
)
def a18(spark, sf):
    return X.docs(spark, sf).groupBy("source").agg(
        F.min("doc_id").alias("first_page"),
        F.max("doc_id").alias("last_page"),
        F.min_by("rel", "doc_id").alias("first_file"),
        F.count(F.lit(1)).alias("files"),
    )


@register(
    "a23_widen_suggestions",
    X.with_(
        "docs",
        "SELECT k, count(*) AS saved, CASE WHEN count(DISTINCT source) = 1 THEN 'series' ELSE 'all' END AS scope "
        "FROM (SELECT doc_id % 40 AS k, source FROM docs WHERE doc_id % 3 <> 0) GROUP BY k HAVING count(*) >= 2",
    ),
)
def a23(spark, sf):
    d = X.docs(spark, sf).where("doc_id % 3 <> 0").groupBy((F.col("doc_id") % 40).alias("k")).agg(
        F.count(F.lit(1)).alias("saved"),
        F.count_distinct("source").alias("series"),
    )
    return d.where("saved >= 2").select("k", "saved", F.when(F.col("series") == 1, "series").otherwise("all").alias("scope"))


@register("a26_needs_attention", X.with_("docs evals", "SELECT rel, status FROM evals WHERE status IN ('error', 'human_decide') ORDER BY status, rel LIMIT 20"))
def a26(spark, sf):
    return X.evals(spark, sf).where("status IN ('error', 'human_decide')").select("rel", "status").orderBy("status", "rel").limit(20)


@register(
    "a28_score_sheet",
    "SELECT o_orderpriority AS category, count(*) AS questions, round(avg(CASE WHEN o_orderkey % 4 <> 0 THEN 1.0 ELSE 0.0 END), "
    "9) AS pass_rate, median(CAST(o_orderkey % 157 AS DOUBLE)) AS median_s FROM orders GROUP BY 1",
)
def a28(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("category")).agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg((F.col("o_orderkey") % 4 != 0).cast("double")), 9).alias("pass_rate"),
        F.percentile((F.col("o_orderkey") % 157).cast("double"), F.lit(0.5)).alias("median_s"),
    )


@register(
    "w13_contents_usable",
    X.with_(
        "docs",
        "SELECT source, count(*) AS entries, count(*) FILTER (back) AS back_steps "
        "FROM (SELECT source, n_chars < lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS back FROM docs) GROUP BY source",
    ),
)
def w13(spark, sf):
    return verify.back_steps(X.docs(spark, sf).select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


@register(
    "u5_notifications",
    X.with_(
        "docs evals calls",
        "SELECT kind, k FROM (SELECT 'review' AS kind, rel AS k FROM evals WHERE status = 'human_decide' UNION ALL "
        "SELECT 'budget', CAST(skill AS VARCHAR) FROM calls GROUP BY skill HAVING sum(cost) >= 0.8) WHERE NOT k LIKE '%0.pdf'",
    ),
)
def u5(spark, sf):
    review = X.evals(spark, sf).where("status = 'human_decide'").select(F.lit("review").alias("kind"), F.col("rel").alias("k"))
    budget = X.calls(spark, sf).groupBy("skill").agg(F.sum("cost").alias("spend")).where("spend >= 0.8").select(
        F.lit("budget").alias("kind"),
        F.col("skill").cast("string").alias("k"),
    )
    return review.unionByName(budget).where("NOT k LIKE '%0.pdf'")


@register(
    "m4_decisions",
    X.with_(
        "calls",
        ", l AS (SELECT user_id AS rel, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN "
        "'include' ELSE 'exclude' END AS to_state FROM calls), u AS (SELECT rel, max(seq) FILTER (to_state IS NULL) AS undone "
        "FROM l GROUP BY rel) SELECT l.rel, arg_max(to_state, seq) AS decision FROM l JOIN u USING (rel) "
        "WHERE undone IS NULL OR seq > undone GROUP BY l.rel",
    ).replace("\n, l AS", ",\nl AS"),
)
def m4(spark, sf):
    i = F.col("event_id")
    log = X.calls(spark, sf).select(
        F.col("user_id").alias("rel"),
        i.alias("seq"),
        F.when(i % 7 == 0, F.lit(None).cast("string")).when(i % 2 == 0, "include").otherwise("exclude").alias("to_state"),
        F.lit("r").alias("reviewer"),
    )
    return state.verdicts(log).select("rel", F.col("trust_state").alias("decision"))


@register("m9_rollback", X.with_("snap", "SELECT rel, content_hash, CAST(1 AS INTEGER) AS run FROM old WHERE rel IN (SELECT rel FROM new) OR rel % 17 = 0"))
def m9(spark, sf):
    """Without run 2 the latest version of each file is that of run 1."""
    old, new = X.snapshots(spark, sf)
    versions = old.withColumn("run", F.lit(1)).unionByName(new.withColumn("run", F.lit(2)))
    return state.latest(
        versions.where("run <> 2").select("rel", "content_hash", "run").withColumn("at", F.col("run")),
        ["rel"],
        [F.col("at")],
    ).select("rel", "content_hash", "run")


@register("m10_backfill_counts", X.with_("docs", r"SELECT rel, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE length(text) END AS chars FROM docs"))
def m10(spark, sf):
    d = X.docs(spark, sf).withColumn("known", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    return d.select("rel", F.coalesce("known", F.length("text").cast("long")).alias("chars"))

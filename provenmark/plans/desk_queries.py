"""Queries over overviews, runs, feeds and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desk
from . import fixtures as X
from .registry import register
from .state_queries import BADGES, badges

NOW = 1_700_000_000


@register("a5_overview_row", X.with_(BADGES, r"""SELECT count(*) AS files, count(*) FILTER (state = 'trusted') AS trusted,
count(*) FILTER (state = 'need_review') AS need_review, count(*) FILTER (state = 'diff_big') AS diff_big,
count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'unreviewed') AS unreviewed,
round(avg(auto_score), 1) AS mean_score, count(auto_score) AS evaluated, count(verdict) AS reviewed,
round(100.0 * count(verdict) / count(*), 1) AS reviewed_pct, count(*) FILTER (status = 'deferred') AS deferred,
count(*) FILTER (salvage) AS salvage,
count(*) FILTER (status = 'human_decide' AND doc_id % 4 = 0) AS pending, count(*) FILTER (status = 'human_decide'
AND doc_id % 4 = 1) AS included, count(*) FILTER (status = 'human_decide' AND doc_id % 4 > 1) AS excluded FROM badges"""))
def a5(spark, sf):
    e, i = X.evals(spark, sf), F.col("doc_id")
    decisions = e.where("status = 'human_decide'").select("rel", F.when(i % 4 == 1, "include").when(i % 4 > 1, "exclude").alias("decision"))
    return desk.overview(badges(spark, sf), e, decisions)


def run_lines(spark, sf):
    """The output of a run for each source that has not ended: documents one after the other, a fifth of them skipped."""
    d, i = X.docs(spark, sf), F.col("doc_id")
    put = lambda cond, said: F.when(cond, said)
    some = F.floor(i / 20) % 5 != 0
    scan = some & (i % 3 == 0)
    verdict = F.when(i % 2 == 0, "PASS").when(i % 4 == 1, "METADATA").otherwise("FAIL")
    said = F.array(
        put(~some, F.lit("skip duplicate of another")), put(some, F.concat(F.lit("["), i, F.lit("] "), "rel")), put(some, F.lit("download 1 MB")), put(scan, F.lit("scanned document")), put(scan, F.lit("OCR page 1/4")), put(scan, F.lit("OCR page 3/4")),
        put(some & ~scan, F.lit("extracted 7 lines")), put(some & (i % 7 != 0), F.concat(F.lit("verification: "), verdict)), F.lit("a line that says nothing"),
    )
    lines = d.select(
        F.col("source").alias("run"),
        i,
        F.posexplode(said).alias("k", "line"),
    ).where("line IS NOT NULL").select("run", (i * 10 + F.col("k")).alias("n"), "line")
    return lines.unionByName(
        d.groupBy(F.col("source").alias("run")).agg(
            F.lit(-1).cast("long").alias("n"),
            F.concat(F.lit("files to check: "), F.count(F.lit(1)) * 2).alias("line"),
        )
    )


@register("s12_run_state", X.with_("docs", r""", c AS (SELECT source AS run, count(*) * 2 AS total,
max(doc_id) FILTER (doc_id // 20 % 5 <> 0) AS l, count(*) FILTER (doc_id // 20 % 5 = 0) AS skipped,
count(*) FILTER (doc_id // 20 % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 2 = 0) AS passed, count(*) FILTER (doc_id // 20 % 5 <> 0
AND doc_id % 7 <> 0 AND doc_id % 4 = 1) AS metadata, count(*) FILTER (doc_id // 20 % 5 <> 0 AND doc_id % 7 <> 0
AND doc_id % 4 = 3) AS failed FROM docs GROUP BY source)
SELECT run, total::INT AS total, l::INT AS index, rel AS file, CASE WHEN l % 7 = 0 THEN CASE
WHEN l % 3 = 0 THEN 'ocr' ELSE 'verifying' END WHEN l % 2 = 0 OR l % 4 = 1 THEN 'uploading' ELSE 'next' END AS stage,
l % 3 = 0 AS scan, CASE WHEN l % 3 = 0 THEN 3 ELSE 0 END AS page, CASE
WHEN l % 3 = 0 THEN 4 ELSE 0 END AS pages, passed, failed, metadata, skipped, round(least(5 + 90 * (l - 1 + CASE
WHEN l % 3 = 0 THEN 0.75 ELSE 0 END + skipped) / total, 98.0), 1) AS percent FROM c
JOIN docs ON doc_id = l""").replace("\n, c AS", ",\nc AS"))
def s12(spark, sf):
    return desk.run_status(run_lines(spark, sf))


AT = "1704067200.0 + ({0}) * 7919 % 2592000"


@register("u4_audit_feed_latest", X.with_("docs calls", rf""", f AS (SELECT {AT.format('p_partkey')} AS "at", 'u' || p_size AS who,
'rule_created' AS what, '#' || p_partkey || ' ' || p_name || ' → ' || p_brand || ' (all)' AS detail FROM part
UNION ALL SELECT {AT.format('s_suppkey')}, 'u' || s_nationkey, 'rule_undone', '#' || (s_suppkey % 9) || ' · ' || s_name
FROM supplier UNION ALL SELECT t, 'u' || user_id, 'ai_' || decision, skill || ' · ' FROM calls WHERE decision IS NOT NULL
UNION ALL SELECT {AT.format('doc_id')}, 'r' || (doc_id % 5), 'accepted', 'Room ' || source || ' · ' || rel FROM docs
WHERE doc_id % 3 = 0 UNION ALL SELECT 1706000000.0, 'boss', 'archived', 'Room ' || source FROM (SELECT DISTINCT source FROM docs)
WHERE source LIKE '%7')
SELECT "at", who, what, detail FROM f ORDER BY "at" DESC, what, detail LIMIT 200""").replace("\n, f AS", ",\nf AS"))
def u4(spark, sf):
    at = lambda c: F.expr(AT.format(c).replace("1704067200.0", "1704067200D"))
    rules = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("num"), F.col("p_name").alias("find"), F.col("p_brand").alias("replace"),
        F.lit("all").alias("scope"), F.concat(F.lit("u"), "p_size").alias("by"), at("p_partkey").alias("at"),
    )
    undone = X.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 9).alias("num"),
        F.col("s_name").alias("rel"),
        F.concat(F.lit("u"), "s_nationkey").alias("by"),
        at("s_suppkey").alias("at"),
    )
    calls = X.calls(spark, sf).select(
        F.col("skill").cast("string").alias("skill"), F.lit(None).cast("string").alias("rel"), "decision",
        F.concat(F.lit("u"), "user_id").alias("by"), F.col("t").alias("at"),
    )
    d, i = X.docs(spark, sf), F.col("doc_id")
    files = d.select(
        F.col("source").alias("room"),
        "rel",
        F.when(i % 3 == 0, F.concat(F.lit("r"), i % 5)).alias("confirmed_by"),
        at("doc_id").alias("confirmed_at"),
    )
    gone = F.endswith("source", F.lit("7"))
    rooms = d.select("source").distinct().select(
        F.col("source").alias("room"),
        F.concat(F.lit("Room "), "source").alias("name"),
        F.when(gone, "boss").alias("archived_by"),
        F.when(gone, 1_706_000_000.0).alias("archived_at"),
    )
    return desk.audit_feed(rules, undone, calls, files, rooms)


@register("u5_notices", X.with_("docs calls", rf""", r AS (SELECT o_orderkey AS id, 'src' || o_orderkey % 25 AS room,
CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'error' ELSE 'interrupted' END AS status, o_orderkey % 3 = 0 AS publish,
{NOW} - (o_orderkey * 37 % 61) * 86400 AS "at" FROM orders),
m AS (SELECT source AS room, source = 'src3' AS archived, count(*) FILTER (doc_id % 11 = 3) AS bad,
count(*) FILTER (doc_id % 11 = 1) AS below, {NOW} - min(doc_id) * 1000 AS "at" FROM docs GROUP BY source),
l AS (SELECT r.* FROM r JOIN m USING (room) WHERE r."at" >= {NOW} - 30 * 86400 QUALIFY row_number() OVER (PARTITION BY r.room
ORDER BY r."at" DESC, id DESC) = 1),
a AS (SELECT CASE WHEN status = 'done' THEN 'done:' ELSE 'fail:' END || id AS key, CASE WHEN status = 'done'
AND publish THEN 'published' WHEN status = 'done' THEN 'done'
WHEN status = 'interrupted' THEN 'interrupted' ELSE 'failed' END AS type, CASE
WHEN status = 'done' THEN 'ok' ELSE 'bad' END AS tone, "at", NULL::BIGINT AS n FROM l
UNION ALL SELECT 'bad:' || room || ':' || bad, 'unprocessable', 'bad', "at", bad FROM m WHERE NOT archived AND bad > 0 UNION ALL
SELECT 'review:' || room || ':' || below, 'review', 'warn', "at", below FROM m WHERE NOT archived AND below > 0
UNION ALL SELECT 'ai:2023-11:' || skill, 'ai_budget', 'ai', {NOW}, round(100.0 * count(*) / 640) FROM calls GROUP BY skill
HAVING count(*) >= 0.8 * 640 UNION ALL SELECT 'rule:' || p_partkey || ':' || p_size, 'rule_undone', 'warn', {NOW} - p_partkey * 40,
p_size FROM part WHERE p_size > 45 AND p_partkey % 2 = 0)
SELECT key, type, tone, "at"::DOUBLE AS "at", coalesce(n, 0)::BIGINT AS n, key LIKE 'review%' OR key LIKE 'done%' AS read FROM a
ORDER BY "at" DESC, key LIMIT 30""").replace("\n, r AS", ",\nr AS"))
def u5(spark, sf):
    o, d, i, k = X.table(spark, sf, "orders"), X.docs(spark, sf), F.col("doc_id"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "error").otherwise("interrupted")
    runs = o.select(
        k.alias("id"),
        F.concat(F.lit("src"), k % 25).alias("room"),
        status.alias("status"),
        (k % 3 == 0).alias("publish"),
        (F.lit(NOW) - (k * 37 % 61) * 86_400).alias("at"),
    )
    rooms = d.groupBy(F.col("source").alias("room")).agg(
        F.count_if(i % 11 == 3).alias("unprocessable"),
        F.count_if(i % 11 == 1).alias("below"),
        (F.lit(NOW) - F.min("doc_id") * 1000).alias("at"),
    ).withColumn("archived", F.col("room") == "src3")
    budgets = X.calls(spark, sf).groupBy("skill").agg(F.count(F.lit(1)).alias("spent")).select(
        "skill", "spent", F.lit(640).alias("budget"), F.lit("2023-11").alias("month"),
    )
    rules = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").alias("reverts"),
        (F.col("p_size") > 45).alias("often_undone"),
        (F.col("p_partkey") % 2 == 0).alias("enabled"),
        (F.lit(NOW) - F.col("p_partkey") * 40).alias("at"),
    )
    read = rooms.select(F.concat_ws(":", F.lit("review"), "room", "below").alias("key")).unionByName(runs.select(F.concat(F.lit("done:"), "id").alias("key")))
    return desk.notices(runs, rooms, budgets, rules, read, NOW).withColumn("n", F.coalesce("n", F.lit(0)))


@register("a12_promotion_record", X.with_("calls", rf""", d AS (SELECT skill, count(*) AS decided,
count(*) FILTER (decision = 'adopted') AS adopted FROM calls WHERE decision IS NOT NULL AND event_id % 50 <> 0
GROUP BY skill), w AS (SELECT p_partkey % 4 AS skill, count(*) AS wrong, max({NOW} - (p_partkey % 200) * 86400) AS last_wrong
FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 31 = 0 AND p_partkey % 200 <= 90 AND p_partkey % 4 <> 2 GROUP BY 1),
j AS (SELECT s.skill, coalesce(decided, 0) AS decided, coalesce(adopted, 0) AS adopted, round(100.0 * adopted / decided,
1) AS adoption, coalesce(wrong, 0) AS wrong, last_wrong FROM (SELECT DISTINCT skill FROM calls) s LEFT JOIN d USING (skill) LEFT
JOIN w USING (skill))
SELECT skill, decided, adopted, adoption, wrong, coalesce(last_wrong, 0) AS last_wrong, concat_ws(',', CASE
WHEN decided < 300 THEN 'decided' END, CASE WHEN adoption IS NULL OR adoption < 98 THEN 'adoption' END, CASE
WHEN wrong > 0 THEN 'wrong' END) AS missing, decided >= 300 AND coalesce(adoption >= 98, false) AND wrong = 0 AS eligible
FROM j""").replace("\n, d AS", ",\nd AS"))
def a12(spark, sf):
    c = X.calls(spark, sf).withColumn("by", F.when(F.col("event_id") % 50 == 0, "evaluation"))
    k = F.col("p_partkey")
    rules = X.table(spark, sf, "part").select(
        (k % 4).alias("skill"),
        (k % 3 == 0).alias("auto"),
        F.when((k % 31 == 0) & (k % 4 != 2), "wrong").otherwise("right").alias("check"),
        (F.lit(NOW) - (k % 200) * 86_400).alias("checked_at"),
    )
    return desk.eligibility(c, rules, X.table(spark, sf, "nation").select(F.col("n_name").alias("word")), NOW).withColumns(
        {"missing": F.array_join("missing", ","), "last_wrong": F.coalesce("last_wrong", F.lit(0))}
    )


@register("a18_folders_by_clause", X.with_("docs", r""", f AS (SELECT source AS doc, doc_id, CASE
WHEN doc_id % 4 = 0 THEN '' ELSE lang || '/' END AS folder, CASE doc_id % 3 WHEN 0 THEN 'A' || doc_id
WHEN 1 THEN 'C' || doc_id END AS first, CASE doc_id % 3 WHEN 0 THEN 'B' || doc_id WHEN 1 THEN 'C' || doc_id END AS last, CASE
WHEN doc_id % 2 = 0 THEN doc_id + 3 ELSE doc_id END AS p1 FROM docs)
SELECT doc, folder, arg_min(first, doc_id) FILTER (first IS NOT NULL) AS first, arg_max(last,
doc_id) FILTER (last IS NOT NULL) AS last, min(doc_id)::INT AS p0, max(p1)::INT AS p1, count(*) AS n FROM f
GROUP BY ALL""").replace("\n, f AS", ",\nf AS"))
def a18(spark, sf):
    i = F.col("doc_id")
    clauses = F.when(i % 3 == 0, F.concat(F.lit(" [A"), i, F.lit("–B"), i, F.lit("]"))).when(i % 3 == 1, F.concat(F.lit(" [C"), i, F.lit("]"))).otherwise("")
    name = F.concat(
        F.lpad(i.cast("string"), 9, "0"),
        F.lit(" Part"),
        clauses,
        F.lit(" p"),
        i,
        F.when(i % 2 == 0, F.concat(F.lit("-"), i + 3)).otherwise(""),
        F.lit(".md"),
    )
    return desk.folder_map(
        X.docs(spark, sf).select(
            F.col("source").alias("doc"),
            F.concat(F.when(i % 4 == 0, "").otherwise(F.concat("lang", F.lit("/"))), name).alias("path"),
        )
    )


@register("a21_engine_ranking", r"""WITH e AS (SELECT event_type AS degradation, event_id, unnest([1, 2, 3]) AS k
FROM events), p AS (SELECT degradation, k, (event_id * (k + 6) % 997) / 1024.0 AS acc
FROM e), m AS (SELECT degradation, k, avg(acc) AS acc FROM p GROUP BY ALL),
s AS (SELECT 'e' || k AS engine, avg(round(acc, 5)) AS score FROM m GROUP BY k)
SELECT engine, round(score, 5) AS mean_char_acc, row_number() OVER (ORDER BY score DESC, engine)::INT AS rank,
row_number() OVER (ORDER BY score DESC, engine) <= 2 AS chosen, row_number() OVER (ORDER BY score DESC, engine) = 1 AS published
FROM s""")
def a21(spark, sf):
    return desk.benchmark(*scans(spark, sf))[1]


@register("a21_engine_summary_by_damage", r"""WITH e AS (SELECT event_type AS degradation, event_id, unnest([1, 2, 3]) AS k
FROM events), p AS (SELECT degradation, 'e' || k AS engine, (event_id * (k + 6) % 997) / 1024.0 AS char_acc,
(event_id * (k + 9) % 991) / 1024.0 AS char_recall, (event_id * (k + 12) % 983) / 1024.0 AS num_recall FROM e),
o AS (SELECT event_type AS degradation, count(*) AS pages, count(*) FILTER (event_id % 4 <> 0) AS accepted, min(CASE
WHEN event_id % 4 <> 0 THEN (event_id * 7 % 997) / 1024.0 END) AS worst_accepted FROM events GROUP BY 1)
SELECT degradation, engine, round(avg(char_acc), 5) AS char_acc, round(avg(char_recall), 5) AS char_recall, round(avg(num_recall),
5) AS num_recall, any_value(pages) AS pages, any_value(accepted) AS accepted, any_value(worst_accepted) AS worst_accepted FROM p
JOIN o USING (degradation) GROUP BY ALL""")
def a21_summary(spark, sf):
    return desk.benchmark(*scans(spark, sf))[0]


def scans(spark, sf):
    """Three engines on every event as a page, damaged by its type; a quarter of the pages is not accepted."""
    e, i = X.table(spark, sf, "events"), F.col("event_id")
    k = F.col("k")
    share = lambda step, of: (i * (k + step) % of) / 1024.0
    pages = e.select(F.col("event_type").alias("degradation"), i.alias("event_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    pages = pages.select(
        "degradation", i.alias("page"), F.concat(F.lit("e"), k).alias("engine"), share(6, 997).alias("char_acc"),
        share(9, 991).alias("char_recall"), share(12, 983).alias("num_recall"),
    )
    outcomes = e.select(
        F.col("event_type").alias("degradation"),
        i.alias("page"),
        F.when(i % 4 != 0, "ok").otherwise("review").alias("status"),
        ((i * 7 % 997) / 1024.0).alias("published_acc"),
    )
    return pages, outcomes

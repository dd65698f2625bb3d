"""Queries over scores, verdicts, work, listings, calls and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, score, text
from ..operators import state
from ..operators.containment import check_grounds, contained
from . import fixtures as X
from .registry import register

STATES = ("trusted", "need_review", "diff_big", "rejected", "unreviewed")
BADGES = "docs evals trust badges"


def badges(spark, sf):
    return state.badges(X.evals(spark, sf), X.evals(spark, sf).select("rel", F.lit(1).alias("__seen")), X.trust(spark, sf).drop("doc_id"))


@register("p25_trust_state", X.with_(BADGES, "SELECT rel, state FROM badges"))
def p25(spark, sf):
    return badges(spark, sf).select("rel", "state")


@register("j6_badges", X.with_(BADGES, "SELECT rel, auto_score, verdict, state FROM badges"))
def j6(spark, sf):
    return badges(spark, sf).select("rel", "auto_score", "verdict", "state")


@register("a4_corpus_totals", X.with_("docs evals", "SELECT count(*) AS files, sum(src_chars) AS chars, round(avg(auto_score), 6) AS mean_score FROM evals"))
def a4(spark, sf):
    return X.evals(spark, sf).agg(F.count(F.lit(1)).alias("files"), F.sum("src_chars").alias("chars"), F.round(F.avg("auto_score"), 6).alias("mean_score"))


@register(
    "a5_overview",
    X.with_(
        BADGES,
        "SELECT v.state, count(badges.rel) AS files, round(avg(auto_score), 6) AS mean_score "
        "FROM (VALUES ('trusted'), ('need_review'), ('diff_big'), ('rejected'), ('unreviewed')) v(state) LEFT "
        "JOIN badges USING (state) GROUP BY v.state",
    ),
)
def a5(spark, sf):
    every = spark.createDataFrame([(s,) for s in STATES], "state string")
    counts = badges(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("auto_score"), 6).alias("mean_score"))
    return every.join(counts, "state", "left").select("state", F.coalesce("files", F.lit(0)).cast("long").alias("files"), "mean_score")


@register(
    "a6_folder_tree",
    X.with_(
        BADGES,
        "SELECT folder, count(*) AS files, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES) + " FROM (SELECT state, unnest(['', source, source || '/' || split_part(rel, '/', 2)]) AS folder FROM badges) "
        "GROUP BY folder"
    )
)
def a6(spark, sf):
    return state.tree(badges(spark, sf), STATES)


@register(
    "a8_reviewer_workload",
    X.with_(
        "docs trust",
        "SELECT reviewer, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'diff_big') AS diff_big, count(*) "
        "FILTER (verdict = 'rejected') AS rejected FROM trust GROUP BY reviewer",
    ),
)
def a8(spark, sf):
    return X.trust(spark, sf).groupBy("reviewer").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "diff_big", "rejected")])


@register(
    "a9_decisions",
    X.with_(
        "docs evals",
        "SELECT CASE WHEN doc_id % 3 = 0 THEN 'include' WHEN doc_id % 3 = 1 THEN 'exclude' ELSE 'pending' END AS decision, "
        "count(*) AS n FROM evals WHERE status = 'human_decide' GROUP BY 1",
    ),
)
def a9(spark, sf):
    d = F.col("doc_id") % 3
    return X.evals(spark, sf).where("status = 'human_decide'").groupBy(
        F.when(d == 0, "include").when(d == 1, "exclude").otherwise("pending").alias("decision")
    ).agg(F.count(F.lit(1)).alias("n"))


@register("a29_batch_counts", X.with_("docs evals", "SELECT status, count(*) AS n FROM evals GROUP BY status"))
def a29(spark, sf):
    return X.evals(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("j7_decision_queue", X.with_("docs evals", "SELECT rel FROM evals WHERE status = 'human_decide' AND NOT doc_id % 3 IN (0, 1)"))
def j7(spark, sf):
    e = X.evals(spark, sf)
    return e.where("status = 'human_decide'").join(e.where("doc_id % 3 IN (0, 1)").select("rel"), "rel", "left_anti").select("rel")


@register(
    "j8_work_selection",
    X.with_(
        "docs evals",
        "SELECT rel, CASE WHEN src_chars > 5000 THEN 'deferred' ELSE 'evaluate' END AS task FROM evals "
        "WHERE status <> 'evaluated' AND doc_id % 7 <> 0",
    ),
)
def j8(spark, sf):
    e = X.evals(spark, sf)
    files = e.select("rel", F.col("src_chars").alias("size"))
    return state.work(
        files,
        e.where("status = 'evaluated'").select("rel", "status"),
        e.where("doc_id % 7 = 0").select("rel"),
        "all",
        5000,
    ).select("rel", "task")


@register(
    "j9_ledger_todo",
    X.with_(
        "snap",
        "SELECT new.rel FROM new LEFT JOIN old ON old.rel = new.rel AND old.content_hash = new.content_hash AND old.rel % 5 <> 0 "
        "WHERE old.rel IS NULL",
    ),
)
def j9(spark, sf):
    old, new = X.snapshots(spark, sf)
    ledger = old.select("rel", "content_hash", F.lit("v2").alias("pipeline"), F.when(F.col("rel") % 5 == 0, "FAIL").otherwise("PASS").alias("verdict"))
    return state.ledger_todo(new, ledger, "v2").select("rel")


@register(
    "j10_snapshot_diff",
    X.with_(
        "snap",
        "SELECT coalesce(old.rel, new.rel) AS rel, CASE WHEN old.rel IS NULL THEN 'ADDED' WHEN new.rel IS NULL THEN 'REMOVED' "
        "ELSE 'CHANGED(size)' END AS change FROM old FULL JOIN new ON old.rel = new.rel "
        "WHERE old.rel IS NULL OR new.rel IS NULL OR old.size <> new.size",
    ),
)
def j10(spark, sf):
    return state.snapshot_diff(*X.snapshots(spark, sf), ["content_hash", "size"])


@register(
    "j11_staging_check",
    X.with_(
        "snap",
        "SELECT coalesce(old.rel, new.rel) AS rel, CASE WHEN old.rel IS NULL THEN 'unexpected' WHEN new.rel IS NULL THEN "
        "'missing' ELSE 'size differs' END AS problem FROM old FULL JOIN new ON old.rel = new.rel "
        "WHERE old.rel IS NULL OR new.rel IS NULL OR old.size <> new.size",
    ),
)
def j11(spark, sf):
    old, new = X.snapshots(spark, sf)
    both = old.select("rel", F.col("size").alias("want")).join(new.select("rel", "size"), "rel", "full")
    return both.select(
        "rel",
        F.when(F.col("want").isNull(), "unexpected").when(F.col("size").isNull(), "missing").when(
            F.col("want") != F.col("size"),
            "size differs",
        ).alias("problem"),
    ).where("problem IS NOT NULL")


@register("u3_sources_gone", X.with_("snap", "SELECT rel FROM old EXCEPT SELECT rel FROM new"))
def u3(spark, sf):
    old, new = X.snapshots(spark, sf)
    return old.select("rel").join(new.select("rel"), "rel", "left_anti")


@register(
    "w4_duplicate_files",
    X.with_(
        "docs",
        "SELECT d.rel, f.first_rel FROM docs d JOIN (SELECT md5(text) AS h, min(rel) AS first_rel FROM docs "
        "GROUP BY 1) f ON md5(d.text) = f.h WHERE d.rel <> f.first_rel",
    ),
)
def w4(spark, sf):
    return state.duplicates(X.docs(spark, sf).select("rel", F.md5("text").alias("content_hash"))).select("rel", "first_rel")


@register("p33_text_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p33(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@register(
    "w5_queue_position",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus "
    "ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS position FROM orders",
)
def w5(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return state.numbered(o, ["o_orderstatus"], ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@register(
    "w6_recent_adoption",
    X.with_(
        "calls",
        "SELECT skill, round(avg(CASE WHEN decision = 'adopted' THEN 1.0 ELSE 0.0 END), 9) AS rate "
        "FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY t DESC, event_id DESC) AS r FROM calls "
        "WHERE decision IS NOT NULL) WHERE r <= 50 GROUP BY skill",
    ),
)
def w6(spark, sf):
    last = Window.partitionBy("skill").orderBy(F.desc("t"), F.desc("event_id"))
    rows = X.calls(spark, sf).where("decision IS NOT NULL").withColumn("r", F.row_number().over(last)).where("r <= 50")
    return rows.groupBy("skill").agg(F.round(F.avg((F.col("decision") == "adopted").cast("double")), 9).alias("rate"))


@register(
    "w7_breaker",
    X.with_(
        "calls",
        "SELECT event_id FROM (SELECT *, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER w3 AS bad, lag(t, 2) OVER "
        "(PARTITION BY user_id ORDER BY t, event_id) AS t2 FROM calls WINDOW w3 AS (PARTITION BY user_id "
        "ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE bad = 3 AND t - t2 <= 600000",
    ),
)
def w7(spark, sf):
    c = X.calls(spark, sf).select("event_id", F.col("user_id").alias("skill"), F.col("event_id").alias("id"), "t", "status")
    return state.breaker(c, 600_000.0).where("paused").select("event_id")


@register("w8_failed_logins", X.with_("logins", """, r AS (SELECT *, coalesce(sum(CASE
WHEN type = 'login' THEN 1 ELSE 0 END) OVER (PARTITION BY address ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING), 0) AS run FROM logins),
f AS (SELECT *, coalesce(sum(CASE WHEN type = 'login_failed' THEN 1 ELSE 0 END) OVER (PARTITION BY address, run
ORDER BY t RANGE BETWEEN 200000 PRECEDING AND 1 PRECEDING), 0) AS recent FROM r) SELECT id, recent, recent >= 3 AS blocked
FROM f""").replace("\n, r AS", ",\nr AS"))
def w8(spark, sf):
    return state.failures_in_window(X.logins(spark, sf), 3, 200_000).select("id", "recent", "blocked")


@register("w14_sampled_checks")
def w14(spark, sf):
    e = X.evals(spark, sf).withColumn("rule", F.col("doc_id") % 12)
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("rel"))
    first = e.select("rule", "rel").withColumn("nth", nth).where("nth <= 3").select("rule", "rel", F.lit(True).alias("early"))  # three rows of each task
    drawn = F.crc32(F.concat_ws("|", F.col("rule").cast("string"), F.lit("room"), "rel")) % 5 == 0
    return e.join(first, ["rule", "rel"], "left").select("rule", "rel", (F.coalesce("early", F.lit(False)) | drawn).alias("sampled"))


@register("m2_verdict_log", X.with_("calls", """, l AS (SELECT user_id AS rel, event_id AS seq, CASE WHEN status = 'error' THEN NULL
WHEN status = 'ok' THEN 'ok' ELSE 'diff_big' END AS to_state, skill AS reviewer FROM calls),
u AS (SELECT rel, max(seq) FILTER (to_state IS NULL) AS undone FROM l GROUP BY rel)
SELECT l.rel, arg_max(to_state, seq) AS trust_state, arg_max(reviewer, seq) AS reviewer, count(*) AS rev_no FROM l
JOIN u USING (rel) WHERE undone IS NULL OR seq > undone GROUP BY l.rel""").replace("\n, l AS", ",\nl AS"))
def m2(spark, sf):
    c = X.calls(spark, sf)
    log = c.select(
        F.col("user_id").alias("rel"),
        F.col("event_id").alias("seq"),
        F.when(F.col("status") == "ok", "ok").when(F.col("status") != "error", "diff_big").alias("to_state"),
        F.col("skill").alias("reviewer"),
    )
    return state.verdicts(log)


@register("m1_upsert", X.with_("calls", "SELECT user_id, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM calls GROUP BY user_id"))
def m1(spark, sf):
    return state.latest(X.calls(spark, sf).select("user_id", "event_id", "status"), ["user_id"], [F.col("event_id")]).select("user_id", "status", "event_id")


@register("m3_batch_review", X.with_("docs evals trust", "SELECT rel FROM evals WHERE auto_score >= 80 AND rel NOT IN (SELECT rel FROM trust)"))
def m3(spark, sf):
    return X.evals(spark, sf).where("auto_score >= 80").join(X.trust(spark, sf), "rel", "left_anti").select("rel")


@register(
    "a11_usage_by_month",
    X.with_(
        "calls",
        "SELECT skill, strftime(ts, '%Y-%m') AS month, count(*) AS calls, count(*) FILTER (status = 'cached') AS cached, count(*) "
        "FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'error') AS errors, round(sum(cost), 4) AS spend, "
        "count(decision) AS decided FROM calls GROUP BY ALL",
    ),
)
def a11(spark, sf):
    c = X.calls(spark, sf)
    kinds = [F.count_if(F.col("status") == s).alias(n) for s, n in (("cached", "cached"), ("blocked", "blocked"), ("error", "errors"))]
    return c.groupBy("skill", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), *kinds, F.round(F.sum("cost"), 4).alias("spend"), F.count("decision").alias("decided"),
    )


@register(
    "a12_eligibility",
    X.with_(
        "calls",
        "SELECT skill, count(decision) AS decided, count(*) FILTER (decision = 'adopted') AS adopted, count(decision) >= 300 AND "
        "count(*) FILTER (decision = 'adopted') >= 0.98 * count(decision) AS eligible FROM calls GROUP BY skill",
    ),
)
def a12(spark, sf):
    decided, adopted = F.count("decision"), F.count_if(F.col("decision") == "adopted")
    return X.calls(spark, sf).groupBy("skill").agg(
        decided.alias("decided"),
        adopted.alias("adopted"),
        ((decided >= 300) & (adopted >= 0.98 * decided)).alias("eligible"),
    )


@register(
    "a14_glossary",
    X.with_(
        "docs trust",
        r"SELECT word, count(*) AS n FROM (SELECT lower(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), "
        r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS word FROM docs WHERE rel IN (SELECT rel FROM trust "
        r"WHERE verdict = 'ok')) WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 3",
    ),
)
def a14(spark, sf):
    ok = X.docs(spark, sf).join(X.trust(spark, sf).where("verdict = 'ok'").select("rel"), "rel", "left_semi")
    words = ok.select(F.explode(F.split("text", r"\s+")).alias("w")).select(
        F.lower(F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("word")
    )
    return words.where("length(word) >= 2").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@register(
    "a17_library_facts",
    X.with_(
        "docs library",
        r"SELECT source, count(*) AS files, bool_or(contains(regexp_extract(md_raw, 'flags: ([^\n]*)', 1), 'ocr')) AS any_ocr, "
        r"count(*) FILTER (regexp_extract(md_raw, 'status: ([^\n]*)', 1) = 'draft') AS drafts FROM library GROUP BY source",
    ),
)
def a17(spark, sf):
    d = X.library(spark, sf).withColumn("front", names.front_matter(F.col("md_raw")))
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"),
        F.bool_or(F.contains(F.col("front")["flags"], F.lit("ocr"))).alias("any_ocr"),
        F.count_if(F.col("front")["status"] == "draft").alias("drafts"),
    )


@register(
    "s3_front_matter",
    X.with_(
        "docs library",
        r"SELECT rel, regexp_extract(md_raw, 'std_id: ([^\n]*)', 1) AS std_id, CAST(regexp_extract(md_raw, 'std_year: ([^\n]*)', "
        r"1) AS INTEGER) AS std_year, trim(regexp_extract(md_raw, 'flags: ([^\n]*)', 1)) AS flags FROM library",
    ),
)
def s3(spark, sf):
    d = X.library(spark, sf).withColumn("front", names.front_matter(F.col("md_raw")))
    return d.select(
        "rel",
        F.col("front")["std_id"].alias("std_id"),
        F.col("front")["std_year"].cast("int").alias("std_year"),
        F.col("front")["flags"].alias("flags"),
    )


@register(
    "a19_latest_edition",
    X.with_(
        "docs library",
        r"SELECT std_id, max(std_year) AS std_year FROM (SELECT regexp_extract(md_raw, 'std_id: ([^\n]*)', 1) AS std_id, "
        r"CAST(regexp_extract(md_raw, 'std_year: ([^\n]*)', 1) AS INTEGER) AS std_year, regexp_extract(md_raw, 'status: "
        r"([^\n]*)', 1) AS st FROM library) WHERE st <> 'draft' GROUP BY std_id",
    ),
)
def a19(spark, sf):
    d = X.library(spark, sf).withColumn("front", names.front_matter(F.col("md_raw"))).where(F.col("front")["status"] != "draft")
    return d.groupBy(F.col("front")["std_id"].alias("std_id")).agg(F.max(F.col("front")["std_year"].cast("int")).alias("std_year"))


@register("a20_token_cost", """WITH t AS (SELECT lang, strlen(text) // 4 AS tokens
FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tokens) AS i, count(*) OVER (PARTITION BY lang) AS n
FROM t),
q AS (SELECT lang, i, n, tokens, p, greatest(1, least(n - 1, floor(p * (n + 1)))) AS lo, p * (n + 1) AS pos FROM r, (VALUES (0.05), (0.5), (0.95)) v(p))
SELECT lang, CAST(p AS DOUBLE) AS p, round(sum(CASE WHEN i = lo THEN tokens * (1 - (pos - lo))
WHEN i = lo + 1 THEN tokens * (pos - lo) END), 6) AS tokens FROM q WHERE i IN (lo, lo + 1) GROUP BY lang, p""")
def a20(spark, sf):
    """Exclusive quantiles, position p * (n + 1), from ranked rows of each language."""
    t = X.table(spark, sf, "documents").select("lang", F.floor(F.octet_length("text") / 4).alias("tokens"))
    return state.exclusive_quantiles(t, "lang", "tokens", [0.05, 0.5, 0.95])


@register("o2_smallest_first", X.with_("docs", "SELECT rel, n_chars, row_number() OVER (ORDER BY n_chars, rel) AS position FROM docs"))
def o2(spark, sf):
    """All work in its order: each row has its place, so that no table has to be sorted whole."""
    d = X.docs(spark, sf).select("rel", "n_chars", F.lit("work").alias("queue"))
    return state.numbered(d, ["queue"], ["n_chars", "rel"]).select("rel", "n_chars", "position")


@register(
    "o3_file_page",
    X.with_(
        BADGES,
        "SELECT rel, state FROM badges WHERE state = 'unreviewed' AND contains(lower(rel), 'en') "
        "ORDER BY lower(rel), rel LIMIT 20 OFFSET 20",
    ),
)
def o3(spark, sf):
    b = badges(spark, sf).where((F.col("state") == "unreviewed") & F.contains(F.lower("rel"), F.lit("en")))
    return b.select("rel", "state").orderBy(F.lower("rel"), "rel").offset(20).limit(20)


@register("o4_biggest_files", X.with_("docs", "SELECT rel, n_chars FROM docs ORDER BY n_chars DESC, rel LIMIT 10"))
def o4(spark, sf):
    return X.docs(spark, sf).select("rel", "n_chars").orderBy(F.desc("n_chars"), "rel").limit(10)


@register("o5_deferred", X.with_("docs evals", "SELECT rel, salvage FROM evals WHERE status = 'deferred' OR salvage"))
def o5(spark, sf):
    return X.evals(spark, sf).where("status = 'deferred' OR salvage").select("rel", "salvage")


@register(
    "u4_audit_feed",
    X.with_(
        "docs trust calls",
        "SELECT kind, k, who FROM (SELECT 'verdict' AS kind, CAST(doc_id AS VARCHAR) AS k, reviewer AS who FROM trust UNION ALL "
        "SELECT 'call', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM calls WHERE decision IS NOT NULL)",
    ),
)
def u4(spark, sf):
    a = X.trust(spark, sf).select(F.lit("verdict").alias("kind"), F.col("doc_id").cast("string").alias("k"), F.col("reviewer").alias("who"))
    b = X.calls(spark, sf).where("decision IS NOT NULL").select(
        F.lit("call").alias("kind"),
        F.col("event_id").cast("string").alias("k"),
        F.col("user_id").cast("string").alias("who"),
    )
    return a.unionByName(b)


@register(
    "j32_reviewer_registry",
    X.with_(
        "docs trust",
        "SELECT coalesce(s.r, l.r) AS reviewer, s.r IS NOT NULL AS worked, l.r IS NOT NULL AS listed "
        "FROM (SELECT DISTINCT lower(trim(reviewer)) AS r FROM trust) s FULL "
        "JOIN (SELECT DISTINCT lower(trim(' R' || (c_custkey % 4) || ' ')) AS r FROM customer) l ON s.r = l.r",
    ),
)
def j32(spark, sf):
    worked = X.trust(spark, sf).select(F.lower(F.trim("reviewer")).alias("reviewer")).distinct().withColumn("w", F.lit(True))
    listed = X.table(spark, sf, "customer").select(
        F.lower(F.trim(F.concat(F.lit(" R"), F.col("c_custkey") % 4, F.lit(" ")))).alias("reviewer")
    ).distinct().withColumn("l", F.lit(True))
    return worked.join(listed, "reviewer", "full").select(
        "reviewer",
        F.coalesce("w", F.lit(False)).alias("worked"),
        F.coalesce("l", F.lit(False)).alias("listed"),
    )


@register(
    "p28_decide",
    X.with_(
        "docs evals",
        "SELECT rel, CASE WHEN auto_score IS NULL OR doc_id % 3 > 1 OR auto_score < 70 THEN 'below' ELSE 'ok' END AS decision "
        "FROM evals",
    ),
)
def p28(spark, sf):
    return X.evals(spark, sf).select(
        "rel",
        score.decide(F.col("auto_score"), F.greatest(F.col("doc_id") % 3 - 1, F.lit(0)), F.lit(70.0), F.lit(True)).alias("decision"),
    )


@register("p26_accuracy", """WITH p AS (SELECT o_orderkey, (o_orderkey % 101) / 100.0 AS t, CASE
WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 7) / 6.0 END AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0.5 END AS h,
CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.0 END AS b FROM orders)
SELECT o_orderkey, round(100 * (0.4 * t + coalesce(0.3 * n, 0) + coalesce(0.2 * h, 0) + coalesce(0.1 * b, 0)) / (0.4 + CASE
WHEN n IS NULL THEN 0 ELSE 0.3 END + CASE WHEN h IS NULL THEN 0 ELSE 0.2 END + CASE
WHEN b IS NULL THEN 0 ELSE 0.1 END) + 1e-9, 1) AS accuracy FROM p""")
def p26(spark, sf):
    k = F.col("o_orderkey")
    parts = {
        "text": (k % 101) / 100.0, "numbers": F.when(k % 3 != 0, (k % 7) / 6.0), "headings": F.when(k % 5 != 0, F.lit(0.5)),
        "tables": F.when(k % 2 != 0, F.lit(1.0)),
    }
    return X.table(spark, sf, "orders").select("o_orderkey", score.accuracy(parts).alias("accuracy"))


@register(
    "p19_reason_code",
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'download' WHEN 'click' THEN 'unreadable' ELSE 'other' END AS reason "
    "FROM events",
)
def p19(spark, sf):
    e = X.table(spark, sf, "events")
    said = F.when(F.col("event_type") == "error", "Read TIMED OUT").when(F.col("event_type") == "click", "file is damaged").otherwise(F.col("event_type"))
    return e.select("event_id", score.reason_code(said).alias("reason"))


@register("p34_edit_accuracy", "SELECT p_partkey, round(1 - levenshtein(p_name, reverse(p_name)) / length(p_name), 9) AS accuracy FROM part")
def p34(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", F.round(1 - F.levenshtein("p_name", F.reverse("p_name")) / F.length("p_name"), 9).alias("accuracy"))


@register("p45_call_cost", "SELECT l_orderkey, l_linenumber, round((l_quantity * 3.0 + l_linenumber * 15.0) / 1000000, 9) AS cost FROM lineitem")
def p45(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(score.call_cost(F.col("l_quantity"), F.col("l_linenumber"), F.lit(3.0), F.lit(15.0)), 9).alias("cost"),
    )


@register(
    "j16_grounding",
    "SELECT item_id, count(doc_id) AS pages FROM benchmark b LEFT "
    "JOIN documents d ON contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(regexp_replace(b.text, '\\s+', ' ', "
    "'g'))) GROUP BY item_id",
)
def j16(spark, sf):
    """Pages that contain a ground text, in the normal form of lines."""
    bank = X.table(spark, sf, "benchmark").where("text IS NOT NULL").select("item_id", text.normalize_line("text").alias("find"))
    pages = X.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.normalize_line("text").alias("text"))
    found = contained(pages, bank, ["doc_id"], ["item_id"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("pages"))
    return X.table(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left").select(
        "item_id",
        F.coalesce("pages", F.lit(0)).cast("long").alias("pages"),
    )


BANK = r"""
sp AS (SELECT rel, doc_id, n // 5 + 1 AS page, string_agg(line, ' ' ORDER BY n) AS text FROM s GROUP BY ALL),
pu AS (SELECT rel, doc_id, n // 5 + 1 AS page, string_agg('**' || line || '** |', ' ' ORDER BY n) AS text FROM s
WHERE (doc_id * 31 + n) % 10 <> 0 AND NOT (doc_id % 5 = 4 AND n // 5 = 1) GROUP BY ALL),
q AS (SELECT rel AS question, rel AS doc, doc_id, array_to_string(string_split(line, ' ')[1:3], ' ') AS find, n // 5 + 1 AS page, n FROM s WHERE n IN (0, 6)),
src AS (SELECT rel, page, NORM AS text FROM sp), pub AS (SELECT rel, page, doc_id, NORM AS text FROM pu),
met AS (SELECT q.*, src.text AS source, coalesce(pub.text, '') AS published, lower(trim(regexp_replace(regexp_replace(find,
'[*_|`]', ' ', 'g'), '\s+', ' ', 'g'))) AS norm FROM q LEFT JOIN src ON src.rel = doc AND src.page = q.page LEFT
JOIN pub ON pub.rel = doc AND pub.page = q.page)
SELECT question, 'no unit' AS problem, doc, page, NULL AS subject FROM met WHERE published = ''
UNION ALL SELECT question, 'not on the source page', doc, page, find FROM met WHERE NOT contains(source, norm)
UNION ALL SELECT question, 'not in the published text', doc, page, find FROM met WHERE published <> '' AND NOT contains(published, norm)
UNION ALL SELECT question, 'no marker', doc, page, NULL FROM met WHERE n = 6 AND doc_id % 7 = 0 AND NOT contains(published, 'not readable')
UNION ALL SELECT question, 'clause not listed', doc, page, 'C' || page FROM met WHERE n = 6 AND doc_id % 3 = 0
UNION ALL SELECT rel, 'edition not found', rel, 0, 'published' FROM docs WHERE doc_id % 9 = 0
UNION ALL SELECT d.rel, 'is in the library', NULL, 0, min(x.rel) FROM docs d
JOIN docs x ON contains(lower(x.rel), 'oc_' || (d.doc_id * 3) || '.p') GROUP BY d.rel
UNION ALL SELECT 'bare ' || rel, 'no ground', NULL, 0, NULL FROM docs WHERE doc_id % 10 = 0
""".replace("NORM", r"lower(trim(regexp_replace(regexp_replace(text, '[*_|`]', ' ', 'g'), '\s+', ' ', 'g')))")


@register("j16_bank_check", X.with_("docs s", ", " + BANK.strip()).replace("\n, sp AS", ",\nsp AS"))
def j16_bank(spark, sf):
    """A question a document: the first words of two lines on their pages, the clause of the second page (documents divisible by three do not
    list it), the edition, and a document that must not be in the library. The published text has lost a tenth of the lines, every
    fifth document its second page; no published page says that it is not readable."""
    d, n, i = X.docs(spark, sf).select("rel", "doc_id"), F.col("n"), F.col("doc_id")
    rows = X.docs(spark, sf).select("rel", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    page = (F.floor(n / 5) + 1).cast("long").alias("page")
    joined = lambda df: df.groupBy(F.col("rel").alias("doc"), page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("text"))
    lost = ((i * 31 + n) % 10 == 0) | ((i % 5 == 4) & (F.floor(n / 5) == 1))
    units = joined(rows.where(~lost).withColumn("line", F.concat(F.lit("**"), "line", F.lit("** |"))))
    files = d.select(
        F.col("rel").alias("path"),
        F.col("rel").alias("doc"),
        F.when(i % 3 == 0, F.array(F.lit("C1"))).otherwise(F.array(F.lit("C1"), F.lit("C2"))).alias("clauses"),
        F.when(i % 9 == 0, "draft").otherwise("published").alias("edition"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    first = F.array(F.array_join(F.slice(F.split("line", " "), 1, 3), " "))
    shape = lambda df, page, has, clause, marker, absent, edition, doc="rel": df.select(F.col("rel").alias("question"), (F.col(doc) if doc else none("string")).alias("doc"), page.alias("page"), has.alias("contains"), clause.alias("clause"), marker.alias("unreadable"), absent.alias("absent"), edition.alias("edition"))
    on_page = shape(rows.where("n IN (0, 6)"), page, first, F.when(n == 6, F.lit("C2")), (n == 6) & (i % 7 == 0), none("string"), none("string"))
    edition = shape(d, none("long"), none("array<string>"), none("string"), none("boolean"), none("string"), F.lit("published"))
    absent = shape(d, none("long"), none("array<string>"), none("string"), none("boolean"), F.concat(F.lit("oc_"), i * 3, F.lit(".P")), none("string"), None)
    questions = d.select(F.col("rel").alias("question")).unionByName(d.where("doc_id % 10 = 0").select(F.concat(F.lit("bare "), "rel").alias("question")))
    return check_grounds(questions, on_page.unionByName(edition).unionByName(absent), joined(rows), units, files).fillna(0, ["page"])

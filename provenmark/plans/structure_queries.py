"""Queries over structure, logs, trees of files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import rules, structure
from ..sources.tables import new_folder, written
from ..streaming import jobs, logs
from . import fixtures as X
from . import rule_queries
from .registry import register


def lines(spark, sf):
    src, _ = X.conv(spark, sf)
    return src.join(X.docs(spark, sf).select("rel", "doc_id", "source"), "rel")


@register("j17_pages_with_text", X.with_("docs s", r""", p AS (SELECT rel, n // 5 AS page,
lower(trim(regexp_replace(string_agg(line, ' ' ORDER BY n), '\s+', ' ', 'g'))) AS body FROM s
GROUP BY ALL), a AS (SELECT rel, n AS ask, lower(trim(regexp_replace(array_to_string(string_split(line, ' ')[1:4], ' '), '\s+', ' ',
'g'))) AS find FROM s WHERE n % 7 = 2 AND trim(line) <> '')
SELECT a.rel, ask, page FROM a JOIN p ON a.rel = p.rel AND contains(body, find)""").replace("\n, p AS", ",\np AS"))
def j17(spark, sf):
    """Which pages of its document hold the first four words of every seventh line."""
    src, _ = X.conv(spark, sf)
    pages = src.groupBy("rel", F.floor(F.col("n") / 5).alias("page")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("text")
    )
    asks = src.where("n % 7 = 2 AND trim(line) <> ''").select(
        "rel",
        F.col("n").alias("ask"),
        F.array_join(F.slice(F.split("line", " "), 1, 4), " ").alias("find"),
    )
    return structure.pages_with(pages, asks)


@register(
    "j19_cross_references",
    "WITH l AS (SELECT l_orderkey AS rel, l_linenumber AS n, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) "
    "SELECT rel, 'f' || n AS file, 'C' || (n + 1) || '.1' AS clause, 'f' || (n + 1) AS target FROM l "
    "WHERE n + 1 <= m AND EXISTS (SELECT 1 FROM l AS x WHERE x.rel = l.rel AND x.n = l.n + 1)",
)
def j19(spark, sf):
    """Each chunk defines a clause and cites it, the next one and one that no file has."""
    n = F.col("l_linenumber")
    said = F.concat(F.lit("As C"), n, F.lit(".1 says, see C"), n + 1, F.lit(".1 and C99.9."))
    chunks = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("rel"),
        F.concat(F.lit("f"), n).alias("file"),
        F.array(F.concat(F.lit("C"), n, F.lit(".1"))).alias("defined"),
        said.alias("text"),
    )
    return structure.cross_references(chunks)


NORM = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@register("j21_line_states", X.with_("docs s", f""", st AS (SELECT rel, n, {NORM.format('line')} AS norm, CASE
WHEN n % 4 = 0 THEN 'changed' ELSE 'match' END AS status FROM s
WHERE n % 6 <> 5), st2 AS (SELECT *, row_number() OVER (PARTITION BY rel, norm ORDER BY n) AS k FROM st),
bx AS (SELECT rel, n // 5 AS page, n AS y, {NORM.format('line')} AS norm
FROM s), bx2 AS (SELECT *, row_number() OVER (PARTITION BY rel, norm ORDER BY page, y) AS k FROM bx)
SELECT bx2.rel, page, y, coalesce(status, 'unmatched') AS status FROM bx2 LEFT JOIN st2 USING (rel, norm, k)""").replace("\n, st AS", ",\nst AS"))
def j21(spark, sf):
    """Boxes of all lines; the aligned text has lost every sixth."""
    src, _ = X.conv(spark, sf)
    boxes = src.select("rel", F.floor(F.col("n") / 5).alias("page"), F.col("n").alias("y"), F.concat(F.lit("  "), "line", F.lit("\t")).alias("text"))
    states = src.where("n % 6 <> 5").select("rel", "n", F.col("line").alias("text"), F.when(F.col("n") % 4 == 0, "changed").otherwise("match").alias("status"))
    return structure.line_states(boxes, states)


KEY = "regexp_replace(lower({0}), '[^0-9a-z]', '', 'g')"


@register("j23_unmatched_headings", X.with_("docs s", f""", rw AS (SELECT rel, n // 5 + 1 AS page, n AS y,
{KEY.format('line')} AS k1 FROM s), rk AS (SELECT *, k1 || coalesce(lead(k1, 1) OVER w, '') AS k2, k1 || coalesce(lead(k1,
1) OVER w, '') || coalesce(lead(k1, 2) OVER w, '') AS k3 FROM rw WINDOW w AS (PARTITION BY rel, page ORDER BY y)),
en AS (SELECT rel, n AS seq, array_to_string(string_split(line, ' ')[1:3], ' ') AS title, n // 5 + 1 + CASE WHEN n % 3 = 0 THEN 1
WHEN n % 8 = 4 THEN 3 ELSE 0 END AS page FROM s WHERE n % 4 = 0), ek AS (SELECT *, {KEY.format('title')} AS key FROM en)
SELECT rel, seq, title, page FROM ek WHERE key = '' OR NOT EXISTS (SELECT 1 FROM rk WHERE rk.rel = ek.rel
AND rk.page BETWEEN ek.page - 1 AND ek.page + 1 AND k1 <> ''
AND (starts_with(k1, key) OR k2 = key OR k3 = key))""").replace("\n, rw AS", ",\nrw AS"))
def j23(spark, sf):
    """Every fourth line begins with a heading; some contents entries name a page too far away."""
    src, _ = X.conv(spark, sf)
    n = F.col("n")
    page = (F.floor(n / 5) + 1).cast("long")
    rows = src.select("rel", page.alias("page"), n.alias("y"), F.col("line").alias("text"))
    entries = src.where("n % 4 = 0").select(
        "rel",
        n.alias("seq"),
        F.array_join(F.slice(F.split("line", " "), 1, 3), " ").alias("title"),
        (page + F.when(n % 3 == 0, 1).when(n % 8 == 4, 3).otherwise(0)).alias("page"),
    )
    return structure.unmatched_headings(entries, rows)


@register(
    "w15_fallback_headings",
    X.with_(
        "docs s",
        ", h AS (SELECT rel, n, 'B' || (n // 9) || '.' || n AS clause, 'B' || (n // 9) AS prefix FROM s "
        "WHERE n % 3 = 0), g AS (SELECT *, CASE WHEN lag(prefix) OVER (PARTITION BY rel "
        "ORDER BY n) = prefix THEN 0 ELSE 1 END AS fresh FROM h) SELECT rel, n, clause, sum(fresh) OVER (PARTITION BY rel "
        "ORDER BY n) AS part FROM g",
    ).replace("\n, h AS", ",\nh AS"),
)
def w15(spark, sf):
    """Every third line is bold and begins with a clause id; other lines have an id without being bold, or none."""
    src, _ = X.conv(spark, sf)
    n = F.col("n")
    head = F.concat(F.lit("B"), F.floor(n / 9), F.lit("."), n, F.lit(" "))
    return structure.fallback_headings(
        src.select("rel", "n", (n % 3 == 0).alias("bold"), F.concat(F.when(n % 3 < 2, head).otherwise(""), "line").alias("text"))
    )


BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@register("w9_cumulative_lines", X.with_("docs s", rf""", p AS (SELECT rel, n AS page, CASE n % 5 WHEN 0 THEN line || chr(13)
WHEN 1 THEN line || chr(10) || 'x' WHEN 2 THEN '' WHEN 3 THEN line || chr(11) || chr(12) ELSE line END AS t
FROM s), j AS (SELECT rel, page, string_agg(t, chr(10)) OVER (PARTITION BY rel ORDER BY page) AS t FROM p)
SELECT rel, page, len(regexp_extract_all(t, '{BREAKS}')) + CASE WHEN t <> ''
AND NOT regexp_matches(t, '({BREAKS})\z') THEN 1 ELSE 0 END AS lines FROM j""").replace("\n, p AS", ",\np AS"))
def w9(spark, sf):
    src, _ = X.conv(spark, sf)
    i = F.col("n") % 5
    t = F.when(i == 0, F.concat("line", F.lit("\r"))).when(i == 1, F.concat("line", F.lit("\nx"))).when(i == 2, "").when(
        i == 3,
        F.concat("line", F.lit("\x0b\x0c")),
    ).otherwise(F.col("line"))
    return structure.cumulative_lines(src.select("rel", F.col("n").alias("page"), t.alias("text")))


def run_log(spark, sf):
    """Events of documents by source as JSON lines: two listings in parts of a thousand files, results, publications, and lines that no
    reader can use."""
    d, i = X.docs(spark, sf), F.col("doc_id")
    one = lambda kind, seq, **more: F.struct(F.lit(kind).alias("type"), seq.cast("double").alias("t"), F.col("rel"), *[v.alias(k) for k, v in more.items()])
    said = F.array(
        F.to_json(one("start", i * 10 + 2)),
        F.when(i % 3 != 0, F.to_json(one("file", i * 10 + 3, outcome=F.lit("result"), accuracy=(i % 100).cast("double")))).otherwise(F.lit('{"type": "file", "rel": ')),
        F.when(i % 4 == 0, F.to_json(one("published", i * 10 + 4))).otherwise(F.to_json(one("noise", i * 10 + 4))),
    )
    events = d.select(F.col("source").alias("room"), F.explode(said).alias("value"))
    part = F.floor(i / 1000).alias("part")
    listing = lambda cond, t: d.where(cond).groupBy(F.col("source").alias("room"), part).agg(F.to_json(F.struct(F.lit("listing").alias("type"), F.lit(t).cast("double").alias("t"), F.collect_list(F.struct("rel", F.col("n_chars").alias("size"))).alias("files"))).alias("value")).drop("part")
    return events.unionByName(listing(F.lit(True), 1)).unionByName(listing(i % 5 != 0, 1e12)).where("value IS NOT NULL")


@register(
    "s5_run_events",
    X.with_(
        "docs",
        "SELECT source AS room, type, count(*) AS n FROM (SELECT source, unnest([CASE WHEN true THEN 'start' END, "
        "CASE WHEN doc_id % 3 <> 0 THEN 'file' END, CASE WHEN doc_id % 4 = 0 THEN 'published' END]) AS type FROM docs UNION ALL "
        "SELECT DISTINCT source, unnest(['listing', 'listing']) FROM docs UNION ALL SELECT DISTINCT source, 'listing' FROM docs "
        "WHERE false) WHERE type IS NOT NULL GROUP BY ALL",
    ).replace(
        "SELECT DISTINCT source, unnest(['listing', 'listing']) FROM docs",
        "SELECT source, 'listing' FROM (SELECT DISTINCT source, doc_id // 1000 FROM docs) UNION ALL SELECT source, 'listing' "
        "FROM (SELECT DISTINCT source, doc_id // 1000 FROM docs WHERE doc_id % 5 <> 0)",
    ),
)
def s5(spark, sf):
    return structure.events(run_log(spark, sf)).groupBy("room", "type").agg(F.count(F.lit(1)).alias("n"))


FILES_OF_LOG = X.with_(
    "docs",
    "SELECT source AS room, rel, n_chars AS size, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN 'processing' END AS activity, "
    "CASE WHEN doc_id % 3 <> 0 THEN 'result' END AS outcome, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 100 AS DOUBLE) END AS "
    "accuracy, doc_id % 4 = 0 AS confirmed FROM docs WHERE doc_id % 3 <> 0 OR doc_id % 5 <> 0 OR source NOT IN (SELECT source "
    "FROM docs WHERE doc_id % 5 <> 0)",
)


@register("m5_events_to_files", FILES_OF_LOG)
def m5(spark, sf):
    log = structure.events(run_log(spark, sf)).withColumn("seq", F.col("t"))
    return structure.files_from_events(log.select("room", "seq", "type", "rel", "outcome", "accuracy", "files"))


@register("s6_latest_reports", X.with_("docs", "SELECT source AS sid, rel, 30 AS at, n_chars + 3 AS score FROM docs"))
def s6(spark, sf):
    """Three reports of each file and a broken one after them."""
    k = F.explode(F.array(F.lit(10), F.lit(30), F.lit(20), F.lit(40))).alias("at")
    d = X.docs(spark, sf).select(F.col("source").alias("sid"), "rel", "n_chars", k)
    raw = F.when(F.col("at") == 40, '{"score": ').otherwise(F.to_json(F.struct((F.col("n_chars") + F.col("at") / 10).cast("long").alias("score"))))
    return structure.latest_reports(d.select("sid", "rel", "at", raw.alias("raw")), "score long").select("sid", "rel", "at", "report.score")


@register(
    "s12_run_status",
    X.with_(
        "docs",
        ", d AS (SELECT source AS run, doc_id, row_number() OVER (PARTITION BY source "
        "ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM docs) "
        "SELECT run, CAST(max(n) AS INTEGER) * 2 AS total, max(i) AS index, 'doc ' || max(doc_id) AS file, count(*) FILTER "
        "(doc_id % 3 = 0) AS passed, count(*) FILTER (doc_id % 3 = 1) AS failed, count(*) FILTER (doc_id % 3 = 2) AS skipped, "
        "round(least(5 + 90 * (max(i) - 1 + CASE WHEN max(doc_id) % 3 = 2 THEN 0 ELSE 0.5 END + count(*) FILTER (doc_id % 3 = 2)) "
        "/ (max(n) * 2), 98.0), 1) AS percent FROM d GROUP BY run",
    ).replace("\n, d AS", ",\nd AS"),
)
def s12(spark, sf):
    """Logs of runs by source, line by line."""
    d = X.docs(spark, sf)
    order = d.select("source", "doc_id")
    size = order.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    at = size.select(F.col("source").alias("run"), "total", F.posexplode("ids").alias("i", "doc_id"))
    m = F.col("doc_id") % 3
    said = F.array_compact(
        F.array(
            F.concat(F.lit("["), F.col("i") + 1, F.lit("] doc "), F.col("doc_id")),
            F.when(m == 2, "unchanged since last run").otherwise("OCR page 1/2"),
            F.when(m == 0, "verification: PASS").when(m == 1, "verification: FAIL"),
            F.lit("something else"),
        )
    )
    body = at.select("run", F.col("i").alias("i"), F.posexplode(said).alias("k", "line")).select("run", (F.col("i") * 10 + F.col("k") + 1).alias("n"), "line")
    head = size.select(F.col("source").alias("run"), F.lit(0).alias("n"), F.concat(F.col("total") * 2, F.lit(" documents to do")).alias("line"))
    return structure.run_status(body.unionByName(head))


@register("s1_paired_files", X.with_("docs", "SELECT rel, n_chars AS size, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS md_id FROM docs"))
def s1(spark, sf):
    """A third of the files has Markdown; other copies stand in folders that are not part of the mirror."""
    d = X.docs(spark, sf)
    at = F.when(F.col("doc_id") % 3 == 0, F.concat("rel", F.lit(".md"))).when(
        F.col("doc_id") % 3 == 1,
        F.concat(F.lit("_review/"), "rel", F.lit(".md")),
    ).otherwise(F.concat("rel", F.lit(".txt")))
    return structure.paired(
        d.select("rel", F.col("n_chars").alias("size")),
        d.select(at.alias("path"), F.col("doc_id").alias("md_id")),
    ).select("rel", "size", "md_id")


@register(
    "s11_error_notes",
    X.with_(
        "docs",
        "SELECT 'r' || doc_id AS name, CASE WHEN doc_id % 9 <> 0 THEN 'What is ' || doc_id || '? And why?' ELSE '' END AS "
        "question, 'None of ' || source AS answer_given, '' AS sources_cited, 'wrong' AS user_says, 'yes' AS recheck, doc_id % 9 "
        "<> 0 AS readable FROM docs",
    ),
)
def s11(spark, sf):
    """Notes with a question over two lines; each arrives twice."""
    i = F.col("doc_id")
    note = F.concat(
        F.when(i % 9 != 0, F.concat(F.lit("question: What is "), i, F.lit("?\n  And why?\n"))).otherwise("junk\n"),
        F.lit("answer_given: None of "),
        "source",
        F.lit("\nsources_cited:\nuser_says: wrong\nrecheck: yes\n"),
    )
    return structure.error_notes(X.docs(spark, sf).select(F.concat(F.lit("r"), i).alias("name"), F.explode(F.array(note, note)).alias("text")))


@register(
    "s13_written_tree",
    X.with_(
        "docs",
        "SELECT rel, CASE WHEN doc_id % 4 = 0 THEN '_pending' ELSE 'trusted' END AS status, "
        "CASE WHEN n_chars <= 2000 THEN 'file' ELSE 'folder' END AS layout, md5(text) AS text_hash FROM docs",
    ),
)
def s13(spark, sf):
    """Results as a tree of files, read again by its folders."""
    folder = new_folder(spark, "trees")
    d = X.docs(spark, sf).select(
        "rel",
        "text",
        F.when(F.col("doc_id") % 4 == 0, "_pending").otherwise("trusted").alias("status"),
        structure.layout(F.col("n_chars"), 2000).alias("layout"),
    )
    d.write.partitionBy("status", "layout").parquet(folder)
    return spark.read.parquet(folder).select("rel", "status", "layout", F.md5("text").alias("text_hash"))


@register(
    "s7_state_table",
    X.with_(
        "docs",
        "SELECT rel, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS size, "
        "CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM docs",
    ),
)
def s7(spark, sf):
    """A state table: two versions are appended, the latest row of each key is read."""
    from ..operators.state import latest

    d = X.docs(spark, sf)
    first = written(d.select("rel", F.col("n_chars").alias("size"), F.lit(1).alias("version")))
    second = written(d.where("doc_id % 3 = 0").select("rel", (F.col("n_chars") + 1).alias("size"), F.lit(2).alias("version")))
    return latest(first.unionByName(second), ["rel"], [F.col("version")]).select("rel", "size", "version")


@register(
    "m8_accept_plan",
    X.with_(
        "docs",
        "SELECT rel, CASE doc_id % 8 WHEN 0 THEN 'no such file' WHEN 1 THEN 'publish' WHEN 2 THEN "
        "CASE WHEN doc_id % 3 = 0 THEN 'forced' ELSE 'below threshold' END WHEN 3 THEN 'already sent' WHEN 4 THEN 'no result' "
        "WHEN 5 THEN 'result missing' ELSE 'publish' END AS decision FROM docs",
    ),
)
def m8(spark, sf):
    d, i = X.docs(spark, sf), F.col("doc_id") % 8
    state = F.when(i == 2, "below").when(i == 3, "published").when(i == 4, "pending").otherwise("ok")
    files = d.where(i != 0).select(
        "rel",
        state.alias("state"),
        F.when(i != 5, F.concat(F.lit("out/"), "rel")).alias("out_dir"),
        F.md5("text").alias("content_hash"),
    )
    return structure.accept_plan(files, d.select("rel", F.explode(F.array(F.lit(False), F.col("doc_id") % 3 == 0)).alias("force")))


def stream(spark, sf):
    return jobs.follow(spark, f"{sf}/events.parquet", X.table(spark, sf, "events").schema).withColumn("ts", F.to_timestamp("ts"))


@register("t2_stream_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def t2(spark, sf):
    return jobs.latest_state(stream(spark, sf).select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@register(
    "t4_stream_stale_runs",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id "
    "ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), e AS (SELECT user_id, k, max(ts) AS last_beat, count(*) AS beats FROM s "
    "GROUP BY ALL) SELECT user_id AS run, beats, epoch_us(last_beat) AS last_us FROM e "
    "WHERE last_beat + INTERVAL 10 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def t4(spark, sf):
    """Sessions that the watermark has closed: beats ten minutes apart or more begin a new one."""
    beats = stream(spark, sf).select(F.col("user_id").alias("run"), "ts")
    return jobs.drained(jobs.stale(beats), "append").select("run", "beats", F.unix_micros("last_beat").alias("last_us"))


@register(
    "t5_stream_bursts",
    "WITH f AS (SELECT user_id AS address, epoch_us(ts) AS t FROM events "
    "WHERE event_type = 'error'), w AS (SELECT address, (t // 60000000 - k) * 60 AS start_s "
    "FROM f, range(5) AS r(k)), c AS (SELECT address, start_s, count(*) AS n FROM w GROUP BY ALL) SELECT address, start_s, n "
    "FROM c WHERE n >= 2 AND (start_s + 300) * 1000000 <= (SELECT max(t) FROM f) - 600000000",
)
def t5(spark, sf):
    rows = stream(spark, sf).where("event_type = 'error'").select(F.col("user_id").alias("address"), F.lit("login_failed").alias("type"), "ts")
    return jobs.drained(jobs.bursts(rows, 2), "append").select("address", F.unix_seconds("w.start").alias("start_s"), "n")


@register("t7_stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def t7(spark, sf):
    return jobs.drained(
        jobs.distinct(stream(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts"),
        "append",
    ).select("user_id", "event_type")


@register("t8_stream_corrected", X.with_("docs", f", {rule_queries.CORRECTED} SELECT rel, md5(text) AS text_hash FROM corrected").replace("\n, r1", ",\nr1"))
def t8(spark, sf):
    """New results meet the rules as they arrive."""
    found = jobs.follow(spark, f"{sf}/documents.parquet", X.table(spark, sf, "documents").schema)
    i = F.col("doc_id")
    rel = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), i, F.lit(".pdf")))
    head = F.concat(
        F.lit("---\ndocument: "),
        "source",
        F.lit("\nstd_id: AS "),
        (3500 + i % 7).cast("string"),
        F.lit("\nstd_year: "),
        (2000 + i % 12).cast("string"),
        F.lit("\nstatus: "),
        F.when(i % 9 == 0, "draft").otherwise("current"),
        F.lit("\nflags: "),
        F.when(i % 4 == 0, "ocr, protected").when(i % 4 == 1, "ocr").otherwise(""),
        F.lit("\n---\n"),
        "text",
        F.lit("\nbore l50 mm, bore l50 kg, not l50 mm"),
    )
    results = found.select(rel.alias("rel"), "doc_id", F.col("source").alias("series"), names.file_name(rel).alias("doc"), head.alias("text"))

    def apply(df):
        return rules.apply_rules(
            df,
            rule_queries.book(spark),
            "text",
            df.where("doc_id % 4 = 0").select("rel", F.lit(1).alias("num")),
        ).select("rel", F.md5("text").alias("text_hash"))

    return jobs.corrected(results, apply, new_folder(spark, "streams")).select("rel", "text_hash")


@register("t1_followed_logs", FILES_OF_LOG)
def t1(spark, sf):
    """Logs that grow between two polls, each by a driver of its own: the table is that of the whole log."""
    folder = new_folder(spark, "followed")
    rows = run_log(spark, sf)
    for wave in (0, 1):
        rows.where(F.pmod(F.xxhash64("value"), F.lit(2)) == wave).write.mode("append").partitionBy("room").text(f"{folder}/logs")
        logs.Follower(spark, f"{folder}/logs", f"{folder}/state", room=r"room=([^/]+)/").poll()
    return logs.Follower(spark, f"{folder}/logs", f"{folder}/state").files()

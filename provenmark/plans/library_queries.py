"""Queries over pages, tables, rules, readings and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import readings, rules, verify
from ..sources import html
from ..streaming import jobs
from . import fixtures as X
from .registry import register


@register("s8_html_to_markdown", f"SELECT page_id, {html.markdown_sql('html')} AS body FROM pages")
def s8(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", html.to_markdown("html").alias("body"))


@register("s9_raw_html_text", f"SELECT page_id, md5({html.raw_sql('html')}) AS text_hash FROM pages")
def s9(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.md5(html.raw_text("html")).alias("text_hash"))


CELLS = """src AS (SELECT p_partkey // 20 AS t, p_partkey % 20 AS r, 0 AS c, p_name AS v FROM part UNION ALL
SELECT p_partkey // 20, p_partkey % 20, 1, p_brand FROM part),
md AS (SELECT p_partkey // 20 AS t, p_partkey % 20 AS r, CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS c, p_name AS v FROM part
UNION ALL SELECT p_partkey // 20, p_partkey % 20, CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE 1 END, p_brand FROM part)"""


@register(
    "j22_table_cells",
    f"WITH {CELLS} SELECT coalesce(src.t, md.t) AS t, count(*) AS cells, count(*) FILTER (regexp_replace(lower(coalesce(src.v, "
    f"'')), '[^0-9a-z]', '', 'g') <> regexp_replace(lower(coalesce(md.v, '')), '[^0-9a-z]', '', 'g')) AS mismatches FROM src FULL "
    f"JOIN md ON src.t = md.t AND src.r = md.r AND src.c = md.c GROUP BY 1",
)
def j22(spark, sf):
    p = X.table(spark, sf, "part").withColumns({"t": F.floor(F.col("p_partkey") / 20), "r": F.col("p_partkey") % 20})
    cells = lambda swap: p.select("t", "r", F.posexplode(F.when(swap & (F.col("p_partkey") % 97 == 0), F.array("p_brand", "p_name")).otherwise(F.array("p_name", "p_brand"))).alias("c", "v"))
    return verify.cell_check(cells(F.lit(False)), cells(F.lit(True)), ["t"])


@register(
    "a15_running_headers",
    X.with_(
        "docs s",
        r""", k AS (SELECT split_part(rel, '/', 1) AS doc, doc_id AS page, n AS y, regexp_replace(lower(trim(line)), '\d', '#',
'g') AS key FROM s) SELECT doc, key, count(DISTINCT page) AS pages FROM k WHERE y <= 1
AND length(regexp_replace(key, '[^a-z]', '', 'g')) >= 3 GROUP BY doc, key HAVING count(DISTINCT page) >= 4""",
    ).replace("\n, k AS", ",\nk AS"),
)
def a15(spark, sf):
    src, _ = X.conv(spark, sf)
    lines = src.select(F.split("rel", "/")[0].alias("doc"), F.col("rel").alias("page"), F.col("n").alias("y"), F.col("line").alias("text"))
    return verify.running_lines(lines.where("y <= 1"), 4)


@register(
    "a16_without_headers",
    X.with_(
        "docs s",
        r""", k AS (SELECT rel, split_part(rel, '/', 1) AS doc, doc_id AS page, n AS y, regexp_replace(lower(trim(line)), '\d', '#',
'g') AS key FROM s), hf AS (SELECT doc, key FROM k WHERE y <= 1 AND length(regexp_replace(key, '[^a-z]', '', 'g')) >= 3
GROUP BY doc, key HAVING count(DISTINCT page) >= 4) SELECT rel AS page, y FROM k WHERE NOT (y <= 1 AND EXISTS (SELECT 1 FROM hf
WHERE hf.doc = k.doc AND hf.key = k.key))""",
    ).replace("\n, k AS", ",\nk AS"),
)
def a16(spark, sf):
    src, _ = X.conv(spark, sf)
    lines = src.select(F.split("rel", "/")[0].alias("doc"), F.col("rel").alias("page"), F.col("n").alias("y"), F.col("line").alias("text"))
    bands = verify.running_lines(lines.where("y <= 1"), 4).select("doc", "key")
    keyed = lines.withColumn("key", verify.band_key("text"))
    gone = keyed.where("y <= 1").join(bands, ["doc", "key"], "left_semi").select("page", "y")
    return lines.join(gone, ["page", "y"], "left_anti").select("page", "y")


@register("a2_page_recall", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t
FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT doc_id, n, n - n // 7 AS m FROM c)
SELECT doc_id // 10 AS doc, count(DISTINCT doc_id) AS pages, round(sum(m) / sum(n), 9) AS recall FROM k GROUP BY 1""")
def a2(spark, sf):
    d = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page"),
        F.explode(text.word_tokens("text")).alias("t"),
    ).groupBy("page", "t").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("m", F.col("n") - F.floor(F.col("n") / 7))
    return d.groupBy(F.floor(F.col("page") / 10).alias("doc")).agg(F.count_distinct("page").alias("pages"), F.round(F.sum("m") / F.sum("n"), 9).alias("recall"))


@register(
    "w10_sampled_pages",
    X.with_(
        "docs",
        ", r AS (SELECT source, rel, row_number() OVER (PARTITION BY source "
        "ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM docs) SELECT source, rel FROM r "
        "WHERE i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) < 5",
    ).replace("\n, r AS", ",\nr AS"),
)
def w10(spark, sf):
    return verify.even_sample(X.docs(spark, sf).select("source", "rel", "doc_id"), "source", "doc_id", 5).select("source", "rel")


@register(
    "a21_engine_summary",
    X.with_(
        "docs",
        ", r AS (SELECT doc_id, 0.85 + (doc_id % 15) / 100.0 AS conf, n_chars FROM docs) "
        "SELECT doc_id % 4 AS engine, round(avg(conf), 9) AS mean_conf, min(conf) AS worst, round(sum(conf * n_chars) / "
        "sum(n_chars), 9) AS weighted FROM r GROUP BY 1",
    ).replace("\n, r AS", ",\nr AS"),
)
def a21(spark, sf):
    r = X.docs(spark, sf).select((F.col("doc_id") % 4).alias("engine"), (F.lit(0.85) + (F.col("doc_id") % 15) / 100.0).alias("conf"), "n_chars")
    return readings.engine_summary(r, "engine", "conf", "n_chars")


@register(
    "j15_rule_places",
    r"SELECT source || '/' || lang || '/doc_' || doc_id || '.pdf' AS rel, len(string_split(text, 'with')) - 1 AS places "
    r"FROM documents WHERE contains(text, 'with')",
)
def j15(spark, sf):
    return rules.places(X.docs(spark, sf), "text", F.lit("with")).select("rel", "places")


@register(
    "a22_page_scope",
    X.with_(
        "docs s",
        "SELECT rel, n // 10 AS page, count(*) AS lines, count(*) FILTER (trim(line) = '') AS empty FROM s GROUP BY rel, n // 10",
    ),
)
def a22(spark, sf):
    src, _ = X.conv(spark, sf)
    return src.groupBy("rel", F.floor(F.col("n") / 10).alias("page")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.trim("line") == "").alias("empty"))


@register("w12_packing", None)
def w12(spark, sf):
    src, _ = X.conv(spark, sf)
    units = src.groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("n", F.length("line").alias("size")))).alias("units"))
    return units.select("rel", verify.pack(F.col("units"), 1000).alias("parts"))


@register("p23_clause_ids", r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Z]?\d+(?:\.\d+)+\b')) AS clauses FROM documents")
def p23(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.size(names.clause_ids(F.col("text"))).cast("long").alias("clauses"))


@register("t3_stream_run_progress", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def t3(spark, sf):
    return jobs.drained(jobs.progress(jobs.follow(spark, f"{sf}/events.parquet", X.table(spark, sf, "events").schema)), "complete")


@register("t6_stream_month_totals", "SELECT strftime(ts, '%Y-%m') AS month, user_id % 4 AS skill, count(*) AS calls FROM events GROUP BY ALL")
def t6(spark, sf):
    rows = jobs.follow(spark, f"{sf}/events.parquet", X.table(spark, sf, "events").schema)
    return jobs.drained(
        rows.groupBy(
            F.date_format("ts", "yyyy-MM").alias("month"),
            (F.col("user_id") % 4).alias("skill"),
        ).agg(F.count(F.lit(1)).alias("calls")),
        "complete",
    )

"""Queries over names, unit markers, tables, front matter, formulas and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import names, score, text
from . import fixtures as X
from .registry import register

Q = chr(39)


@register("p10_clean_text", "SELECT doc_id, md5(text) AS text_hash, contains(text, 'fi') AS ligature FROM documents")
def p10(spark, sf):
    """Ligatures and odd spaces, put into the text first, are letters and blanks again."""
    odd = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit(" of "), F.lit(" of "))
    d = X.table(spark, sf, "documents").withColumn("odd", odd)
    return d.select("doc_id", F.md5(text.clean_text("odd")).alias("text_hash"), F.contains("odd", F.lit("ﬁ")).alias("ligature"))


@register(
    "p13_series",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AS ' || (3500 + p_size) WHEN 1 THEN 'AS ' || (3500 + p_size) || '.1' WHEN "
    "2 THEN 'ISO ' || (9000 + p_size) WHEN 3 THEN 'NCC' END AS series, lower(p_name) || '.pdf' AS doc FROM part",
)
def p13(spark, sf):
    """Standards in file names and folders; AS/NZS is AS, codes have no number."""
    size = F.col("p_size").cast("int")
    i = F.col("p_partkey") % 5
    folder = F.when(i == 0, F.concat(F.lit("/lib/AS_NZS "), (size + 3500).cast("string"))).when(
        i == 1,
        F.concat(F.lit("/x/as-"), (size + 3500).cast("string"), F.lit(".1-2003")),
    ).when(i == 2, F.concat(F.lit("/2019/ISO"), (size + 9000).cast("string"))).when(i == 3, "/codes/NCC 2022").otherwise("/misc")
    p = X.table(spark, sf, "part").withColumn("rel", F.concat(folder, F.lit("/"), F.upper("p_name"), F.lit(".PDF")))
    return p.select("p_partkey", names.series_of(F.col("rel")).alias("series"), names.doc_key(F.col("rel")).alias("doc"))


@register(
    "p32_route",
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'unknown' WHEN 3 THEN 'cad' "
    "WHEN 4 THEN 'office' ELSE 'unknown' END AS kind, CASE p_partkey % 6 WHEN 1 THEN 'RVT is a closed format without a reader' "
    "WHEN 2 THEN 'no reader for extension foo' WHEN 5 THEN 'no reader for extension (none)' END AS reason FROM part",
)
def p32(spark, sf):
    ends = F.element_at(F.array(*map(F.lit, (".PDF", ".rvt", ".foo", ".dwg", ".Docx", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = X.table(spark, sf, "part").withColumn("rel", F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit("."), F.lit("_")), ends))
    return p.select("p_partkey", names.route(F.col("rel")).alias("kind"), names.route_reason(F.col("rel")).alias("reason"))


@register(
    "p15_title_block",
    "SELECT p_partkey, 'A-' || p_partkey AS drawing_number, 'B' || (p_partkey % 10) AS revision, '1:' || p_size AS scale, "
    "'2024-0' || (1 + p_partkey % 9) || '-11' AS date, p_brand AS project, p_name AS title FROM part",
)
def p15(spark, sf):
    k = F.col("p_partkey")
    lines = F.concat(
        F.lit("DRAWING No: A-"), k, F.lit("\nRev. B"), k % 10, F.lit("\nscale 1:"), F.col("p_size"), F.lit("\nDate: 2024-0"),
        k % 9 + 1, F.lit("-11\nProject name: "), F.col("p_brand"), F.lit("\nDrawing title - "), F.col("p_name"), F.lit("\nSheet 2"),
    )
    return X.table(spark, sf, "part").select("p_partkey", names.title_block(lines).alias("t")).select("p_partkey", "t.*")


@register("p17_grounding_form", rf"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS form FROM benchmark")
def p17(spark, sf):
    """Items with emphasis, dashes and wide forms put in come back as they were."""
    odd = F.concat(F.lit("**"), F.regexp_replace(F.replace("text", F.lit(" the "), F.lit(" *the*　")), "-", "–"), F.lit("**"))
    return X.table(spark, sf, "benchmark").select("item_id", M.grounding(odd).alias("form"))


@register(
    "p20_size_verdict",
    X.with_(
        "docs s m pairs",
        "SELECT rel, CASE WHEN length(src_text) < 60 THEN 'source has almost no text' WHEN length(md_text) / length(src_text) < "
        "0.2 THEN 'most content missing' WHEN length(md_text) / length(src_text) > 1.8 AND dup THEN 'content repeated' WHEN "
        "length(md_text) / length(src_text) > 1.8 THEN 'content added' ELSE 'sizes agree' END AS verdict "
        "FROM (SELECT *, contains(md_text, chr(10)) AS dup FROM pairs)",
    ),
)
def p20(spark, sf):
    p = X.pairs(spark, sf)
    return p.select("rel", score.size_verdict(F.length("src_text"), F.length("md_text"), F.contains("md_text", F.lit("\n")).cast("int")).alias("verdict"))


@register(
    "p24_path_functions",
    X.with_(
        "docs",
        "SELECT rel, source || '/' || lang || '/doc_' || doc_id || '.pdf' AS live, 'doc ' || doc_id AS title, source || '_' || "
        "lang || '_doc_' || doc_id || '.pdf' AS safe, source = 'src1' AS under FROM docs",
    ),
)
def p24(spark, sf):
    rel = F.col("rel")
    return X.docs(spark, sf).select(
        "rel",
        names.live_key(F.concat(F.lit("/_pending/"), F.replace(rel, F.lit("/"), F.lit("\\")), F.lit("/"))).alias("live"),
        names.readable_title(rel).alias("title"),
        names.safe_name(F.replace(rel, F.lit("/"), F.lit(":"))).alias("safe"),
        names.is_under(rel, F.lit("src1")).alias("under"),
    )


@register("p44_question_key", "SELECT event_id, sha256(concat_ws(chr(31), '1', event_type, 'm' || (user_id % 3), props)) AS key FROM events")
def p44(spark, sf):
    return X.table(spark, sf, "events").select(
        "event_id",
        score.question_key(F.lit("1"), F.col("event_type"), F.concat(F.lit("m"), F.col("user_id") % 3), F.col("props")).alias("key"),
    )


HEAD = "'---' || chr(10) || 'document: ' || source || chr(10) || 'std_id: AS ' || (3500 + doc_id % 7) || chr(10) || 'std_year: ' || (2000 + doc_id % 12) || chr(10) || 'status: ' || CASE WHEN doc_id % 9 = 0 THEN 'draft' ELSE 'current' END || chr(10) || 'flags: ' || CASE doc_id % 4 WHEN 0 THEN 'ocr, protected' WHEN 1 THEN 'ocr' ELSE '' END"


@register(
    "p22_accepted_front_matter",
    X.with_(
        "docs",
        f"""SELECT rel, md5({HEAD} || chr(10) || 'accuracy: ' || CASE
WHEN doc_id % 3 = 0 THEN 'null' ELSE CAST(doc_id % 100 AS VARCHAR) END || chr(10) || 'accepted_by: "r ' || chr(92) || chr(34) || (doc_id % 5) || chr(92) || chr(34) || '"' || chr(10) || 'accepted_at: "2024-05-01"' || chr(10) || '---' || chr(10) || text) AS text_hash,
md5({HEAD} || chr(10) || '---' || chr(10) || text) AS compared FROM docs""",
    ),
)
def p22(spark, sf):
    """Accepted, and with the acceptance dropped again for comparing."""
    i = F.col("doc_id")
    who = F.concat(F.lit('r "'), i % 5, F.lit('"'))
    d = X.library(spark, sf).withColumn("accepted", M.accepted(F.col("md_raw"), who, F.lit("2024-05-01"), F.when(i % 3 != 0, i % 100), i % 2 == 0))
    return d.select("rel", F.md5("accepted").alias("text_hash"), F.md5(M.without_acceptance(F.col("accepted"))).alias("compared"))


@register(
    "p47_reconverted",
    X.with_(
        "docs",
        f"""SELECT rel, md5({HEAD.replace("|| chr(10) || 'flags: ' || CASE doc_id % 4 WHEN 0 THEN 'ocr, protected' WHEN 1 THEN 'ocr' ELSE '' END", '')} || chr(10) || 'parser: text' || chr(10) || 'flags: []' || chr(10) || 'audit_status: pending_review' || chr(10) || 'risk_score: 0' || chr(10) || 'reconvert_engine: text' || chr(10) || '---' || chr(10) || chr(10) || '# ' || rel || chr(10) || chr(10) || array_to_string(list_transform(list_filter(string_split(text,
chr(10)), lambda x: trim(x) <> '')[1:5000], lambda x: '- ' || x), chr(10)) || chr(10)) AS text_hash FROM docs""",
    ),
)
def p47(spark, sf):
    d = X.library(spark, sf)
    return d.select("rel", F.md5(M.reconverted(names.body_of(F.col("md_raw")), F.lit("text"), F.col("rel"), F.col("md_raw"))).alias("text_hash"))


@register("p36_table_markdown", """WITH r AS (SELECT p_partkey // 20 AS t, p_partkey AS k, '| ' || replace(p_name, ' ',
chr(92) || '|') || ' | ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' | ' ELSE ' | ' || p_size END || ' |' AS line FROM part)
SELECT t, arg_min(line, k) || chr(10) || '|---|---|---|' || coalesce(chr(10) || string_agg(CASE WHEN k > m THEN line END, chr(10)
ORDER BY k), '') AS md FROM (SELECT *, min(k) OVER (PARTITION BY t) AS m FROM r) GROUP BY t""")
def p36(spark, sf):
    """Grids of parts: bars in cells are escaped, short rows padded, empty rows dropped."""
    p = X.table(spark, sf, "part").withColumn("name", F.replace("p_name", F.lit(" "), F.lit("|")))
    cells = F.when(F.col("p_partkey") % 3 == 0, F.array("name", "p_brand")).otherwise(F.array("name", "p_brand", F.col("p_size").cast("string")))
    rows = p.select(
        F.floor(F.col("p_partkey") / 20).alias("t"),
        F.col("p_partkey").alias("k"),
        F.explode(F.array(cells, F.array(F.lit(" "), F.lit(None).cast("string")))).alias("cells"),
    )
    grid = rows.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("k", "cells"))).alias("rows"))
    # a table whose rows are all short has two columns: width comes from the table
    wide = F.transform("rows", lambda r: r["cells"])
    return grid.where(F.exists(wide, lambda r: F.size(r) == 3)).select("t", M.table(wide).alias("md"))


LINES = "string_split(text, chr(10))"
MARK = M.UNREADABLE


@register(
    "p40_unit_markers",
    X.with_(
        "docs s",
        f"SELECT rel, n + 1 AS page, '<!-- unit: p' || lpad(CAST(n + 1 AS VARCHAR), 4, '0') || ' | src: p.' || (n + 1) || "
        f"CASE WHEN n % 3 = 0 THEN ' | printed: ' || n ELSE '' END || ' | chars: ' || length(body) || ' | flags: ' || "
        f"CASE WHEN n % 4 = 1 THEN 'unreadable_formula' ELSE '-' END || ' -->' || chr(10) || chr(10) || body || chr(10) || "
        f"chr(10) || '<!-- /unit -->' AS unit FROM (SELECT rel, n, "
        f"CASE WHEN n % 4 = 1 THEN line || ' {MARK}' ELSE line END AS body FROM s) WHERE n < 9999",
    ),
)
def p40(spark, sf):
    src, _ = X.conv(spark, sf)
    n = F.col("n")
    body = F.when(n % 4 == 1, F.concat("line", F.lit(" " + MARK))).otherwise(F.col("line"))
    return src.where("n < 9999").select("rel", (n + 1).alias("page"), M.unit(n + 1, body, F.when(n % 3 == 0, n.cast("string"))).alias("unit"))


@register(
    "p38_formula_approvals",
    X.with_(
        "docs",
        f"SELECT rel, md5(coalesce(left(l, length(l) - 1), '')) AS text_hash "
        f"FROM (SELECT rel, string_agg(CASE WHEN i % 2 = 0 THEN x || '$$k' || i || '$$ ' ELSE x || '{MARK} ' END, '' "
        f"ORDER BY i) AS l FROM (SELECT rel, unnest({LINES}) AS x, generate_subscripts({LINES}, 1) AS i FROM docs) GROUP BY rel)",
    ),
)
def p38(spark, sf):
    """Each line ends in a mark; every second one has an approved formula."""
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit(MARK))), " ")
    approved = F.transform(lines, lambda x, i: F.when((i + 1) % 2 == 0, F.concat(F.lit("k"), i + 1)))
    return X.docs(spark, sf).select("rel", F.md5(M.with_formulas(body, approved)).alias("text_hash"))


@register(
    "p39_figure_notices",
    X.with_(
        "docs",
        f"SELECT rel, md5(CASE WHEN doc_id % 3 = 0 THEN rtrim(text) || chr(10) || chr(10) || '{M.FIGURE_NOTICE}' ELSE text END) "
        f"AS text_hash FROM docs",
    ),
)
def p39(spark, sf):
    """Added to the pages that have a figure, and only once."""
    once = M.with_figure_notice(F.col("text"), F.col("doc_id") % 3 == 0)
    return X.docs(spark, sf).withColumn("once", once).select("rel", F.md5(M.with_figure_notice(F.col("once"), F.col("doc_id") % 3 == 0)).alias("text_hash"))


@register("p49_formula_agreement", "SELECT p_partkey, p_partkey % 7 <> 0 AS agreed, count(*) AS readings FROM part, range(2) GROUP BY 1, 2")
def p49(spark, sf):
    """Two engines read one formula; spacing commands do not count, a digit does."""
    k = F.col("p_partkey")
    one = F.concat(F.lit(r"Q = "), k, F.lit(r"\, n"))
    two = F.concat(F.lit(r"Q\;="), F.when(k % 7 == 0, k + 1).otherwise(k), F.lit(" n"))
    readings = X.table(spark, sf, "part").select("p_partkey", F.explode(F.array(one, two)).alias("latex"))
    grouped = readings.groupBy("p_partkey").agg(F.count_distinct(M.formula_form(F.col("latex"))).alias("forms"), F.count(F.lit(1)).alias("readings"))
    return grouped.select("p_partkey", ((F.col("forms") == 1) & (F.col("readings") >= 2)).alias("agreed"), "readings")


@register(
    "p43_may_be_sent",
    X.with_(
        "docs",
        r"SELECT rel, CASE WHEN source NOT IN ('src1', 'src2') AND NOT starts_with(source, 'src1/') THEN 'folder' WHEN "
        r"contains(lower(text), 'licensed to') OR contains(lower(text), 'licenced to') OR doc_id % 6 = 0 THEN 'licence' WHEN "
        r"regexp_matches(text, '(?i)ignore (all )?(the )?(previous|above) instructions|you are an? (ai|assistant)|as an ai') THEN "
        r"'instruction' END AS refused FROM docs",
    ),
)
def p43(spark, sf):
    body = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("\nLicensed To the reader"))).otherwise(F.col("text"))
    return X.docs(spark, sf).select("rel", M.may_be_sent(F.concat(F.upper("source"), F.lit("/")), body, ["src1", "src2"]).alias("refused"))


@register(
    "p42_checked_answers",
    "SELECT event_id, CASE WHEN user_id % 5 < 2 THEN CASE user_id % 5 WHEN 0 THEN 'aft' ELSE CAST(user_id AS VARCHAR) END END AS "
    "picked, CASE WHEN user_id % 5 < 4 THEN round(CASE WHEN floor(value) / 100 > 1 THEN 1.0 ELSE floor(value) / 100 END, 2) END "
    "AS confidence, CASE WHEN user_id % 5 < 4 THEN true END AS needs_human, user_id % 5 < 4 AS valid FROM events",
)
def p42(spark, sf):
    """Answers outside the candidates and broken JSON are refused; confidence is clamped; candidates with digits need a person."""
    u = F.col("user_id") % 5
    choice = F.when(u == 0, 0).when(u == 1, 1).when(u == 4, 7).otherwise(-1)
    raw = F.concat(F.lit('{"choice": '), choice, F.lit(', "confidence": '), F.floor("value") / 100, F.lit(', "needs_human": false}'))
    d = X.table(spark, sf, "events").withColumn("answer", M.checked_answer(raw, F.array(F.lit("aft"), F.col("user_id").cast("string"))))
    return d.select("event_id", F.col("answer.text").alias("picked"), "answer.confidence", "answer.needs_human", F.col("answer").isNotNull().alias("valid"))

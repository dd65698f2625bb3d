"""Queries over lines by their place, outlines, trees of files, bytes and located matches. All lines of all documents are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import located
from ..operators import layout, outline, published
from ..sources import files
from ..sources.tables import new_folder, written
from . import fixtures as X
from .registry import register


def rows(spark, sf):
    src, _ = X.conv(spark, sf)
    return src.join(X.docs(spark, sf).select("rel", "doc_id", "source"), "rel")


def sql(parts: str, names: str = "docs s") -> str:
    return X.with_(names, ", " + parts.strip())


def page_lines(spark, sf):
    """Pages of 1,000 units: a header whose height wavers by one unit, the head of a table on even pages, the lines, and a page number in
    one of four kinds."""
    d = X.docs(spark, sf).select("source", "doc_id")
    i = F.col("doc_id")
    row = lambda n, y, text: F.struct(F.lit(n).cast("long").alias("n"), y.cast("double").alias("y0"), text.alias("text"))
    number = F.when(i % 4 == 0, i.cast("string")).when(
        i % 4 == 1,
        F.concat(F.lit("Page "), i),
    ).when(i % 4 == 2, F.lit("xiv")).otherwise(
        F.concat(F.lit("of "), "source", F.lit(" "), i, F.lit(" end"))
    )
    edge = F.array(row(-5, 30.4 + i % 3, F.concat(F.lit("Std  "), "source", F.lit(" Page "), i)), row(10**6, F.lit(960.0) + i % 2, number))
    head = F.when(
        i % 2 == 0,
        F.array(*[row(-4 + k, F.lit(50.2 + k / 4), F.lit(f"Column {x}")) for k, x in enumerate("ABC")])
    ).otherwise(F.array().cast("array<struct<n:bigint,y0:double,text:string>>"))
    edges = d.select(F.col("source").alias("doc"), i.alias("page"), F.explode(F.concat(edge, head)).alias("x")).select("doc", "page", "x.*")
    body = rows(spark, sf).select(
        F.col("source").alias("doc"),
        i.alias("page"),
        F.col("n").cast("long").alias("n"),
        (F.lit(100.0) + F.col("n") % 100 * 8).alias("y0"),
        F.col("line").alias("text"),
    )
    return edges.unionByName(body).select("doc", "page", "n", "y0", (F.col("y0") + 7).alias("y1"), F.lit(1000.0).alias("height"), "text")


PAGE_LINES = r"""
pl AS (SELECT source AS doc, doc_id AS page, -5 AS n, 30.4 + doc_id % 3 AS y0, 'Std  ' || source || ' Page ' || doc_id AS text FROM docs
  UNION ALL SELECT source, doc_id, 1000000, 960.0 + doc_id % 2, CASE doc_id % 4 WHEN 0 THEN '' || doc_id
WHEN 1 THEN 'Page ' || doc_id WHEN 2 THEN 'xiv' ELSE 'of ' || source || ' ' || doc_id || ' end' END FROM docs
  UNION ALL SELECT source, doc_id, -4 + k, 50.2 + k / 4.0, 'Column ' || substr('ABC', k::INT + 1, 1) FROM docs, range(3) r(k) WHERE doc_id % 2 = 0
  UNION ALL SELECT source, s.doc_id, n, 100 + n % 100 * 8, line FROM s JOIN docs USING (rel)),
kl AS (SELECT *, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '\d+', '#', 'g') AS key, round(y0)::INT AS y,
y0 + 7 > 930 AS bottom, y0 < 70 OR y0 + 7 > 930 AS banded FROM pl),
fr AS (SELECT a.doc, a.page, a.n, count(*) AS c FROM kl a JOIN kl b ON a.doc = b.doc AND a.page = b.page AND b.y BETWEEN a.y - 1
AND a.y + 1 AND b.banded WHERE a.banded GROUP BY ALL),
hf AS (SELECT doc, key, y, count(DISTINCT page) AS pages FROM kl JOIN fr USING (doc, page, n) WHERE c < 3
AND length(regexp_replace(key, '[^\p{L}]', '', 'g')) >= 3 GROUP BY ALL HAVING count(DISTINCT page) >= 4)
"""


@register("a15_headers_by_position", sql(PAGE_LINES + "SELECT * FROM hf"))
def a15(spark, sf):
    return layout.running_lines(page_lines(spark, sf))


@register("a16_body_and_labels", sql(PAGE_LINES + r""", told AS (SELECT *, banded AND EXISTS (SELECT 1 FROM hf WHERE hf.doc = kl.doc
AND hf.key = kl.key AND hf.y BETWEEN kl.y - 1 AND kl.y + 1) AS runs, bottom AND trim(text) = '' || page AS bare FROM kl)
SELECT doc, page, max(CASE WHEN bottom AND runs THEN nullif(regexp_extract(trim(text),
'(?i)^(?:page\s+)?((?:\d+|[ivxlcdm]+)(?:-\d+)?)$', 1), '')
WHEN bare THEN trim(text) END) AS label, count(*) FILTER (NOT (runs OR bare)) AS lines FROM told GROUP BY ALL"""))
def a16(spark, sf):
    return layout.page_labels(layout.body_and_labels(page_lines(spark, sf)))


def outline_items(spark, sf):
    """Lines as rows of an outline: headings of three levels, and places where a part begins without one. Odd documents begin without a heading."""
    n, i = F.col("n"), F.col("doc_id")
    level = F.when(n % 20 == F.when(i % 2 == 1, 3).otherwise(0), 1).when(n % 5 == 2, 2).when(n % 5 == 4, 3)
    kept = rows(spark, sf).select(F.col("rel").alias("doc"), "source", i, n, level.alias("level"), "line")
    return kept.select(
        "doc",
        "source",
        "doc_id",
        "n",
        "level",
        F.when(F.col("level").isNotNull(), F.concat(F.lit("H"), F.col("level"), F.lit(" / "), n)).alias("title"),
        F.when(F.col("level").isNull() & (n % 17 == 16), F.concat(F.lit("Part "), n)).alias("part_break"),
        F.floor(n / 5).alias("page"),
        F.length("line").alias("size"),
        "line",
    )


ITEMS = """
it AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'H' || level || ' / ' || n END AS title, CASE WHEN level IS NULL
AND n % 17 = 16 THEN 'Part ' || n END AS part_break FROM (SELECT rel AS doc, doc_id, n, line, CASE WHEN n % 20 = CASE
WHEN doc_id % 2 = 1 THEN 3 ELSE 0 END THEN 1 WHEN n % 5 = 2 THEN 2 WHEN n % 5 = 4 THEN 3 END AS level FROM s)),
op AS (SELECT *, coalesce(level <= 2, false) OR part_break IS NOT NULL AS opens FROM it),
se AS (SELECT *, sum(opens::INT) OVER w + CASE WHEN first_value(opens) OVER w THEN 0 ELSE 1 END AS seq, max(CASE
WHEN level = 1 THEN n END) OVER w AS at1, max(CASE WHEN opens THEN n END) OVER w AS at2 FROM op WINDOW w AS (PARTITION BY doc
ORDER BY n)),
ca AS (SELECT se.doc, se.doc_id, se.n, se.line, se.seq::BIGINT AS seq, se.at1, x.title AS l1, CASE WHEN y.level = 1 THEN NULL
WHEN y.level = 2 THEN y.title ELSE y.part_break END AS l2, coalesce(y.level = 1, false) AS head FROM se LEFT
JOIN it x ON x.doc = se.doc AND x.n = se.at1 LEFT JOIN it y ON y.doc = se.doc AND y.n = se.at2),
ch AS (SELECT doc, seq, max(at1) AS at1, max(l2) AS l2, bool_or(head) AS head FROM ca GROUP BY ALL),
fl AS (SELECT doc, seq, coalesce(head AND lead(at1) OVER w = at1 AND lead(l2) OVER w IS NOT NULL, false) AS intro
FROM ch WINDOW w AS (PARTITION BY doc ORDER BY seq))
"""


@register("w11_section_carry", sql(ITEMS + "SELECT doc, n, seq, l1, l2, intro FROM ca JOIN fl USING (doc, seq)"))
def w11(spark, sf):
    return outline.section_carry(outline_items(spark, sf).drop("source", "doc_id", "line")).select("doc", "n", "seq", "l1", "l2", "intro")


@register("w12_cut_sections")
def w12(spark, sf):
    """Sections over 400 characters cut; tests/test_outline.py folds them row by row."""
    return outline.split_sections(outline.section_carry(outline_items(spark, sf)), 400).groupBy("doc", "seq", "part", "parts").agg(
        F.min("n").alias("first"),
        F.max("n").alias("last"),
        F.sum("size").alias("size"),
    )


@register("s13_files_by_size", sql(ITEMS + r""", tx AS (SELECT doc, doc_id, seq, l1, l2, string_agg(line, chr(10)
ORDER BY n) AS text, sum(length(line)) AS size FROM ca GROUP BY ALL), to_ AS (SELECT doc, sum(size) AS total FROM tx GROUP BY doc),
pa AS (SELECT doc_id % 4 <> 0 AS trusted, CASE WHEN doc_id % 4 = 0 THEN '_pending/' ELSE '' END || split_part(doc, '/',
1) || '/' || split_part(doc, '/', -1) || CASE WHEN total <= 4000 THEN '.md' ELSE '/' || regexp_replace(replace(coalesce(l1,
'Front'), '/', ' '), ' +', ' ', 'g') || '/' || CASE
WHEN seq < 10 THEN '0' ELSE '' END || seq || ' ' || regexp_replace(replace(coalesce(l2, l1, 'Front'), '/', ' '), ' +', ' ',
'g') || '.md' END AS path, seq, text FROM tx JOIN to_ USING (doc))
SELECT CASE WHEN trusted THEN 'auto_verified' ELSE 'pending_review' END AS status, path, md5(string_agg(text, chr(10)
ORDER BY seq)) AS text_hash, NULL AS problem FROM pa GROUP BY trusted, path"""))
def s13(spark, sf):
    """Sections as files by size, written, and the listing compared with what was meant."""
    items = outline.section_carry(outline_items(spark, sf))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    name = F.element_at(F.split("doc", "/"), -1)
    parts = items.groupBy(
        name.alias("doc"), "source", "doc_id", "seq", "l1", "l2",
    ).agg(text.alias("text"), F.sum("size").alias("size")).withColumns({"part": F.lit(1), "parts": F.lit(1)})
    documents = X.docs(spark, sf).select(
        F.element_at(F.split("rel", "/"), -1).alias("doc"),
        F.col("source").alias("folder"),
        (F.col("doc_id") % 4 != 0).alias("trusted"),
    )
    tree = written(outline.tree_of(parts.drop("source", "doc_id"), documents, 4000))
    wrong = outline.write_tree(tree, new_folder(spark, "trees"))
    return tree.select("status", "path", F.md5("text").alias("text_hash")).join(wrong, "path", "left")


@register("w13_nested_contents", sql("""
e AS (SELECT source AS doc, doc_id AS i, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source)
AND source <> 'src1' THEN 1 ELSE 2 + doc_id % 2 END AS level, CASE WHEN doc_id % 37 = 36
AND source <> 'src2' THEN doc_id - 50 ELSE doc_id END AS page FROM docs),
lv AS (SELECT doc, level, max(count(*)) OVER (PARTITION BY doc ORDER BY level) AS crowd, sum(count(*)) OVER (PARTITION BY doc
ORDER BY level DESC) AS rest FROM e GROUP BY doc, level),
tp AS (SELECT doc, min(level) AS top FROM lv WHERE NOT (crowd = 1 AND rest > 1) GROUP BY doc),
k AS (SELECT doc, i, level - top + 1 AS level, page, page < lag(page) OVER (PARTITION BY doc ORDER BY i) AS back FROM e JOIN tp USING (doc) WHERE level >= top)
SELECT doc, sum(level)::BIGINT AS levels, count(*) AS entries, count(*) FILTER (back) AS back_steps, count(*) >= 5
AND count(*) >= 100 / 40 AND count(*) FILTER (back) <= count(*) * 0.02 AS usable FROM k GROUP BY doc""", "docs"))
def w13(spark, sf):
    """A contents list a source with a document title above all; some entries go back."""
    d = X.docs(spark, sf)
    first = d.groupBy("source").agg(F.min("doc_id").alias("first"))
    i = F.col("doc_id")
    level = F.when((i == F.col("first")) & (F.col("source") != "src1"), 1).otherwise((2 + i % 2).cast("int"))
    entries = d.join(first, "source").select(
        F.col("source").alias("doc"),
        i.alias("i"),
        level.alias("level"),
        F.concat(F.lit("T"), i).alias("title"),
        F.when((i % 37 == 36) & (F.col("source") != "src2"), i - 50).otherwise(i).alias("page"),
    )
    kept = outline.nested(entries)
    usable = outline.contents_usable(kept, d.select(F.col("source").alias("doc"), F.lit(100).alias("pages")).distinct())
    return usable.join(kept.groupBy("doc").agg(F.sum("level").alias("levels")), "doc")


@register("a22_scope_both_ways", sql("""
ln AS (SELECT rel AS doc, n, CASE WHEN (doc_id + n) % 6 <> 0 THEN n + CASE WHEN n % 9 = 8 THEN 100000 ELSE 0 END END AS source_line
FROM s), en AS (SELECT rel AS doc, max(n) + 1 AS total FROM s GROUP BY rel),
pg AS (SELECT doc, p AS page, least(5 * p, total) AS lines FROM (SELECT doc, total, unnest(range(1, (total + 4) // 5 + 2)) AS p
FROM en)), pl AS (SELECT ln.doc, ln.n, min(page) AS page FROM ln JOIN pg ON pg.doc = ln.doc AND pg.lines >= source_line + 1
GROUP BY ALL),
ct AS (SELECT pg.doc, pg.page, count(pl.n) AS c FROM pg LEFT JOIN pl ON pl.doc = pg.doc AND pl.page = pg.page
GROUP BY ALL), em AS (SELECT doc, count(*) FILTER (c = 0) AS empty_pages, max(c) AS most FROM ct GROUP BY doc)
SELECT ln.doc, count(*) AS lines, count(*) FILTER (pl.page IS NULL) AS unmapped, round(100.0 * count(pl.page) / count(*),
1) AS in_scope, any_value(empty_pages) AS empty_pages, any_value(most) AS most FROM ln LEFT JOIN pl ON pl.doc = ln.doc
AND pl.n = ln.n JOIN em ON em.doc = ln.doc GROUP BY ln.doc"""))
def a22(spark, sf):
    """Lines without a match, lines behind the last page, and a last page without lines."""
    n, i = F.col("n"), F.col("doc_id")
    lines = rows(spark, sf).select(F.col("rel").alias("doc"), "n", F.when((i + n) % 6 != 0, n + F.when(n % 9 == 8, 100_000).otherwise(0)).alias("source_line"))
    ends = lines.groupBy("doc").agg((F.max("n") + 1).alias("total"))
    pages = ends.select(
        "doc",
        "total",
        F.explode(F.sequence(F.lit(1), (F.floor((F.col("total") + 4) / 5) + 1).cast("int"))).alias("page"),
    ).select("doc", "page", F.least(5 * F.col("page"), F.col("total")).alias("lines"))
    by_page, told = outline.page_scope(lines, pages)
    return told.join(by_page.groupBy("doc").agg(F.max("md_lines").alias("most")), "doc")


@register(
    "p33_block_hash",
    "SELECT doc_id, sha256(unhex(array_to_string([sha256(encode(text)[i * 1000 + 1 : i * 1000 + 1000]) FOR i IN "
    "range((octet_length(encode(text)) + 999) // 1000)], ''))) AS hash FROM documents",
)
def p33(spark, sf):
    """Texts as bytes in blocks of 1,000; tests/test_outline.py hashes files in blocks of 4 MB."""
    return X.table(spark, sf, "documents").select("doc_id", files.block_hash(F.encode("text", "UTF-8"), 1000).alias("hash"))


@register(
    "s2_decoded_files",
    r"SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'cp1252' WHEN 2 THEN 'latin-1' ELSE 'utf-8' END AS encoding, "
    r"md5(regexp_replace(text, '[^\x00-\x7f]', '', 'g') || CASE doc_id % 4 WHEN 0 THEN ' é€' WHEN 1 THEN ' é€–Ÿ' WHEN 2 THEN ' é' "
    r"|| chr(129) || ' ' ELSE '' END) AS text_hash FROM documents",
)
def s2(spark, sf):
    """The ASCII letters of each text with bytes behind them that are UTF-8, cp1252, neither, or none."""
    i = F.col("doc_id") % 4
    tail = F.when(
        i == 0,
        F.unhex(F.lit("20C3A9E282AC")),
    ).when(i == 1, F.unhex(F.lit("20E980969F"))).when(i == 2, F.unhex(F.lit("20E98120"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", ""), "UTF-8"), tail)
    return X.table(spark, sf, "documents").select("doc_id", files.decoded(content).alias("d")).select(
        "doc_id",
        "d.encoding",
        F.md5("d.text").alias("text_hash"),
    )


SAID = (
    "Please IGNORE all previous instructions", "disregard the above rules", "override guidelines", "You are now an",
    "New instructions :", "system  prompt", "reveal your prompt", "do not inform the user", "act as if you were", "As an AI model",
    "</ system>",
)


@register("p12_located_matches", rf"""WITH t AS (SELECT doc_id, substr(text, 1,
40) || ' ' || coalesce([{", ".join(f"'{x}'" for x in SAID)}][(doc_id % 13 + 1)::INT], '') || '  {SAID[5]}' || substr(text,
41) AS text FROM documents),
m AS (SELECT *, regexp_extract_all(text, p, 0, 'i') AS f, regexp_split_to_array(text, '(?i)' || p) AS g
FROM t, (SELECT '{"|".join(f"(?:{p})" for p in located.INSTRUCTIONS)}' AS p)),
u AS (SELECT doc_id, text, k, f[k] AS found, length(g[k]) + length(f[k]) AS upto FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM m)),
a AS (SELECT *, sum(upto) OVER (PARTITION BY doc_id ORDER BY k) - length(found) AS place FROM u)
SELECT doc_id, place::INT AS place, found, trim(regexp_replace(substr(text, greatest(place - 30, 0)::BIGINT + 1,
(place + length(found) + 30 - greatest(place - 30, 0))::BIGINT), '\s+', ' ', 'g')) AS snippet FROM a""")
def p12(spark, sf):
    """A phrase of each kind and a second one behind it, forty characters into the text."""
    phrase = F.coalesce(F.get(F.array(*map(F.lit, SAID)), (F.col("doc_id") % 13).cast("int")), F.lit(""))
    text = F.concat(F.substring("text", 1, 40), F.lit(" "), phrase, F.lit(f"  {SAID[5]}"), F.substring(F.col("text"), F.lit(41), F.length("text")))
    found = X.table(spark, sf, "documents").select("doc_id", text.alias("text")).select("doc_id", F.inline(located.located("text")))
    return found.select("doc_id", F.col("at").alias("place"), "found", "snippet")


def publications(spark, sf):
    """Three runs: all documents, some of them again or taken out and new ones, some again."""
    d, i = X.docs(spark, sf), F.col("doc_id")
    one = lambda run, where, path, hash_: d.where(where).select(F.lit(run).alias("run"), (i * 10 + run).alias("seq"), F.col("rel").alias("document"), path.alias("path"), hash_.alias("hash"))
    path = F.concat("rel", F.lit(".md"))
    out = one(1, "true", path, F.md5("text")).unionByName(one(2, "doc_id % 3 = 0", path, F.when(i % 12 != 0, F.md5(F.concat(F.lit("2"), "text")))))
    return out.unionByName(
        one(2, "doc_id % 7 = 0", F.concat("rel", F.lit(".new.md")), F.md5("rel"))
    ).unionByName(one(3, "doc_id % 5 = 0", path, F.md5(F.concat(F.lit("3"), "text"))))


@register("m9_rolled_back_run", X.with_("docs", r"""SELECT rel || '.md' AS path, 'restore' AS action, 1 AS run, md5(text) AS hash,
doc_id % 5 = 0 AS done_again FROM docs WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0
UNION ALL SELECT rel || '.new.md', 'remove', 0, NULL, doc_id % 5 = 0 FROM docs WHERE doc_id % 7 = 0"""))
def m9(spark, sf):
    """The second run taken out: what it replaced or removed comes back, what it brought goes, what the third run wrote stays."""
    p = publications(spark, sf)
    ledger = p.groupBy("document").agg(F.max("run").alias("run"))
    moved, kept = published.rollback(p, ledger, 2)
    return moved.join(kept.select("document", F.lit(True).alias("k")), "document", "left").select(
        "path",
        "action",
        F.coalesce("run", F.lit(0)).alias("run"),
        "hash",
        F.coalesce("k", F.lit(False)).alias("done_again"),
    )


@register(
    "j13_live_impact",
    X.with_(
        "docs",
        r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN EXISTS (SELECT 1 FROM docs x
WHERE x.doc_id % 2 = 0 AND x.source = docs.source AND x.lang = docs.lang) ELSE false END AS replaces FROM docs""",
    ),
)
def j13(spark, sf):
    """Keys of files in another case, of folders, and of neither; every second document is live."""
    d, i = X.docs(spark, sf), F.col("doc_id")
    key = F.when(i % 3 == 0, F.concat(F.lit("/"), F.upper("rel"))).when(
        i % 3 == 1,
        F.concat_ws("/", "source", F.upper("lang")),
    ).otherwise(F.concat("source", F.lit("/zz")))
    return published.impact(d.select("doc_id", key.alias("key")), d.where("doc_id % 2 = 0").select(F.col("rel").alias("path"))).select("doc_id", "replaces")

"""Queries over names, page statistics, rules, checks and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import records
from . import fixtures as X
from .registry import register

TITLES = (
    "AS 3500.1 2003 Part {0}", "NCC 2025 Volume {0} PCD", "NZS 4541:2020", "ibc 2021 superseded", "Notes {0}", "ISO 9001 Preview",
    "AS/NZS 3000 1998-2018", "Asbestos {0}",
)


def titled(i):
    out = F.lit(None)
    for k, title in enumerate(TITLES):
        before, _, after = title.partition("{0}")
        out = F.when(i % len(TITLES) == k, F.concat(F.lit(before), i.cast("string") if "{0}" in title else F.lit(""), F.lit(after))).otherwise(out)
    return out


@register("p14_standard_fields", X.with_("docs", rf""", t AS (SELECT rel,
CASE doc_id % {len(TITLES)} {" ".join(f"WHEN {k} THEN '" + title.replace("{0}", "' || doc_id || '") + "'" for k, title in enumerate(TITLES))} END AS name
FROM docs)
SELECT rel, CASE WHEN y <> '' THEN trim(regexp_replace(name, '\s*(19|20)\d{{2}}\s*', ' ', 'g')) ELSE name END AS std_id,
y AS std_year, CASE WHEN regexp_matches(upper(name), '^(NCC|IBC)') THEN 'code'
WHEN regexp_matches(upper(name), '^(AS|NZS|ISO)') THEN 'standard' ELSE 'document' END AS std_kind,
CASE WHEN regexp_matches(upper(name), '^(NCC|AS[ /1-5-])') THEN 'AU' WHEN starts_with(upper(name), 'NZS') THEN 'NZ'
WHEN starts_with(upper(name), 'IBC') THEN 'US' ELSE 'unknown' END AS jurisdiction, CASE
WHEN name LIKE '%PCD%' OR name LIKE '%Preview%' THEN 'draft'
WHEN name LIKE '%superseded%' THEN 'superseded' ELSE 'published' END AS edition
FROM (SELECT *, regexp_extract(' ' || name || ' ', '[^0-9]((19|20)[0-9][0-9])[^0-9]', 1) AS y FROM t)""").replace("\n, t AS", ",\nt AS"))
def p14(spark, sf):
    d = X.docs(spark, sf).select("rel", titled(F.col("doc_id")).alias("name"))
    return d.select("rel", names.standard_of(F.col("name")).alias("s"), names.edition_of(F.col("name")).alias("edition")).select("rel", "s.*", "edition")


HEADS = ("NSW D2D13 Stairs", "D3D14 Risers", "S5C11a Tables", "ACTD1D2", "QLD S5C1 x", "X1Y2 other", "H12G4", "WA  D2D13")


@register("p23_national_clauses", X.with_("docs", rf""", t AS (SELECT rel,
[{", ".join(f"'{h}'" for h in HEADS)}][(doc_id % {len(HEADS)} + 1)::INT] AS title
FROM docs), p AS (SELECT rel, title, '^(?:((?:ACT|NSW|NT|QLD|SA|TAS|VIC|WA)) )?((?:[A-J]\d{{1,2}}[GPDVOF]\d{{1,2}}|S\d{{1,2}}C\d{{1,2}}[a-z]?))\b' AS x
FROM t)
SELECT rel, nullif(regexp_extract(title, x, 1), '') AS state, nullif(regexp_extract(title, x, 2), '') AS clause FROM p""").replace("\n, t AS", ",\nt AS"))
def p23(spark, sf):
    title = F.get(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS)).cast("int"))
    return X.docs(spark, sf).select("rel", names.national_clause(title).alias("c")).select("rel", "c.state", "c.clause")


@register("p31_triage_classes", X.with_("docs s", r""", g AS (SELECT rel AS doc, n AS i, CASE
WHEN doc_id % 3 = 0 THEN length(line) % 40 ELSE length(line) END AS chars, (doc_id * 7 + n) % 700 AS vectors, CASE
WHEN (doc_id + n) % 4 < 2 THEN 1200 ELSE 600 END AS side FROM s),
z AS (SELECT doc, count(*) AS pages, greatest(1, count(*) // 24) AS step FROM g
GROUP BY doc), a AS (SELECT doc, any_value(pages) AS pages, avg(chars) AS chars, avg(vectors) AS vectors,
avg((side >= 1000)::INT) AS large FROM g JOIN z USING (doc) WHERE i % step = 0 AND i < step * 24 GROUP BY doc)
SELECT doc, class, CASE WHEN doc_id % 19 = 0 THEN 0 ELSE pages END AS pages, CASE
WHEN class IN ('drawing', 'scan', 'text') THEN round(chars, 1) END AS chars, CASE
WHEN class IN ('drawing', 'scan', 'text') THEN round(vectors, 1) END AS vectors
FROM (SELECT rel AS doc, doc_id, pages, chars, vectors, CASE WHEN doc_id % 13 = 0 OR (doc_id % 11 <> 0 AND doc_id % 17 <> 0
AND doc_id % 19 = 0) THEN 'unsupported' WHEN doc_id % 11 = 0 OR doc_id % 17 = 0 THEN 'protected' WHEN large >= 0.5
AND vectors >= 300 THEN 'drawing' WHEN chars < 25 THEN 'scan' ELSE 'text' END AS class FROM docs
JOIN a ON doc = rel)""").replace("\n, g AS", ",\ng AS"))
def p31(spark, sf):
    """Lines as pages, some large, some nearly empty; some files do not open, are locked, or have no pages."""
    src, _ = X.conv(spark, sf)
    d = X.docs(spark, sf).select("rel", "doc_id")
    i, n, size = F.col("doc_id"), F.col("n"), F.length("line")
    pages = src.join(d, "rel").where(i % 19 != 0).select(
        F.col("rel").alias("doc"),
        n.alias("i"),
        F.when(i % 3 == 0, size % 40).otherwise(size).alias("chars"),
        ((i * 7 + n) % 700).alias("vectors"),
        F.when((i + n) % 4 < 2, 1200).otherwise(600).alias("width"),
        F.lit(500).alias("height"),
    )
    return records.triage(
        d.select(
            F.col("rel").alias("doc"), (i % 13 != 0).alias("opens"), (i % 11 == 0).alias("locked"), (i % 17 != 0).alias("may_copy"),
        ),
        pages,
    )


@register("a23_fixes_to_widen", r"""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'text'
WHEN 1 THEN 'number' ELSE 'pattern' END AS kind, p_brand || p_size % 5 AS find, CASE WHEN p_partkey % 40 = 0 THEN 'all'
WHEN p_partkey % 2 = 1 THEN 'document' ELSE 'series' END AS scope, CASE WHEN p_partkey % 90 = 1 THEN NULL ELSE 'AS 350' || CASE
WHEN p_brand < 'Brand#25' THEN p_size % 3 ELSE 0 END END AS series FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 < 3
AND p_partkey % 3 < 2),
g AS (SELECT kind, find, list(id ORDER BY id) AS ids, bool_or(scope = 'all') AS has_all, count(DISTINCT CASE
WHEN scope <> 'all' THEN series END) AS k, bool_or(scope <> 'all' AND series IS NULL) AS none, min(series) AS one FROM r
GROUP BY ALL HAVING count(*) >= 2)
SELECT kind, find, array_to_string(ids, ',') AS ids, CASE WHEN k = 1 AND NOT none THEN 'series' ELSE 'all' END AS scope, CASE
WHEN k = 1 AND NOT none THEN one END AS series FROM g WHERE NOT has_all AND find NOT LIKE '%3'""")
def a23(spark, sf):
    """Fixes of many documents; those whose text ends in 3 were suggested before."""
    k, size = F.col("p_partkey"), F.col("p_size")
    of = F.concat(F.lit("AS 350"), F.when(F.col("p_brand") < "Brand#25", size % 3).otherwise(0))
    none = k % 90 == 1
    rules = X.table(spark, sf, "part").select(
        k.alias("id"), k.alias("num"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "number").otherwise("pattern").alias("kind"), F.concat("p_brand", size % 5).alias("find"), F.lit("x").alias("replace"), F.lit(None).cast("string").alias("before"), F.lit("").alias("after"),
        F.when(k % 40 == 0, "all").when(k % 2 == 1, "document").otherwise("series").alias("scope"), F.when(~none, of).alias("series"), F.when(none, "lib/notes.pdf").otherwise(F.concat(F.lit("lib/"), of, F.lit("-2003 plan.pdf"))).alias("doc"), (k % 7 != 0).alias("enabled"), (k % 5).alias("reverts"),
    )
    had = rules.where("enabled AND reverts < 3 AND find LIKE '%3'").groupBy("kind", "find").agg(F.collect_list("id").alias("ids")).select("ids")
    return records.widen(rules, had).select("kind", "find", F.array_join("ids", ",").alias("ids"), "scope", "series")


@register("j31_checks_by_room", r"""WITH r AS (SELECT event_id AS id, user_id AS room, event_type <> 'view' AS auto,
event_id % 10 = 0 AS sampled, CASE event_id % 20 WHEN 0 THEN NULL WHEN 10 THEN 'wrong' ELSE 'right' END AS done
FROM events), t AS (SELECT count(*) AS automatic, count(*) FILTER (done = 'right') AS "right",
count(*) FILTER (done = 'wrong') AS wrong FROM r WHERE auto)
SELECT id, c_name AS room_name, automatic, "right", wrong FROM r LEFT JOIN customer ON c_custkey = room + 100 CROSS JOIN t
WHERE auto AND sampled AND done IS NULL""")
def j31(spark, sf):
    i = F.col("event_id")
    rules = X.table(spark, sf, "events").select(
        i.alias("id"),
        i.alias("num"),
        F.lit("a").alias("find"),
        F.lit("b").alias("replace"),
        F.col("user_id").alias("room"),
        F.lit("r").alias("rel"),
        (F.col("event_type") != "view").alias("auto"),
        (i % 10 == 0).alias("sampled"),
        F.when(i % 20 == 10, "wrong").when(i % 20 != 0, "right").alias("check"),
        i.alias("at"),
    )
    rooms = X.table(spark, sf, "customer").select((F.col("c_custkey") - 100).alias("room"), F.col("c_name").alias("name"))
    waiting, totals = records.waiting_checks(rules, rooms)
    return waiting.select("id", "room_name").join(F.broadcast(totals))  # one row


@register("a13_pattern_scores", r"""WITH c AS (SELECT p_partkey // 10 AS id,
unnest([p_name || 'cd', p_name || CASE WHEN p_partkey % 5 = 0 THEN 'xd' ELSE 'ed' END, CASE WHEN p_partkey % 7 = 0 THEN 'abcd' ELSE p_name || ' cd' END]) AS text,
unnest([p_name || CASE WHEN p_partkey % 5 = 0 THEN 'xd' ELSE 'ed' END, p_name || CASE WHEN p_partkey % 5 = 0 THEN 'xd' ELSE 'ed' END, CASE WHEN p_partkey % 7 = 0 THEN 'abcd' ELSE p_name || ' cd' END]) AS want
FROM part),
m AS (SELECT id, count(*) AS cases, count(*) FILTER (regexp_replace(text, '(\w+)cd\b', '\1ed', 'g') <> want) AS wrong FROM c
GROUP BY id) SELECT id, cases, wrong, round(100.0 * (cases - wrong) / cases, 1) AS score FROM m""")
def a13(spark, sf):
    p, k = X.table(spark, sf, "part"), F.col("p_partkey")
    id_ = F.floor(k / 10).alias("id")
    fixes = p.select(id_, F.concat("p_name", F.lit("cd")).alias("wrong"), F.concat("p_name", F.when(k % 5 == 0, "xd").otherwise("ed")).alias("right"))
    others = p.select(id_, F.when(k % 7 == 0, "abcd").otherwise(F.concat("p_name", F.lit(" cd"))).alias("text"))
    return records.pattern_scores(p.select(id_, F.lit(r"(\w+)cd\b").alias("find"), F.lit(r"\1ed").alias("replace")).distinct(), fixes, others)


@register("a28_acceptance_sheet", r"""WITH q AS (SELECT CASE left(o_orderpriority, 1)
WHEN '5' THEN 'F' ELSE left(o_orderpriority, 1) END AS category, o_orderkey % 97 <> 0 AND coalesce(o_orderkey % 89 <> 0, false)
AND o_orderkey % 83 <> 0 AND o_orderstatus <> 'P' AS good, (o_orderkey % 157)::DOUBLE AS s FROM orders)
SELECT category, count(*) AS questions, count(*) FILTER (good) AS passed, round(count(*) FILTER (good) / count(*), 9) AS pass_rate,
median(s) AS median_s, CASE WHEN grouping(category) = 1 THEN count(*) FILTER (good) / count(*) >= 0.99
WHEN category = 'F' THEN count(*) FILTER (good) = count(*) END AS enough FROM q GROUP BY ROLLUP (category)""")
def a28(spark, sf):
    k, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    rows = X.table(spark, sf, "orders").select(
        k.alias("id"),
        F.when(first == "5", "F").otherwise(first).alias("category"),
        (k % 97 != 0).alias("answer_ok"),
        F.when(k % 89 != 0, F.lit(True)).alias("citation_ok"),
        (k % 83 != 0).alias("status_ok"),
        (F.col("o_orderstatus") != "P").alias("honesty_ok"),
        (k % 157).alias("seconds"),
    )
    return records.score_sheet(rows)


@register("j15_affected_documents", X.with_("docs", r""", b AS (SELECT item_id AS id, array_to_string(string_split(text, ' ')[1:2],
' ') AS find FROM benchmark), h AS (SELECT id, rel, (length(text) - length(replace(text, find, ''))) // length(find) AS places
FROM b JOIN docs ON contains(text, find))
SELECT id, rel, places FROM h UNION ALL SELECT DISTINCT item_id, rel, 0 FROM docs JOIN benchmark ON item_id = doc_id % 40
WHERE doc_id % 50 = 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = item_id AND h.rel = docs.rel)""").replace("\n, b AS", ",\nb AS"))
def j15(spark, sf):
    """The first two words of each item as what a rule looks for."""
    d = X.docs(spark, sf)
    rules = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("find"))
    return records.affected(d, rules, d.where("doc_id % 50 = 0").select((F.col("doc_id") % 40).alias("id"), "rel").join(rules.select("id"), "id"))


COUNTED = r"length(regexp_replace({0}, '^\s+|\s+$', '', 'g')), len(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[.,''\-][A-Za-z0-9]+)*'))"


@register("m10_backfilled_counts", X.with_("docs s m pairs", rf""", c AS (SELECT p.rel, doc_id,
{COUNTED.format('src_text').replace(', len', ' AS sc, len')} AS sw,
{COUNTED.format('md_text').replace(', len', ' AS mc, len')} AS mw FROM pairs p JOIN docs USING (rel))
SELECT rel, CASE WHEN doc_id % 2 = 0 THEN -1 WHEN doc_id % 6 = 5 THEN 0 ELSE sc END AS src_chars, CASE WHEN doc_id % 3 = 0 THEN -2
WHEN doc_id % 6 = 5 THEN 0 ELSE mc END AS md_chars, CASE WHEN doc_id % 2 = 0 THEN -3
WHEN doc_id % 6 = 5 THEN 0 ELSE sw END AS src_words, CASE WHEN doc_id % 3 = 0 THEN -4
WHEN doc_id % 6 = 5 THEN 0 ELSE mw END AS md_words FROM c""").replace("\n, c AS", ",\nc AS"))
def m10(spark, sf):
    """Some numbers are there (marked by negative ones), some are missing, and some texts cannot be read."""
    d, i = X.docs(spark, sf), F.col("doc_id")
    known = lambda cond, n: F.when(cond, F.lit(n).cast("long"))
    counts = d.select(
        "rel", known(i % 2 == 0, -1).alias("src_chars"), known(i % 3 == 0, -2).alias("md_chars"),
        known(i % 2 == 0, -3).alias("src_words"), known(i % 3 == 0, -4).alias("md_words"),
    )
    texts = X.pairs(spark, sf).join(d.select("rel", "doc_id"), "rel").where("doc_id % 6 <> 5").select(
        "rel",
        F.col("src_text").alias("src"),
        F.col("md_text").alias("md"),
    )
    return records.backfill(counts, texts).fillna(0)

"""Queries over correction rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from . import fixtures as X
from .registry import register

#: The rule library of the queries: num, kind, find, replace, before, after, scope, series, doc, enabled.
BOOK = [
    (1, "text", "the", "THE", None, None, "all", None, None, True),
    (2, "text", "THE of", "THE OF", None, None, "all", None, None, True),
    (3, "text", "and", "AND", None, None, "series", "src1", None, True),
    (4, "number", "l50", "150", "bore ", " mm", "all", None, None, True),
    (5, "pattern", r"nd([,.])", r"ND\1", None, None, "all", None, None, True),
    (6, "text", "current", "void", None, None, "all", None, None, True),
    (7, "text", "in", "IN", None, None, "document", None, "doc_5.pdf", True),
    (8, "text", "on", "ON", None, None, "all", None, None, False),
]


def book(spark):
    return spark.createDataFrame(BOOK, rules.RULE)


def bodies(spark, sf):
    """Documents under front matter, with a line of two bores."""
    d = X.library(spark, sf)
    return d.select(
        "rel",
        "doc_id",
        F.col("source").alias("series"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("doc"),
        F.concat("md_raw", F.lit("\nbore l50 mm, bore l50 kg, not l50 mm")).alias("text"),
    )


def exempt(spark, sf):
    return X.docs(spark, sf).where("doc_id % 4 = 0").select("rel", F.lit(1).alias("num"))


EDGE = r"[^\p{L}\p{N}_]"


def _edged(expr: str, find: str, new: str) -> str:
    """A word replaced between edges in DuckDB; twice, since neighbours share an edge."""
    for _ in range(2):
        expr = rf"regexp_replace({expr}, '(^|{EDGE}){find}($|{EDGE})', '\1{new}\2', 'g')"
    return expr


BODY = "text || chr(10) || 'bore l50 mm, bore l50 kg, not l50 mm'"
FRONT = "'---' || chr(10) || 'document: ' || source || chr(10) || 'std_id: AS ' || (3500 + doc_id % 7) || chr(10) || 'std_year: ' || (2000 + doc_id % 12) || chr(10) || 'status: ' || CASE WHEN doc_id % 9 = 0 THEN 'draft' ELSE 'current' END || chr(10) || 'flags: ' || CASE doc_id % 4 WHEN 0 THEN 'ocr, protected' WHEN 1 THEN 'ocr' ELSE '' END || chr(10) || '---' || chr(10)"
CORRECTED = f"""r1 AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN {BODY} ELSE {_edged(BODY, 'the', 'THE')} END AS b1 FROM docs),
r2 AS (SELECT *, {_edged('b1', 'THE of', 'THE OF')} AS b2 FROM r1), r3 AS (SELECT *, CASE
WHEN source = 'src1' THEN {_edged('b2', 'and', 'AND')} ELSE b2 END AS b3 FROM r2),
r4 AS (SELECT *, regexp_replace(replace(b3, 'bore l50 mm', 'bore 150 mm'), 'nd([,.])', 'ND\\1', 'g') AS b4 FROM r3),
r5 AS (SELECT *, CASE WHEN doc_id = 5 THEN {_edged('b4', 'in', 'IN')} ELSE b4 END AS b5 FROM r4),
corrected AS (SELECT rel, source, doc_id, {FRONT} || b5 AS text, (length(b1) - length(replace(b1, 'THE',
''))) // 3 - (length({BODY}) - length(replace({BODY}, 'THE', ''))) // 3 AS n1 FROM r5)"""


@register(
    "v3_apply_rules",
    X.with_(
        "docs",
        f", {CORRECTED} SELECT rel, md5(text) AS text_hash, n1, CASE WHEN contains(text, 'bore 150 mm') THEN 1 END AS n4 "
        f"FROM corrected",
    ).replace("\n, r1", ",\nr1"),
)
def v3(spark, sf):
    done = rules.apply_rules(bodies(spark, sf), book(spark), "text", exempt(spark, sf))
    of = lambda k: F.get(F.filter("done", lambda x: x["num"] == k), F.lit(0))["n"]
    return done.select("rel", F.md5("text").alias("text_hash"), F.coalesce(of(1), F.lit(0)).cast("long").alias("n1"), of(4).alias("n4"))


@register(
    "j14_rules_of_documents",
    X.with_(
        "docs",
        "SELECT rel, unnest(list_filter([CASE WHEN doc_id % 4 <> 0 THEN 1 END, 2, CASE WHEN source = 'src1' THEN 3 END, 4, 5, 6, "
        "CASE WHEN doc_id = 5 THEN 7 END], lambda x: x IS NOT NULL)) AS num FROM docs",
    ),
)
def j14(spark, sf):
    return rules.holding(bodies(spark, sf).select("rel", "series", "doc"), book(spark), exempt(spark, sf)).select("rel", "num")


@register(
    "m6_reapplied",
    X.with_(
        "docs",
        f", {CORRECTED} SELECT rel, md5(text) AS text_hash, doc_id % 3 = 0 AS changed, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS "
        f"confirmed, n1 % 3 AS checks FROM corrected",
    ).replace("\n, r1", ",\nr1"),
)
def m6(spark, sf):
    """Every third stored result is older than the rules."""
    done = rules.apply_rules(bodies(spark, sf), book(spark), "text", exempt(spark, sf))
    first = F.get(F.filter("done", lambda x: x["num"] == 1), F.lit(0))["n"]
    corrected = done.select("rel", F.md5("text").alias("text_hash"), (F.coalesce(first, F.lit(0)) % 3).alias("checks"))
    state = done.select(
        "rel",
        F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.md5("text")).alias("text_hash"),
        (F.col("doc_id") % 2 == 0).alias("confirmed"),
    )
    return rules.reapplied(state, corrected)


TRIES = [
    ("text", "x", "y", "room", "scope"),
    ("text", " ", "y", "all", "no text"),
    ("text", "a\nb", "y", "all", "more than a line"),
    ("text", "same", "same", "series", "no change"),
    ("text", "Watre", "Water", "document", None),
    ("pattern", r"(\w+)cd", r"\1ed", "all", None),
    ("pattern", r"a.*b", "x", "all", "any text"),
    ("pattern", r"(a+)+", "x", "all", "nested repeat"),
    ("pattern", r"l5", "x", "all", "touches numbers"),
    ("pattern", r"(a)\1", "x", "all", "refers to itself"),
    ("pattern", r"(a", "x", "all", "not a pattern"),
    ("pattern", r"a", r"\2", "all", "group"),
    ("pattern", r"a?", "x", "all", "empty match"),
]


def _sql(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@register(
    "p41_rule_checks",
    f"SELECT p_partkey, CASE p_partkey % {len(TRIES)} {' '.join(f'WHEN {i} THEN {_sql(t[4])}' for i, t in enumerate(TRIES))} END "
    f"AS error FROM part",
)
def p41(spark, sf):
    i = (F.col("p_partkey") % len(TRIES) + 1).cast("int")
    kind, find, new, scope = (F.element_at(F.array(*[F.lit(t[k]) for t in TRIES]), i) for k in range(4))
    return X.table(spark, sf, "part").select("p_partkey", rules.rule_error(kind, find, new, scope).alias("error"))


@register("j30_number_context", r"""WITH t AS (SELECT o_orderkey, o_comment AS c, o_orderkey || 'x' AS f
FROM (SELECT o_orderkey, o_orderpriority || chr(10) || o_orderstatus || ' total of the order is ' AS a,
' for customer ' || o_custkey || ' in ' || o_orderdate AS o_comment FROM orders)),
b AS (SELECT o_orderkey, o_orderpriority || chr(10) || o_orderstatus || ' total of the order is ' AS l,
' for customer ' || o_custkey || ' and others' || chr(10) || 'end' AS r FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS places, CASE
WHEN o_orderkey % 5 <> 0 THEN regexp_extract(left(right(l, 24), 12), '[\p{L}\p{N}]*$') || right(l, 12) END AS before, CASE
WHEN o_orderkey % 5 <> 0 THEN left(r, 12) || regexp_extract(substr(r, 13, 12), '^[\p{L}\p{N}]*') END AS after FROM b""")
def j30(spark, sf):
    o = X.table(spark, sf, "orders")
    find = F.concat(F.col("o_orderkey"), F.lit("x"))
    body = F.concat(
        "o_orderpriority",
        F.lit("\n"),
        "o_orderstatus",
        F.lit(" total of the order is "),
        find,
        F.lit(" for customer "),
        F.col("o_custkey"),
        F.lit(" and others\nend"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), find)).otherwise(""),
    )
    return o.select("o_orderkey", rules.number_context(body, find).alias("x")).select("o_orderkey", "x.*")


@register(
    "a25_rule_preview",
    rf"SELECT count(*) AS documents, coalesce(sum(n), 0) AS places "
    rf"FROM (SELECT len(regexp_extract_all(replace(text, ' ', '  '), '(?:^|{EDGE})for(?:$|{EDGE})')) AS n FROM documents) "
    rf"WHERE n > 0",
)
def a25(spark, sf):
    return rules.preview(X.docs(spark, sf), {"kind": "text", "find": "for"}, "text")[0]


@register(
    "a25_rule_samples",
    X.with_(
        "docs",
        rf"SELECT rel, regexp_extract(text, '((?:\S+\s+){{0,5}})for((?:\s+\S+){{0,5}})') AS sample FROM docs "
        rf"WHERE contains(text, ' for ') AND NOT regexp_matches(replace(text, ' for ', ''), 'for') ORDER BY rel LIMIT 8",
    ),
)
def a25_samples(spark, sf):
    """A report of eight samples, of documents that hold the word and nothing like it."""
    d = X.docs(spark, sf).where(F.contains("text", F.lit(" for ")) & ~F.contains(F.replace("text", F.lit(" for "), F.lit("")), F.lit("for")))
    return rules.preview(d, {"kind": "text", "find": "for"}, "text")[1]


LOG = "WITH l AS (SELECT event_id AS seq, user_id AS rule, 'f' || (user_id % 60) AS find, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'undo' WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'enable' ELSE 'disable' END AS action, 'r' || (event_id % 9) AS rel FROM events)"


@register(
    "m7_rule_lifecycle",
    LOG + ", made AS (SELECT find, arg_min(rule, seq) AS rule FROM l WHERE action = 'create' "
    "GROUP BY find), f AS (SELECT rule, coalesce(arg_max(action, seq) FILTER (action IN ('enable', 'disable')) = 'enable', true) "
    "AS enabled, count(*) FILTER (action = 'undo') AS reverts, count(DISTINCT rel) FILTER (action = 'undo') AS exempt, "
    "bool_or(action = 'confirm') AS confirmed FROM l GROUP BY rule) SELECT rule, find, enabled, reverts, exempt, confirmed "
    "FROM made JOIN f USING (rule)",
)
def m7(spark, sf):
    e, kind = X.table(spark, sf, "events"), F.col("event_type")
    action = F.when(kind == "signup", "create").when(kind == "error", "undo").when(kind == "click", "confirm").when(kind == "view", "enable").otherwise("disable")
    return rules.lifecycle(
        e.select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("rule"),
            F.concat(F.lit("f"), F.col("user_id") % 60).alias("find"),
            action.alias("action"),
            F.concat(F.lit("r"), F.col("event_id") % 9).alias("rel"),
        )
    )


@register(
    "a24_pattern_suggestions",
    "SELECT 'i>I' AS signature, count(*) AS fixes, min(w) AS example FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w "
    "FROM part) WHERE regexp_matches(w, '^[^i]*i[^i]*$') HAVING count(*) >= 3",
)
def a24(spark, sf):
    words = X.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("find")).where(F.col("find").rlike("^[^i]*i[^i]*$"))
    return rules.pattern_suggestions(words.select("find", F.replace("find", F.lit("i"), F.lit("I")).alias("replace")))

"""Queries over independent readings. A page is a line of a document; all lines of all documents are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import picks, readings
from ..sources.tables import written
from . import fixtures as X
from .registry import register


def two_readings(spark, sf):
    """Two engines: the second reads l as I in some words; confidence by page."""
    src, _ = X.conv(spark, sf)
    d = src.join(X.docs(spark, sf).select("rel", "doc_id"), "rel").withColumn("w", F.split("line", " "))
    k = F.col("doc_id") + F.col("n")
    b = F.transform("w", lambda x, i: F.when((k + i) % 13 == 0, F.replace(x, F.lit("l"), F.lit("I"))).otherwise(x))
    return d.select(
        "rel",
        "doc_id",
        F.col("n").alias("page"),
        F.col("line").alias("a"),
        F.when(k % 50 != 0, F.array_join(b, " ")).alias("b"),
        (F.lit(0.85) + k % 15 / 100.0).alias("conf"),
    )


W = r"""w AS (SELECT rel, doc_id, n, line, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) - 1 AS i FROM s)"""


def sql(body: str) -> str:
    return X.with_("docs s", f", {W} {body}").replace("\n, w AS", ",\nw AS")


@register("v1_reading_vote", sql("""SELECT rel, n AS page, CASE WHEN (doc_id + n) % 50 <> 0 THEN round(CASE
WHEN words = 0 THEN 1.0 ELSE (words - bad) / words END, 4) END AS agreement, CASE WHEN (doc_id + n) % 50 <> 0
AND (words = 0 OR (words - bad) / words >= 0.995) AND 0.85 + (doc_id + n) % 15 / 100.0 >= 0.9
AND words > 0 THEN 'ok' ELSE 'review' END AS decision
FROM (SELECT rel, doc_id, n, count(*) FILTER (w <> '') AS words, count(*) FILTER ((doc_id + n + i) % 13 = 0
AND contains(w, 'l')) AS bad FROM w GROUP BY ALL)"""))
def v1(spark, sf):
    return readings.vote(two_readings(spark, sf)).drop("spans")


KNOWN = r"known AS (SELECT c AS word FROM (SELECT regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS c FROM w) WHERE length(c) >= 2 GROUP BY c HAVING count(*) >= 3)"


def known(spark, sf):
    src, _ = X.conv(spark, sf)
    return src.select(
        F.explode(F.split("line", " ")).alias("w")
    ).select(
        readings.core(F.col("w")).alias("word")
    ).where("length(word) >= 2").groupBy("word").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").select("word")


SWAPPED = r""", {known}, x AS (SELECT rel, doc_id, n, i, w AS a, replace(w, 'l', 'I') AS b, regexp_replace(w,
'^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') AS ca FROM w WHERE (doc_id + n + i) % 13 = 0 AND contains(w, 'l')
AND (doc_id + n) % 50 <> 0), y AS (SELECT *, replace(ca, 'l', 'I') AS cb FROM x)""".format(known=KNOWN)


@register("v2_glossary_choice")
def v2(spark, sf):
    pairs = two_readings(spark, sf).where("b IS NOT NULL")
    return readings.by_glossary(pairs, known(spark, sf))


@register(
    "v5_adoptable_answers",
    sql("SELECT * FROM (SELECT 1)").split(" SELECT * FROM (SELECT 1)")[0] + SWAPPED + r" SELECT rel, n AS page, i AS at, ca AS chosen FROM y WHERE i % 3 = 0 AND (n % 20) / 100.0 + 0.8 >= 0.9 AND n % 7 <> 0 AND "
    r"NOT regexp_matches(ca, '\d') AND ca IN (SELECT word FROM known) AND cb NOT IN (SELECT word FROM known)",
)
def v5(spark, sf):
    """Answers on the words that two engines read apart: some unsure, some for a person, some that choose the wrong word."""
    swapped = readings.replaced_words(two_readings(spark, sf).where("b IS NOT NULL"), straight=True)
    n, i = F.col("page"), F.col("at_a")
    answers = swapped.select(
        "rel",
        "page",
        i.alias("at"),
        F.array("a", "b").alias("candidates"),
        F.col("a").alias("in_text"),
        F.when(i % 3 == 0, 0).when(i % 3 == 1, 1).alias("choice"),
        (n % 20 / 100.0 + 0.8).alias("confidence"),
        (n % 7 == 0).alias("needs_human"),
    )
    return readings.adoptable(answers, known(spark, sf)).select("rel", "page", "at", "chosen")


@register("j29_reading_context", X.with_("docs", r""", f AS (SELECT rel, CASE
WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])with($|[^\p{L}\p{N}_])') THEN 'with'
WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') THEN 'the' END AS found, text FROM docs),
g AS (SELECT rel, found, regexp_extract(text, '(?s)^(.*?[^\p{L}\p{N}_]|)' || found || '([^\p{L}\p{N}_].*|)$', 1) AS l,
regexp_extract(text, '(?s)^(.*?[^\p{L}\p{N}_]|)' || found || '([^\p{L}\p{N}_].*|)$', 2) AS r FROM f WHERE found IS NOT NULL)
SELECT rel, found, array_to_string(list_filter(regexp_split_to_array(l, '\s+'), lambda x: x <> '')[-8:], ' ') AS before,
array_to_string(list_filter(regexp_split_to_array(r, '\s+'), lambda x: x <> '')[1:8], ' ') AS after
FROM g""").replace("\n, f AS", ",\nf AS"))
def j29(spark, sf):
    d = X.docs(spark, sf).select("rel", readings.context_of(F.col("text"), [F.lit("with"), F.lit("the")]).alias("c"))
    return d.where("c IS NOT NULL").select("rel", "c.*")


@register(
    "a27_page_confidence",
    X.with_(
        "docs s",
        ", c AS (SELECT rel, n, length(line) AS size, 850000 + (doc_id + n) % 15 * 10000 AS conf FROM s) SELECT rel, "
        "CASE WHEN sum(size) > 0 THEN ((2 * sum(conf * size) + sum(size)) // (2 * sum(size))) / 1e6 END AS conf, count(*) FILTER "
        "(size > 0 AND conf < 900000) AS low_pages, count(*) FILTER (size = 0) > 0 AS partial FROM c GROUP BY rel",
    ).replace("\n, c AS", ",\nc AS"),
)
def a27(spark, sf):
    r = two_readings(spark, sf).select("rel", "page", F.col("a").alias("text"), F.round("conf", 6).alias("conf"))
    return readings.page_confidence(r)


@register(
    "p11_number_corrections",
    r"""SELECT ps_key, md5(text) AS text_hash, n FROM (SELECT l_orderkey || '-' || l_linenumber AS ps_key, 'Pipe ' ||
CASE l_linenumber % 6 WHEN 0 THEN '150 mm and 1' || l_orderkey || '1 bolts' WHEN 1 THEN l_orderkey || '5 kPa'
WHEN 2 THEN '2.7 kN see S' || '17C' || l_orderkey WHEN 3 THEN 'fireresistance of ' || l_orderkey
WHEN 4 THEN 'first office ' || l_orderkey ELSE 'Class 2S building ISO 9001 3D ' || l_orderkey END AS text, CASE l_linenumber % 6
WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS n FROM lineitem)""",
)
def p11(spark, sf):
    """Each rule on its own case, and a case that no rule may touch."""
    k, i = F.col("l_orderkey").cast("string"), F.col("l_linenumber") % 6
    said = (
        F.when(i == 0, F.concat(F.lit("l50 mm and 1"), k, F.lit("1 bolts")))
        .when(i == 1, F.concat(k, F.lit("S kPa")))
        .when(i == 2, F.concat(F.lit("2.7 KN see $17C"), k))
        .when(i == 3, F.concat(F.lit("fire-\nresistance of "), k))
        .when(i == 4, F.concat(F.lit("ﬁrst oﬃce "), k))
        .otherwise(F.concat(F.lit("Class 2S building ISO 9001 3D "), k))
    )
    d = X.table(spark, sf, "lineitem").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("ps_key"), F.concat(F.lit("Pipe "), said).alias("t"))
    fixed = d.withColumn("x", readings.correct_text("t"))
    return fixed.select("ps_key", F.md5("x.text").alias("text_hash"), F.size("x.log").cast("long").alias("n"))


def picked(spark, sf):
    """Words that two engines read apart with glossary candidates, and answers to them: most take a candidate, some invent one, some fail."""
    pairs = two_readings(spark, sf).select("rel", "page", "a", "b")
    asked = written(picks.questions(pairs, known(spark, sf)))  # questions, answers and the log all read it
    k = F.pmod(F.col("page") + F.col("at_a"), F.lit(7))
    answers = asked.select(
        "rel",
        "page",
        "at_a",
        F.when(k == 5, F.concat("a", F.lit("x"))).when(
            k < 5,
            F.element_at("candidates", (F.pmod(k, F.size("candidates")) + 1).cast("int")),
        ).alias("pick"),
        F.when(k == 6, "no answer").alias("error"),
    )
    return pairs, asked, answers


@register("v4_constrained_pick")
def v4(spark, sf):
    """What became of each disputed word, with its candidates; a picked word stands in both texts afterwards."""
    pairs, asked, answers = picked(spark, sf)
    log = picks.picks(asked, answers)
    texts = picks.picked_texts(pairs, log).select("rel", "page", F.md5("a").alias("a_hash"), F.md5("b").alias("b_hash"))
    return log.join(
        asked.select("rel", "page", "at_a", F.array_join("candidates", " ").alias("candidates")),
        ["rel", "page", "at_a"],
    ).join(texts, ["rel", "page"])

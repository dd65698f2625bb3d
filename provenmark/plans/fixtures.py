"""Tables that the registered queries derive from the given ones, as DataFrames and as SQL (WITH parts by name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.withColumn("rel", F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".pdf"))))


def _md(lines):
    def one(line, n):
        h = (F.col("doc_id") * 31 + n) % 10
        return (
            F.when(h == 0, F.array().cast("array<string>"))
            .when(h == 1, F.array(F.regexp_replace(line, r"\s*\S+$", "")))
            .when(h == 2, F.array(F.concat(F.lit("- "), line)))
            .when(h == 3, F.array(line, line))
            .when(h == 4, F.array(line, F.concat(F.lit("note "), F.col("doc_id").cast("string"))))
            .otherwise(F.array(line))
        )

    return F.transform(F.flatten(F.transform(lines, one)), text.strip_lead)


def conv(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Source and Markdown lines: (rel, n, line)."""
    d = docs(spark, sf).withColumn("ls", F.split("text", "\n"))
    return d.select("rel", F.posexplode("ls").alias("n", "line")), d.select("rel", F.posexplode(_md(F.col("ls"))).alias("n", "line"))


def pairs(spark, sf) -> DataFrame:
    d = docs(spark, sf)
    return d.select("rel", F.col("text").alias("src_text"), F.array_join(_md(F.split("text", "\n")), "\n").alias("md_text"))


def evals(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 11 == 0, "deferred").when(i % 11 == 1, "human_decide").when(
        i % 11 == 2,
        "not_applicable",
    ).when(i % 11 == 3, "error").otherwise("evaluated")
    d = docs(spark, sf)
    return d.select(
        "rel",
        "doc_id",
        "source",
        F.when(status == "evaluated", (i * 7919 % 1001) / 10.0).alias("auto_score"),
        status.alias("status"),
        F.col("n_chars").alias("src_chars"),
        (i % 5 == 0).alias("salvage"),
    )


def trust(spark, sf) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "diff_big").otherwise("ok")
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return d.select("rel", "doc_id", verdict.alias("verdict"), F.concat(F.lit("r"), F.col("doc_id") % 5).alias("reviewer"))


def numtext(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    line = lambda n: F.concat(F.lit("Clause "), F.col("l_orderkey"), F.lit(" size "), n, F.lit(" mm load "), F.col("l_extendedprice").cast("int"), F.lit(" kPa"))
    rel = F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    return li.select(rel.alias("rel"), line(q).alias("src_text"), line(F.when(F.col("l_linenumber") == 3, q + 1).otherwise(q)).alias("md_text"))


def calls(spark, sf) -> DataFrame:
    """Assistant calls derived from events."""
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "view", "cached").when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "signup",
        "blocked",
    ).otherwise("ok")
    decision = F.when(F.col("event_id") % 20 < 12, "adopted").when(F.col("event_id") % 20 < 13, "rejected")
    cost = F.when(F.col("event_type") == "purchase", F.col("value") / 100).otherwise(0.0)
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6
    return e.select(
        "event_id",
        (F.col("user_id") % 4).alias("skill"),
        "user_id",
        status.alias("status"),
        F.when(status == "ok", decision).alias("decision"),
        cost.alias("cost"),
        "ts",
        t.alias("t"),
    )


def logins(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").where("event_type IN ('error', 'signup')")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("address"),
        F.when(F.col("event_type") == "error", "login_failed").otherwise("login").alias("type"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"),
    )


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("rel"),
        F.md5("s_name").alias("content_hash"),
        F.length("s_name").cast("long").alias("size"),
    )
    after = s.where("rel % 17 != 0").withColumn("size", F.when(F.col("rel") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    fresh = s.where("rel <= 3").select((F.col("rel") + 1_000_000).alias("rel"), "content_hash", "size")
    return s, after.unionByName(fresh)


def library(spark, sf) -> DataFrame:
    d = docs(spark, sf)
    i = F.col("doc_id")
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
    )
    return d.select("rel", "doc_id", "source", head.alias("md_raw"))


LEAD = r"^(?:(?:#{1,6}\s)|(?:>\s)|(?:[-*+]\s)|(?:\d{1,3}\.\s))+"
SQL = {
    "docs": "docs AS (SELECT *, source || '/' || lang || '/doc_' || doc_id || '.pdf' AS rel FROM documents)",
    "s": "s AS (SELECT rel, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM docs)",
    "m": rf"""m1 AS (SELECT rel, n * 10 AS o, CASE (doc_id * 31 + n) % 10 WHEN 1 THEN regexp_replace(line, '\s*\S+$', '')
WHEN 2 THEN '- ' || line ELSE line END AS line FROM s WHERE (doc_id * 31 + n) % 10 <> 0
        UNION ALL SELECT rel, n * 10 + 1, line FROM s WHERE (doc_id * 31 + n) % 10 = 3 UNION ALL
SELECT rel, n * 10 + 1, 'note ' || doc_id FROM s WHERE (doc_id * 31 + n) % 10 = 4),
        m AS (SELECT rel, row_number() OVER (PARTITION BY rel ORDER BY o) - 1 AS n, regexp_replace(line, '{LEAD}', '') AS line FROM m1)""",
    "pairs": "pairs AS (SELECT docs.rel, docs.text AS src_text, coalesce(x.md_text, '') AS md_text FROM docs LEFT JOIN (SELECT rel, string_agg(line, chr(10) ORDER BY n) AS md_text FROM m GROUP BY rel) x ON x.rel = docs.rel)",
    "evals": """e0 AS (SELECT rel, doc_id, source, n_chars AS src_chars, doc_id % 5 = 0 AS salvage, CASE doc_id % 11
WHEN 0 THEN 'deferred' WHEN 1 THEN 'human_decide' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'error' ELSE 'evaluated' END AS status
FROM docs),
        evals AS (SELECT *, CASE WHEN status = 'evaluated' THEN (doc_id * 7919 % 1001) / 10.0 END AS auto_score FROM e0)""",
    "trust": "trust AS (SELECT rel, doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'diff_big' ELSE 'ok' END AS verdict, 'r' || (doc_id % 5) AS reviewer FROM docs JOIN labels USING (doc_id))",
    "badges": """badges AS (SELECT evals.*, verdict, reviewer, CASE WHEN verdict = 'rejected' THEN 'rejected'
WHEN verdict = 'diff_big' THEN 'diff_big' WHEN verdict = 'ok' AND auto_score >= 80 THEN 'trusted'
WHEN verdict = 'ok' THEN 'need_review' ELSE 'unreviewed' END AS state
        FROM evals LEFT JOIN trust USING (rel))""",
    "numtext": """nt AS (SELECT l_orderkey || '-' || l_linenumber AS rel, CAST(trunc(l_quantity) AS INTEGER) AS q,
l_linenumber AS ln, CAST(trunc(l_extendedprice) AS INTEGER) AS p, l_orderkey AS ok FROM lineitem),
        numtext AS (SELECT rel, 'Clause ' || ok || ' size ' || q || ' mm load ' || p || ' kPa' AS src_text,
'Clause ' || ok || ' size ' || CASE WHEN ln = 3 THEN q + 1 ELSE q END || ' mm load ' || p || ' kPa' AS md_text FROM nt)""",
    "calls": """c0 AS (SELECT event_id, user_id % 4 AS skill, user_id, CASE event_type WHEN 'view' THEN 'cached'
WHEN 'error' THEN 'error' WHEN 'signup' THEN 'blocked' ELSE 'ok' END AS status, CASE
WHEN event_type = 'purchase' THEN value / 100 ELSE 0.0 END AS cost, ts, epoch_us(ts) / 1e6 AS t FROM events),
        calls AS (SELECT *, CASE WHEN status = 'ok' AND event_id % 20 < 12 THEN 'adopted' WHEN status = 'ok'
AND event_id % 20 < 13 THEN 'rejected' END AS decision FROM c0)""",
    "logins": "logins AS (SELECT event_id AS id, user_id AS address, CASE WHEN event_type = 'error' THEN 'login_failed' ELSE 'login' END AS type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type IN ('error', 'signup'))",
    "snap": """old AS (SELECT s_suppkey AS rel, md5(s_name) AS content_hash, length(s_name) AS size FROM supplier),
        new AS (SELECT rel, content_hash, CASE WHEN rel % 13 = 0 THEN size + 1 ELSE size END AS size FROM old WHERE rel % 17 <> 0
UNION ALL SELECT rel + 1000000, content_hash, size FROM old WHERE rel <= 3)""",
    "library": """library AS (SELECT rel, doc_id, source,
'---' || chr(10) || 'document: ' || source || chr(10) || 'std_id: AS ' || (3500 + doc_id % 7) || chr(10) || 'std_year: ' || (2000 + doc_id % 12) || chr(10) || 'status: ' ||
CASE WHEN doc_id % 9 = 0 THEN 'draft' ELSE 'current' END || chr(10) || 'flags: ' || CASE doc_id % 4 WHEN 0 THEN 'ocr, protected'
WHEN 1 THEN 'ocr' ELSE '' END || chr(10) || '---' || chr(10) || text AS md_raw FROM docs)""",
}


def with_(names: str, body: str) -> str:
    """SQL with the named parts in front."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body

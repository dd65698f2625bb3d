"""Correction rules: what may be saved, where a rule holds, where it finds its text, applying rules in order, and their lifecycle.

rules(num, kind, find, replace, before, after, scope, series, doc, enabled): kind is text, number or pattern; scope is all, series or
document. Texts are changed in the body only, never in the front matter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.names import body_of

RULE = "num int, kind string, find string, replace string, before string, after string, scope string, series string, doc string, enabled boolean"
# Limits of a rule.
LONGEST, LONGEST_PATTERN, CONTEXT, LEAST_CONTEXT = 200, 120, 12, 3
SCOPES = ("document", "series", "all")


def _literal(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(F.coalesce(c, F.lit("")), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def pattern_of(r: Column) -> Column:
    """The pattern of a rule: text with word edges where it has word characters, numbers with their exact context, patterns as they are."""
    edged = F.concat(
        F.when(r["find"].rlike(r"(?U)^\w"), r"(?<!\w)").otherwise(""),
        _literal(r["find"]),
        F.when(r["find"].rlike(r"(?U)\w$"), r"(?!\w)").otherwise(""),
    )
    number = F.concat(F.lit("(?<="), _literal(r["before"]), F.lit(")"), _literal(r["find"]), F.lit("(?="), _literal(r["after"]), F.lit(")"))
    return F.concat(F.lit("(?U)"), F.when(r["kind"] == "pattern", r["find"]).when(r["kind"] == "number", number).otherwise(edged))


def _replacement(r: Column) -> Column:
    """What comes in, in Java's notation: groups are `\\1` in a pattern's replacement; in others nothing has a meaning of its own."""
    plain = F.regexp_replace(r["replace"], r"([\\$])", r"\\$1")
    return F.when(r["kind"] == "pattern", F.regexp_replace(F.replace(r["replace"], F.lit("$"), F.lit("\\$")), r"\\([1-9])", r"\$$1")).otherwise(plain)


def _put(text: Column, r: Column) -> Column:
    """struct(text, n) after one rule; matches of a pattern that have or would get a digit, or would not change, stay."""
    pattern, new = pattern_of(r), _replacement(r)
    simple = F.struct(F.regexp_replace(text, pattern, new).alias("text"), F.regexp_count(text, pattern).cast("long").alias("n"))
    was = F.regexp_extract_all(text, pattern, F.lit(0))
    now = F.transform(was, lambda m: F.regexp_replace(m, pattern, new))
    safe = F.zip_with(was, now, lambda a, b: F.when(F.concat(a, b).rlike(r"(?U)\d"), a).otherwise(b))
    pieces = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(pieces, safe, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    folded = F.struct(
        joined.alias("text"),
        F.aggregate(F.zip_with(was, safe, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y).alias("n"),
    )
    return F.when(
        ~F.contains(text, r["find"]) & (r["kind"] != "pattern"),
        F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")),
    ).when(r["kind"] == "pattern", folded).otherwise(simple)


def places(docs: DataFrame, c: str, find: Column) -> DataFrame:
    """Documents that contain a text, and how often."""
    return docs.where(F.contains(F.col(c), find)).withColumn("places", F.regexp_count(c, _literal(find)).cast("long"))


def holding(docs: DataFrame, rules: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """docs(rel, series, doc) and rules to (rel, num, …): enabled rules whose scope takes in the document and that it is not exempt from.

    One equi-join on a scope key; Spark broadcasts the rules where their size allows.
    """
    keys = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("series "), "series"), F.concat(F.lit("document "), "doc")))
    wanted = docs.select("rel", F.explode(keys).alias("key"))
    of = F.when(F.col("scope") == "all", "all").when(
        F.col("scope") == "series",
        F.concat(F.lit("series "), "series"),
    ).otherwise(F.concat(F.lit("document "), "doc"))
    met = wanted.join(rules.where("enabled").withColumn("key", of), "key").drop("key")
    return met if exempt is None else met.join(exempt.select("num", "rel"), ["num", "rel"], "left_anti")


def apply_rules(docs: DataFrame, rules: DataFrame, c: str, exempt: DataFrame | None = None) -> DataFrame:
    """docs(rel, series, doc, text) with the rules that hold applied in order of num, and done, an array of (num, n).

    Only ids and rules are shuffled to find a document's rules; they are folded inside its row.
    """
    own = holding(docs.select("rel", "series", "doc"), rules, exempt)
    book = own.groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("num", "kind", "find", "replace", "before", "after"))).alias("__book"))
    joined = docs.join(book, "rel", "left").withColumn("__body", body_of(F.col(c)))
    start = F.struct(F.col("__body").alias("text"), F.array().cast("array<struct<num:int,n:bigint>>").alias("done"))

    def step(acc, r):
        # one-row arrays hold what a step computes, so it is computed once
        return F.get(
            F.transform(
                F.array(_put(acc["text"], r)),
                lambda x: F.struct(
                    x["text"].alias("text"),
                    F.when(
                        x["n"] > 0,
                        F.array_append(acc["done"], F.struct(r["num"].alias("num"), x["n"].alias("n"))),
                    ).otherwise(acc["done"]).alias("done"),
                ),
            ),
            F.lit(0),
        )

    done = joined.withColumn("__done", F.when(F.col("__book").isNull(), start).otherwise(F.aggregate("__book", start, step)))
    front = F.substring(F.col(c), F.lit(1), F.length(c) - F.length("__body"))
    return done.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.concat(front, F.col("__done.text"))), "done": F.col("__done.done")}
    ).drop("__book", "__done", "__body")


@F.pandas_udf(StringType())
def _compiled(patterns: pd.Series, replaces: pd.Series) -> pd.Series:
    """What is wrong with patterns as such; one small row a rule."""
    out = []
    for p, new in zip(patterns, replaces, strict=True):
        try:
            found = re.compile(p)
            groups = max(map(int, re.findall(r"\\([1-9])", new or "")), default=0)
            out.append("group" if groups > found.groups else "empty match" if found.match("") else None)
        except (re.error, TypeError):
            out.append("not a pattern")
    return pd.Series(out, dtype="object")


def rule_error(kind: Column, find: Column, replace: Column, scope: Column) -> Column:
    """The first reason why a rule may not be saved, null where it may."""
    digits = r"\d|\\d|\[[^\]]*0-9"
    nested = r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)\s*[+*{]"
    text = F.when(F.trim(F.coalesce(find, F.lit(""))) == "", "no text").when(
        F.contains(find, F.lit("\n")) | F.contains(replace, F.lit("\n")),
        "more than a line",
    ).when((F.length(find) > LONGEST) | (F.length(replace) > LONGEST), "too long").when(find == replace, "no change")
    pattern = (
        F.when((F.coalesce(find, F.lit("")) == "") | (F.length(find) > LONGEST_PATTERN), "length")
        .when((F.length(replace) > LONGEST) | F.contains(F.concat(find, replace), F.lit("\n")), "more than a line")
        .when(find.rlike(r"\\[1-9]|\(\?P="), "refers to itself")
        .when(find.rlike(digits) | F.regexp_replace(replace, r"\\[1-9]", "").rlike(r"\d"), "touches numbers")
        .when(find.rlike(r"(?<!\\)\.[*+]"), "any text")
        .when(find.rlike(nested), "nested repeat")
        .otherwise(_compiled(find, replace))
    )
    return F.when(~scope.isin(*SCOPES), "scope").when(kind == "pattern", pattern).otherwise(text)


def number_context(body: Column, find: Column) -> Column:
    """struct(places, before, after): the context of a number that stands in a text once: 12 characters on each side, grown to
    whole words (by 12 more at most), within its line. Null contexts where it stands elsewhere too or the context says too little."""
    n = F.regexp_count(body, F.concat(F.lit("(?="), _literal(find), F.lit(")")))
    at = F.position(find, body)
    left = F.substring(body, F.lit(1), at - 1)
    right = F.substring(body, at + F.length(find), F.length(body))

    def last(c: Column, k: int) -> Column:
        return F.when(F.length(c) <= k, c).otherwise(F.substring(c, F.length(c) - k + 1, F.lit(k)))

    near, more = last(left, CONTEXT), F.substring(last(left, 2 * CONTEXT), F.lit(1), F.greatest(F.length(last(left, 2 * CONTEXT)) - CONTEXT, F.lit(0)))
    grown = F.when(near.rlike(r"^[\p{L}\p{N}]"), F.concat(F.regexp_extract(more, r"[\p{L}\p{N}]*$", 0), near)).otherwise(near)
    before = F.element_at(F.split(grown, "\n"), -1)
    close, beyond = F.substring(right, 1, CONTEXT), F.substring(right, CONTEXT + 1, CONTEXT)
    stretched = F.when(close.rlike(r"[\p{L}\p{N}]$"), F.concat(close, F.regexp_extract(beyond, r"^[\p{L}\p{N}]*", 0))).otherwise(close)
    after = F.get(F.split(stretched, "\n"), F.lit(0))
    good = (n == 1) & (F.length(F.trim(F.concat(before, after))) >= LEAST_CONTEXT)
    return F.struct(n.cast("long").alias("places"), F.when(good, before).alias("before"), F.when(good, after).alias("after"))


def preview(docs: DataFrame, rule: dict[str, str], c: str, samples: int = 8) -> tuple[DataFrame, DataFrame]:
    """(documents and places of a rule, its first samples with five words each side by rel)."""
    r = {k: F.lit(v) for k, v in {"before": "", "after": "", **rule}.items()}
    pattern = pattern_of(r)
    found = docs.withColumn("n", F.regexp_count(c, pattern).cast("long")).where("n > 0")
    shown = F.regexp_substr(c, F.concat(F.lit(r"((?:\S+\s+){0,5})("), pattern, F.lit(r")((?:\s+\S+){0,5})")))
    return found.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("places"),
    ), found.select("rel", shown.alias("sample")).orderBy("rel").limit(samples)


def reapplied(state: DataFrame, corrected: DataFrame) -> DataFrame:
    """M6: state(rel, text_hash, confirmed) and corrected(rel, text_hash, checks): a result that changed loses its confirmation."""
    new = corrected.withColumnRenamed("text_hash", "__new")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("text_hash"))
    return state.join(new, "rel", "left").select(
        "rel",
        F.coalesce("__new", "text_hash").alias("text_hash"),
        changed.alias("changed"),
        (F.col("confirmed") & ~changed).alias("confirmed"),
        F.coalesce("checks", F.lit(0)).cast("long").alias("checks"),
    )


def lifecycle(log: DataFrame) -> DataFrame:
    """M7: an append-only log(seq, rule, find, action, rel) folded to a row for each rule that stands.

    Actions: create, undo (the document is exempt from then on), confirm, enable, disable. A second rule with the same find is
    refused: the first one made stands. Rules without a create are not there.
    """
    made = log.where("action = 'create'").groupBy("find").agg(F.min_by("rule", "seq").alias("rule"))
    switch = F.when(F.col("action").isin("enable", "disable"), F.col("seq"))
    folded = log.groupBy("rule").agg(
        F.coalesce(F.max_by("action", switch) == "enable", F.lit(True)).alias("enabled"),
        F.count_if(F.col("action") == "undo").alias("reverts"),
        F.count_distinct(F.when(F.col("action") == "undo", F.col("rel"))).alias("exempt"),
        F.max(F.col("action") == "confirm").alias("confirmed"),
    )
    return made.join(folded, "rule").select("rule", "find", "enabled", "reverts", "exempt", "confirmed")


@F.pandas_udf(StringType())
def change_signature(wrong: pd.Series, right: pd.Series) -> pd.Series:
    """The character changes between a wrong and a right text (`cd>ed`); one short row a fix."""
    import difflib

    def one(a, b):
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        return " ".join(f"{a[i:j]}>{b[k:m]}" for op, i, j, k, m in ops if op != "equal")

    return pd.Series([one(a or "", b or "") for a, b in zip(wrong, right, strict=True)], dtype="object")


def pattern_suggestions(fixes: DataFrame, least: int = 3) -> DataFrame:
    """fixes(find, replace) to signatures that at least so many different fixes share."""
    each = fixes.distinct().withColumn("signature", change_signature("find", "replace")).where("signature <> ''")
    return each.groupBy("signature").agg(F.count(F.lit(1)).alias("fixes"), F.min("find").alias("example")).where(F.col("fixes") >= least)


def library(done: DataFrame, log: DataFrame, share: float = 0.2) -> DataFrame:
    """A10: results of apply_rules (done) and log(num, undone, acts) to a row a rule: documents, hits, and whether it is often taken back."""
    hits = done.select(F.explode("done").alias("x")).groupBy(F.col("x.num").alias("num")).agg(F.count(F.lit(1)).alias("documents"), F.sum("x.n").alias("hits"))
    return hits.join(log, "num", "left").select(
        "num",
        "documents",
        "hits",
        F.coalesce(F.col("undone") > share * F.col("acts"), F.lit(False)).alias("often_undone"),
    )

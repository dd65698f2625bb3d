"""Verification of pages: characters, extra text and numbers of each, rolled up to a report of each document."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text
from .align import lost_tokens

# Bounds of the checks and of the examples that a report lists.
RECALL, EXTRA_CHARS, EXTRA_SHARE, LISTED, ITEMS = 0.995, 40, 0.03, 30, 8
BLIND_CHARS, BLIND_RECALL, AGREE_PAGE, AGREE = 50, 0.5, 0.98, 0.99


def _both(src: DataFrame, md: DataFrame, counted) -> DataFrame:
    """(rel, page, token, a, b): how often a token stands on each side; counted in each text, then before the shuffle."""
    sides = [
        d.select("rel", "page", F.inline(counted("text"))).select(
            "rel",
            "page",
            "token",
            *[(F.col("times") if i == k else F.lit(0).cast("long")).alias(c) for k, c in enumerate("xy")]
        ) for i, d in enumerate((src, md))
    ]
    return sides[0].unionByName(sides[1]).groupBy("rel", "page", "token").agg(F.sum("x").alias("a"), F.sum("y").alias("b"))


def characters(c: str) -> Column:
    """The different letters of a text, each with how often it stands there: a row a letter of the alphabet, not of the text."""
    times = lambda t, x: (F.length(t) - F.length(F.replace(t, x, F.lit("")))).cast("long")
    return text.once(text.letters(c), lambda t: F.transform(F.array_distinct(F.split(t, "")), lambda x: F.struct(x.alias("token"), times(t, x).alias("times"))))


@F.pandas_udf(ArrayType(StringType()))
def unexplained(missing: pd.Series, spare: pd.Series) -> pd.Series:
    """Numbers that are missing on a page and not explained by one that only the Markdown has.

    Two missing numbers explain each other where the Markdown has them as one (`120/120/1`, `20`); the parts of a decimal where it
    has the decimal. Both sides are lists with repeats. Only pages with missing numbers come here.
    """

    def one(lost, only) -> list[str]:
        left, free = Counter(lost), Counter(only)
        for whole in sorted(free):
            for k in range(1, len(whole)):
                a, b = whole[:k], whole[k:]
                times = min(free[whole], left[a] // 2 if a == b else min(left[a], left[b]))
                if times > 0:
                    left[a] -= times
                    left[b] -= times
                    free[whole] -= times
        for whole in sorted(free):
            need = Counter(whole.replace(",", ".").split("."))
            if len(whole.replace(",", ".").split(".")) > 1:
                times = min([free[whole], *(left[p] // n for p, n in need.items())])
                for p, n in need.items():
                    left[p] -= n * max(times, 0)
        return sorted(left.elements())

    return pd.Series([one(m, s) for m, s in zip(missing, spare, strict=True)], dtype="object")


def check_pages(src: DataFrame, md: DataFrame, explain: bool = True) -> DataFrame:
    """src, md(rel, page, text) to a row for each source page: n, lost, extra characters, numbers, missing numbers, in_md.

    Without `explain` every number counts that the Markdown has less often than the source, whatever else it has in place of it.
    """
    # both texts of a page meet once; what they hold is counted in the row
    whole = lambda d, c: d.groupBy("rel", "page").agg(F.array_join(F.collect_list("text"), "\n").alias(c))
    met = whole(src, "__s").join(whole(md, "__m"), ["rel", "page"], "left")
    rows = met.select("rel", "page", F.col("__m").isNotNull().alias("in_md"), _chars("__s", "__m").alias("c"), text.plain_numbers("__s").alias("s"), text.plain_numbers("__m").alias("m"))
    repeated = lambda lost: F.coalesce(F.flatten(F.transform(lost, lambda x: F.array_repeat(x["token"], x["missing"].cast("int")))), F.array().cast("array<string>"))
    differ = lambda a, b: lost_tokens(F.when(F.col("s") != F.col("m"), F.col(a)), F.when(F.col("s") != F.col("m"), F.col(b)))
    told = rows.withColumn("gone", repeated(differ("s", "m")))
    missing = F.array_sort("gone")
    if explain:
        told = told.withColumn("spare", repeated(differ("m", "s")))
        missing = F.when(F.size("gone") > 0, unexplained("gone", "spare")).otherwise(F.array().cast("array<string>"))
    return told.select("rel", "page", "in_md", "c.n", "c.lost", "c.extra", F.size("s").cast("long").alias("numbers"), missing.alias("missing"))


def _chars(a: str, b: str) -> Column:
    """struct of letters in a, of those that b has less often, and of those that b has more often."""
    zero = F.lit(0).cast("long")
    times = lambda t, x: (F.length(t) - F.length(F.replace(t, x, F.lit("")))).cast("long")
    each = lambda t: F.transform(F.array_distinct(F.split(F.concat(t["a"], t["b"]), "")), lambda x: F.struct(times(t["a"], x).alias("a"), times(t["b"], x).alias("b")))

    def add(acc, x):
        return F.struct(
            (acc["n"] + x["a"]).alias("n"),
            (acc["lost"] + F.greatest(x["a"] - x["b"], zero)).alias("lost"),
            (acc["extra"] + F.greatest(x["b"] - x["a"], zero)).alias("extra"),
        )

    counts = text.once(F.struct(text.letters(a).alias("a"), text.letters(b).alias("b")), each)
    return F.aggregate(counts, F.struct(zero.alias("n"), zero.alias("lost"), zero.alias("extra")), add)


def report(pages: DataFrame, most: int | None = LISTED) -> DataFrame:
    """A2: pages of check_pages to (rel, report): the checks of a document with at most `most` examples each (None: all) in page order, and
    its status."""
    recall = (F.col("n") - F.col("lost")) / F.nullif("n", F.lit(0))
    every = lambda cond, *cols: F.sort_array(F.collect_list(F.when(cond, F.struct(*cols))))
    listed = lambda cond, *cols: every(cond, *cols) if most is None else F.slice(every(cond, *cols), 1, most)
    page = F.col("page").cast("long").alias("page")
    wide = F.col("extra") > F.greatest(F.lit(EXTRA_CHARS), EXTRA_SHARE * F.col("n"))
    rolled = pages.groupBy("rel").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sort_array(F.collect_list(F.when(~F.col("in_md"), F.col("page").cast("long")))).alias("missing"),
        F.sum("n").alias("chars"),
        F.round((F.sum("n") - F.sum("lost")) / F.nullif(F.sum("n"), F.lit(0)), 6).alias("chars_recall"),
        listed((recall < RECALL), page, F.round(recall, 4).alias("recall"), F.col("lost")).alias("low"),
        listed(wide, page, F.col("extra").alias("chars")).alias("extra"),
        F.round((F.sum("numbers") - F.sum(F.size("missing"))) / F.nullif(F.sum("numbers"), F.lit(0)), 6).alias("numbers_recall"),
        listed(F.size("missing") > 0, page, F.slice("missing", 1, ITEMS).alias("items")).alias("number_pages"),
    )
    ok = (F.size("missing") == 0) & (F.coalesce("chars_recall", F.lit(1.0)) >= RECALL) & (F.size("extra") == 0) & (F.size("number_pages") == 0)
    return rolled.select("rel", F.struct(*[c for c in rolled.columns if c != "rel"], F.when(ok, "PASS").otherwise("FAIL").alias("status")).alias("report"))


def agreement(src: DataFrame, second: DataFrame) -> DataFrame:
    """A2: a second reader's characters by document: recall without pages that it cannot read at all, those pages, and the low ones."""
    chars = _both(src, second, characters).groupBy("rel", "page").agg(F.sum("a").alias("n"), F.sum(F.least("a", "b")).alias("hit"))
    rate = F.col("hit") / F.nullif("n", F.lit(0))
    blind = (F.col("n") > BLIND_CHARS) & (rate < BLIND_RECALL)
    seen = chars.withColumn("blind", F.coalesce(blind, F.lit(False)))
    low = ~F.col("blind") & (F.col("n") > BLIND_CHARS) & (rate < AGREE_PAGE)
    total = seen.groupBy("rel").agg(
        F.sum(F.when(~F.col("blind"), F.col("hit"))).alias("h"),
        F.sum(F.when(~F.col("blind"), F.col("n"))).alias("t"),
        F.count_if("blind").alias("blind_pages"),
        F.count_if(low).alias("low_pages"),
    )
    rated = total.withColumn("agreement", F.coalesce(F.round(F.col("h") / F.nullif("t", F.lit(0)), 6), F.lit(1.0)))
    return rated.select("rel", "agreement", "blind_pages", "low_pages", (F.col("agreement") >= AGREE).alias("ok"))


def blocks(line: Column) -> Column:
    """The cells of a table line, null for other lines and for the rule under a head. Escaped bars stay in their cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return F.when(F.trim(line).rlike(r"^\|.*\|$") & ~F.trim(line).rlike(r"^\|[\s:|-]+\|$"), cells)

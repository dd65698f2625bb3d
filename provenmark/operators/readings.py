"""Independent readings of the same page: corrections, votes, choices by a glossary, summaries."""

from __future__ import annotations

import bisect
import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

ACCEPT, CONFIDENT, SURE, MOST_EDITS, CONTEXT_WORDS = 0.995, 0.90, 0.9, 2, 8
# Letters mistaken for digits, units that may follow a number, ligatures, marks that compare equal.
LETTERS, DIGITS = "OolISBZ", "0011582"
UNIT = r"(?:mm|cm|km|kg|kN|kPa|MPa|Pa|kW|Hz|mL|m|N|W|V|L|%)"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
TYPED, PLAIN = "“”„‘’–", "\"\"\"''—"
#: Places of a word in the other reading, on average, from which all of them are looked at together.
DENSE = 40
LOG = "array<struct<rule:string,from:string,to:string>>"
#: Corrections in their order: (rule, pattern, what a match becomes).
CORRECTIONS = (
    ("confusable_in_number", rf"(?<=\d)[{LETTERS}]+(?=\d)", lambda m: F.translate(m, LETTERS, DIGITS)),
    ("confusable_in_number", rf"(?<![A-Za-z\d])(?:[{LETTERS}]?\d[\d.,]*[{LETTERS}]?|[{LETTERS}]\d*)(?=\s?{UNIT}\b)", lambda m: F.when(m.rlike(r"\d"), F.translate(m, LETTERS, DIGITS)).otherwise(m)),
    ("si_prefix_case", r"\d\s?K(?:N|Pa|g|m|W|Hz|J|V)\b", lambda m: F.replace(m, F.lit("K"), F.lit("k"))),
    ("clause_id_dollar", r"\$\d{1,2}[A-Z]\d+[a-z]?\b", lambda m: F.concat(F.lit("S"), F.substring(m, 2, 1000))),
    ("line_break_hyphen", r"[a-z]{2,}-\n[a-z]{2,}", lambda m: F.replace(m, F.lit("-\n"), F.lit(""))),
)


def engine_summary(rows: DataFrame, engine: str, conf: str, size: str) -> DataFrame:
    """Mean, worst and length-weighted confidence of each engine."""
    return rows.groupBy(engine).agg(
        F.round(F.avg(conf), 9).alias("mean_conf"),
        F.min(conf).alias("worst"),
        F.round(F.sum(F.col(conf) * F.col(size)) / F.sum(size), 9).alias("weighted"),
    )


def page_confidence(lines: DataFrame) -> DataFrame:
    """lines(rel, page, text, conf) to documents: length-weighted confidence, pages in doubt, and whether some pages have no text.

    Confidences count in whole millionths and are rounded once, half up, so their mean does not hang on the order of the sums."""
    size = F.length("text").cast("decimal(18,0)")
    page = lines.groupBy("rel", "page").agg(F.sum(F.round(F.col("conf") * 1_000_000).cast("decimal(9,0)") * size).alias("sum"), F.sum(size).alias("size"))
    mean = lambda total, n: F.expr(f"CASE WHEN {n} > 0 THEN ((2 * {total} + {n}) DIV (2 * {n})) / 1e6D END")
    page = page.select("rel", "sum", "size", mean("sum", "size").alias("conf"))
    low, none = F.count_if(F.col("conf") < CONFIDENT).alias("low_pages"), (F.count_if(F.col("size") == 0) > 0).alias("partial")
    return page.groupBy("rel").agg(
        F.sum("sum").alias("sum"), F.sum("size").alias("size"), low, none,
    ).select("rel", mean("sum", "size").alias("conf"), "low_pages", "partial")


def correct_text(c: str) -> Column:
    """Struct of text and log(rule, from, to): letters inside numbers and at the edge of numbers before a unit, ligatures, the
    case of SI prefixes, clause ids with a dollar, words broken over a line. Everything else stays."""
    log = F.array().cast(LOG)
    now = F.coalesce(F.col(c), F.lit(""))
    for one, two in LIGATURES:
        log = F.concat(
            log,
            F.when(
                F.contains(now, F.lit(one)),
                F.array(F.struct(F.lit("ligature").alias("rule"), F.lit(one).alias("from"), F.lit(two).alias("to"))),
            ).otherwise(F.array().cast(LOG)),
        )
        now = F.replace(now, F.lit(one), F.lit(two))
    state = F.struct(now.alias("text"), log.alias("log"))
    for rule, pattern, change in CORRECTIONS:
        state = F.get(F.transform(F.array(state), _correction(rule, pattern, change)), F.lit(0))  # a one-row array computes what stands above once
    return state


def _correction(rule: str, pattern: str, change):
    def step(s: Column) -> Column:
        was = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))
        pairs = F.transform(was, lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("from"), change(m).alias("to")))
        return F.when(~s["text"].rlike(pattern), s).otherwise(text.once(pairs, lambda found: changed(s, found)))

    def changed(s: Column, found: Column) -> Column:
        now = F.array_join(F.zip_with(F.split(s["text"], pattern, -1), found, lambda p, x: F.concat(p, F.coalesce(x["to"], F.lit("")))), "")
        return F.struct(now.alias("text"), F.concat(s["log"], F.filter(found, lambda x: x["from"] != x["to"])).alias("log"))

    return step


def typed(c: Column) -> Column:
    """Typographic variants of a mark compare equal."""
    return F.replace(F.translate(c, TYPED, PLAIN), F.lit("--"), F.lit("—"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(typed(F.coalesce(c, F.lit(""))), F.lit(r"\S+"), F.lit(0))


class _Aligned(difflib.SequenceMatcher):
    """SequenceMatcher without junk, with the same blocks. A search within a stretch of b begins at that stretch, and no block in a stretch is
    longer than the one that the stretch was cut off by, so the first of that length ends it. The library's own goes through all
    places of all words each time, which takes seconds on a line of thousands of words that repeat themselves."""

    def __init__(self, a: list[str], b: list[str]):
        self._longest: dict[tuple, int] = {}
        super().__init__(None, a, b, autojunk=False)
        self._dense = sum(len(self.b2j.get(x, ())) for x in a) > DENSE * len(a)
        self._places = {x: np.array(at, dtype=np.int64) for x, at in self.b2j.items()} if self._dense else {}

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        i, j, k = (self._by_rows if self._dense else self._first_longest)(alo, ahi, blo, bhi, min(ahi - alo, bhi - blo, self._longest.pop((alo, ahi, blo, bhi), ahi)))
        self._longest[alo, i, blo, j] = self._longest[i + k, ahi, j + k, bhi] = k
        return difflib.Match(i, j, k)

    def _first_longest(self, alo: int, ahi: int, blo: int, bhi: int, longest: int) -> tuple[int, int, int]:
        best_i, best_j, best, runs = alo, blo, 0, {}
        for i in range(alo, ahi if longest else alo):
            now, places = {}, self.b2j.get(self.a[i], ())
            for at in range(bisect.bisect_left(places, blo), len(places)):
                j = places[at]
                if j >= bhi:
                    break
                k = now[j] = runs.get(j - 1, 0) + 1
                if k > best:
                    best_i, best_j, best = i - k + 1, j - k + 1, k
                    if k == longest:
                        return best_i, best_j, best
            runs = now
        return best_i, best_j, best

    def _by_rows(self, alo: int, ahi: int, blo: int, bhi: int, longest: int) -> tuple[int, int, int]:
        """The same, where a word has many places: all places of a word of a at once."""
        best_i, best_j, best = alo, blo, 0
        runs, now, was, none = np.zeros(bhi - blo + 1, np.int64), np.zeros(bhi - blo + 1, np.int64), (), np.zeros(0, np.int64)
        for i in range(alo, ahi if longest else alo):
            at = self._places.get(self.a[i], none)
            at = at[np.searchsorted(at, blo) : np.searchsorted(at, bhi)] - blo
            size = runs[at] + 1  # the run that ends at j stands at j + 1
            now[at + 1] = size
            if len(at) and (k := int(size.max())) > best:
                j = int(at[size.argmax()]) + blo
                best_i, best_j, best = i - k + 1, j - k + 1, k
                if k == longest:
                    break
            if len(was):
                runs[was] = 0
            runs, now, was = now, runs, at + 1
        return best_i, best_j, best


def _blocks(a: list[str], b: list[str]):
    return _Aligned(a, b).get_opcodes()


def _straight(a: list[str], b: list[str]):
    """Like _blocks, but readings of as many words stand word against word unless longest blocks have more words alike: where a line
    repeats itself, those may lose some."""
    if len(a) != len(b):
        return _blocks(a, b)
    alike = [x == y for x, y in zip(a, b, strict=True)]
    most = (Counter(a) & Counter(b)).total()  # no alignment has more
    if sum(alike) < most:
        found = _blocks(a, b)
        if sum(alike) < sum(j - i for op, i, j, _, _ in found if op == "equal"):
            return found
    ends = [i for i in range(1, len(a)) if alike[i] != alike[i - 1]]
    runs = zip([0, *ends], [*ends, len(a)], strict=True) if a else ()
    return [("equal" if alike[i] else "replace", i, j, i, j) for i, j in runs]


def agreement(a: Column, b: Column) -> Column:
    """V1: struct(same, diffs) of two word lists: words read alike, where spans that differ in spacing only are alike, and the other
    spans. Lists that are equal never leave the JVM."""

    @F.pandas_udf("same long, diffs array<struct<a:string,b:string>>")
    def compared(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        same, diffs = [], []
        for x, y in zip(left, right, strict=True):
            x, y, alike, other = list(x), list(y), 0, []
            for op, i, j, k, m in _straight(x, y):
                if op == "equal" or "".join(x[i:j]) == "".join(y[k:m]):
                    alike += max(j - i, m - k)
                else:
                    other.append({"a": " ".join(x[i:j]), "b": " ".join(y[k:m])})
            same.append(alike)
            diffs.append(other)
        return pd.DataFrame({"same": same, "diffs": diffs})

    return F.when(
        a == b,
        F.struct(F.size(a).cast("long").alias("same"), F.array().cast("array<struct<a:string,b:string>>").alias("diffs")),
    ).otherwise(compared(a, b))


def vote(pairs: DataFrame) -> DataFrame:
    """V1: (rel, page, a, b, conf), null for a reading that is missing, to the share of equal words of the longer reading, how many spans
    differ, and the decision."""
    rated = pairs.withColumns({"__a": words(F.col("a")), "__b": words(F.col("b"))})
    rated = rated.withColumn("__r", agreement(F.col("__a"), F.col("__b")))
    share = F.when((F.size("__a") == 0) & (F.size("__b") == 0), 1.0).otherwise(
        F.least(F.lit(1.0), F.col("__r.same") / F.greatest(F.size("__a"), F.size("__b")))
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    good = both & (share >= ACCEPT) & (F.col("conf") >= CONFIDENT) & (F.size("__a") > 0)
    return rated.select(
        "rel",
        "page",
        F.when(both, F.round(share, 4)).alias("agreement"),
        F.size("__r.diffs").alias("spans"),
        F.when(good, "ok").otherwise("review").alias("decision"),
    )


def core(c: Column) -> Column:
    """A word without the marks around it."""
    return F.regexp_replace(c, r"(?U)^\W+|\W+$", "")


def replaced_words(pairs: DataFrame, straight: bool = False) -> DataFrame:
    """Words that stand against one another in spans of equal length: (rel, page, at_a, at_b, a, b). Only rows whose readings differ leave the
    JVM. With `straight`, readings of as many words stand word against word where that loses none."""
    blocks = _straight if straight else _blocks

    @F.pandas_udf("array<struct<at_a:int,at_b:int,a:string,b:string>>")
    def swapped(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x, y):
            return [
                {
                    "at_a": i + d, "at_b": k + d, "a": x[i + d], "b": y[k + d],
                } for op, i, j, k, m in blocks(list(x), list(y)) if op == "replace" and j - i == m - k for d in range(j - i)
            ]

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype="object")

    split = pairs.select(
        "rel",
        "page",
        F.regexp_extract_all("a", F.lit(r"\S+"), F.lit(0)).alias("x"),
        F.regexp_extract_all("b", F.lit(r"\S+"), F.lit(0)).alias("y"),
    )
    return split.where("x <> y").select("rel", "page", F.inline(swapped("x", "y")))


def by_glossary(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """V2: pairs(rel, page, a, b) and known(word) to the words that change: (rel, page, engine, at, was, now).

    A word changes only where its counterpart is known and it is not, both have three letters or more and no digit, and they are
    two edits apart at most. The glossary is a table: words meet it by a join, whatever its size.
    """
    met = replaced_words(pairs).withColumns({"ca": core(F.col("a")), "cb": core(F.col("b"))})
    near = (F.col("ca") != F.col("cb")) & (
        F.least(F.length("ca"), F.length("cb")) >= 3
    ) & ~F.concat("ca", "cb").rlike(r"\d") & (F.levenshtein("ca", "cb") <= MOST_EDITS)
    one = lambda c, name: known.select(F.col("word").alias(c), F.lit(True).alias(name))
    told = met.where(near).join(one("ca", "ka"), "ca", "left").join(one("cb", "kb"), "cb", "left")
    ka, kb = F.coalesce("ka", F.lit(False)), F.coalesce("kb", F.lit(False))
    put = lambda word, old, new: F.concat(F.substring(word, F.lit(1), F.instr(word, old) - 1), new, F.substring(word, F.instr(word, old) + F.length(old), F.length(word)))
    b = F.struct(F.lit("b").alias("engine"), F.col("at_b").alias("at"), F.col("b").alias("was"), put(F.col("b"), F.col("cb"), F.col("ca")).alias("now"))
    a = F.struct(F.lit("a").alias("engine"), F.col("at_a").alias("at"), F.col("a").alias("was"), put(F.col("a"), F.col("ca"), F.col("cb")).alias("now"))
    return told.where(ka != kb).select("rel", "page", F.when(ka, b).otherwise(a).alias("x")).select("rel", "page", "x.*")


def adoptable(answers: DataFrame, known: DataFrame) -> DataFrame:
    """V5: answers(…, candidates, in_text, choice, confidence, needs_human) that may be taken over without a person: two readings of plain
    text, a sure choice, and the glossary knows the chosen word and not the other one."""
    two = answers.where(
        (F.size("candidates") == 2) & F.col("choice").isin(0, 1) & ~F.coalesce("needs_human", F.lit(False)) & (F.col("confidence") >= SURE) & F.col("in_text").isNotNull() & ~F.array_join("candidates", "").rlike(r"\d")
    )
    words_ = two.withColumns({"chosen": core(F.get("candidates", F.col("choice"))), "other": core(F.get("candidates", 1 - F.col("choice")))})
    return words_.join(
        known.select(F.col("word").alias("chosen")),
        "chosen",
        "left_semi",
    ).join(known.select(F.col("word").alias("other")), "other", "left_anti").drop("other")


def context_of(text: Column, candidates: list[Column]) -> Column:
    """struct(found, before, after): the first candidate that a text holds as a word, with eight words on each side."""
    found = F.lit(None).cast("struct<found:string,before:string,after:string>")
    for c in reversed(candidates):
        pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), c, F.lit(r"\E(?!\w)"))
        at = F.regexp_instr(text, pattern)
        left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(c), F.length(text))
        before = F.array_join(F.reverse(F.slice(F.reverse(F.filter(F.split(left, r"\s+"), lambda x: x != "")), 1, CONTEXT_WORDS)), " ")
        after = F.array_join(F.slice(F.filter(F.split(right, r"\s+"), lambda x: x != ""), 1, CONTEXT_WORDS), " ")
        found = F.when(at > 0, F.struct(c.alias("found"), before.alias("before"), after.alias("after"))).otherwise(found)
    return found

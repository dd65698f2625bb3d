"""Column functions on texts: normal forms, tokens, numbers, counts, Markdown marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks as Python's splitlines() sees them.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
# Patterns and marks whose results must match.
NUMBER_UNIT = r"(?iU)[-+]?\d+(?:[.,]\d+)*\s*(?:mm|cm|m|km|kPa|MPa|Pa|°C|C|kW|MW|V|A|mA|mL|L/s|L|Hz|kHz|MHz|%|s|ms|N|kN|Nm|kg|t)?"
THOUSANDS = r"^\d{1,3}(?:,\d{3})+$"
PLAIN_NUMBER = r"\d+(?:[.,]\d+)*"
LEAD_MARKS = r"^(?:(?:#{1,6}\s)|(?:>\s)|(?:[-*+]\s)|(?:\d{1,3}\.\s))+"
PAIRED_MARKS = r"(\*\*|~~|\*)(?=\S)(.+?)(?<=\S)\1"
SALVAGE_MARKS = ("parser: salvage", "salvage:001", "字符串打捞", "low_confidence,salvage")
CJK = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af]"
NOISE = r"^[\d\s.\-–—_/·•…]*$", r"(?i)^(?:page\s*)?\d+(?:\s*/\s*\d+)?页?$"
LEADER, LABELLED = r"[.·•]\s{2,}", r"^([A-Za-z][A-Za-z\- ]{0,20}):\s*(.+)$"
#: Unicode category Zs.
SPACE_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LATIN_WORD = r"[A-Za-z0-9]+(?:[.,'\-][A-Za-z0-9]+)*"


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(value: Column, then) -> Column:
    """then(value), where the value is computed once however often `then` names it: Spark shares nothing inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def split_lines(c) -> Column:
    """P-lines: as splitlines(): no empty item after a final break."""
    return once(F.split(_text(c), LINE_BREAK), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def normalize_line(c) -> Column:
    """White space folded, trimmed, lower case; null is empty."""
    t = _text(c)
    # most lines have single blanks only; a search without a hit is far cheaper than replacing each of them by itself
    folded = F.when(t.rlike(r"(?U)[\s&&[^ ]]|  "), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t)
    return F.lower(F.trim(folded))


def strip_lead(c) -> Column:
    """Leading list, quote and heading marks."""
    return F.regexp_replace(_text(c), LEAD_MARKS, "")


def strip_markup(line: Column) -> Column:
    """One trimmed line without lead marks, paired emphasis (not next to a backtick), table bars."""

    def plain(s):
        return F.when(F.contains(s, F.lit("`")) | ~s.rlike(r"\*|~~"), s).otherwise(F.regexp_replace(s, PAIRED_MARKS, "$2"))

    def unbarred(s):
        cells = F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
        return F.trim(F.when(F.contains(s, F.lit("|")), F.trim(F.regexp_replace(F.array_join(cells, " "), r"(?U)\s+", " "))).otherwise(s))

    return once(once(F.regexp_replace(line, r"(?U)" + LEAD_MARKS, ""), plain), unbarred)


def strip_md_artifacts(c) -> Column:
    """Markdown without front matter, comments, standard-id lines, table rules and fences; fenced lines stay verbatim.

    A line lies in a fence if an odd number of fences stands before it; that is told inside the row, without window or shuffle. Lines are
    split, trimmed and searched for fences once a text, not once a line.
    """
    t = F.regexp_replace(_text(c), r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?m)^>\s*标准标识.*$", "")

    bare = lambda raw: F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")

    def parted(lines):
        trimmed = F.transform(lines, bare)
        return once(F.transform(trimmed, lambda s: F.struct(s.alias("s"), s.rlike(r"^(`{3,}|~{3,})").alias("fence"))), lambda rows: told(lines, rows))

    def told(lines, rows):
        fences = F.array_compact(F.transform(rows, lambda x, i: F.when(x["fence"], i)))
        # the lines up to each fence, that one included, then the rest: runs outside and inside by turns
        upto = F.concat(F.transform(fences, lambda p: p + 1), F.array(F.size(rows)))
        runs = lambda ends: F.flatten(F.transform(ends, lambda end, k: F.array_repeat(k % 2 == 1, end - F.when(k > 0, F.get(ends, k - 1)).otherwise(0))))
        inside = once(upto, runs)
        return F.zip_with(F.zip_with(lines, rows, lambda raw, x: F.struct(raw.alias("raw"), x.alias("x"))), inside, line)

    def line(row, inside):
        raw, s = row["raw"], row["x"]["s"]
        clean = once(strip_markup(s), lambda c: F.when(s.rlike(r"^\|?[\s:\-|]+\|[\s:\-|]*$") | (c == ""), None).otherwise(c))
        return F.when(row["x"]["fence"], None).when(inside, raw).otherwise(clean)

    return F.when(_text(c) == "", F.lit("")).otherwise(F.array_join(F.array_compact(once(split_lines(t), parted)), "\n"))


def md_is_salvage(c) -> Column:
    """One of four marks in the first 2000 characters."""
    head = F.substring(_text(c), 1, 2000)
    found = F.lit(False)
    for mark in SALVAGE_MARKS:
        found = found | F.contains(head, F.lit(mark))
    return found


def extract_numbers(c) -> Column:
    """Array of number tokens with unit; `1,000` is a thousand, any other comma a decimal point."""

    def token(raw):
        # most tokens hold no white space, and a lambda would work out again what it names twice
        bare = F.when(raw.rlike(r"(?U)\s"), F.regexp_replace(raw, r"(?U)\s+", "")).otherwise(raw)
        return once(F.lower(bare), lambda tok: once(F.regexp_extract(tok, r"(?U)^[+-]?\d+(?:[.,]\d+)*", 0), lambda head: joined(tok, head)))

    def joined(tok, head):
        whole = F.when(head.rlike(THOUSANDS), F.replace(head, F.lit(","), F.lit(""))).otherwise(F.replace(head, F.lit(","), F.lit(".")))
        return F.when(F.contains(head, F.lit(",")), F.concat(whole, F.substring(tok, F.length(head) + 1, F.length(tok)))).otherwise(tok)

    return F.transform(F.regexp_extract_all(_text(c), F.lit(NUMBER_UNIT), F.lit(0)), token)


def plain_numbers(c) -> Column:
    """P5."""
    return F.regexp_extract_all(_text(c), F.lit(PLAIN_NUMBER), F.lit(0))


def word_tokens(c) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def letters(c) -> Column:
    """The alphanumeric characters of the lower-cased text, as one string."""
    return F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}]", "")


def count_text(c) -> Column:
    """Struct of chars, words, cjk, latin."""
    cjk, latin = F.regexp_count(_text(c), F.lit(CJK)), F.regexp_count(_text(c), F.lit(LATIN_WORD))
    chars = F.length(F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", ""))
    return F.struct(chars.alias("chars"), (cjk + latin).alias("words"), cjk.alias("cjk"), latin.alias("latin"))


def _repeats(line: Column) -> Column:
    """Whether a line has over 6 tokens, one of them 4 times or more; its tokens are sorted once."""
    four = lambda toks: F.exists(F.zip_with(toks, F.slice(toks, 4, F.size(toks)), lambda t, u: t == u), lambda x: F.coalesce(x, F.lit(False)))
    return once(F.array_sort(F.split(line, r"[ \t\n\f\r]+")), lambda toks: (F.size(toks) > 6) & four(toks))


def dup_ratio(c) -> Column:
    """Share of lines with text that have over 6 tokens, one of them 4 times or more."""
    lines = F.filter(F.transform(split_lines(c), lambda x: F.trim(x)), lambda x: x != "")
    return once(lines, lambda ls: F.when(F.size(ls) == 0, F.lit(0.0)).otherwise(F.size(F.filter(ls, _repeats)) / F.size(ls)))


def dup_lines(c) -> Column:
    """P9 of a part of a document: struct(lines, bad), how many lines have text and how many of them count in dup_ratio(). Lines end at line
    feeds alone; space separators of any kind at their ends are not text."""
    lines = F.filter(F.transform(F.split(_text(c), "\n"), lambda x: F.btrim(x, F.lit(SPACE_SEPARATORS))), lambda x: x != "")
    return once(lines, lambda ls: F.struct(F.size(ls).alias("lines"), F.size(F.filter(ls, _repeats)).alias("bad")))


def cell_key(c) -> Column:
    """P18."""
    return F.regexp_replace(F.lower(_text(c)), "[^0-9a-z]", "")


def clean_text(c) -> Column:
    """P10: odd spaces to blanks, ligatures to letters."""
    s = F.regexp_replace(_text(c), "[\u00a0\u2000-\u200a\u202f\u205f\u3000]", " ")
    for one, two in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        s = F.replace(s, F.lit(one), F.lit(two))
    return s


def audit_form(c) -> Column:
    """A line without white space and the marks of tables, lists and headings, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_text(c), r"[|`*_>#-]+", " "), r"(?U)\s+", ""))


def is_noise(c, least: int = 12) -> Column:
    """Lines that say nothing: short ones, numbers and rules, leaders of a contents list, page numbers."""
    t = F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")
    leaders = F.regexp_count(t, F.lit(LEADER)) > 2
    return (F.length(t) < least) | t.rlike(NOISE[0]) | leaders | t.rlike(NOISE[1])


def audit_variants(c) -> Column:
    """`Label: value` also counts as the value or the label alone."""
    t = F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")
    return F.array_distinct(
        F.filter(
            F.array(audit_form(c), audit_form(F.regexp_extract(t, LABELLED, 2)), audit_form(F.regexp_extract(t, LABELLED, 1))),
            lambda x: x != "",
        )
    )

"""Column functions that write Markdown: unit markers, tables, front matter after a decision, formulas, notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .names import body_of, front_lines
from .text import once

# Marks whose text must match.
UNIT_CLOSE = "<!-- /unit -->"
UNREADABLE = "⚠️ [unreadable formula]"
FIGURE_NOTICE = "> **Figure.** This page has a figure that is not reproduced here."
UNIT = r"(?s)<!-- unit: p\d+ \| src: p\.(\d+)[^>]*-->\n\n(.*?)\n\n<!-- /unit -->"
INSTRUCTION = r"(?i)ignore (?:all )?(?:the )?(?:previous|above) instructions|you are an? (?:ai|assistant)|as an ai"
#: The same as whole words: `pas an ai...` says nothing to an assistant.
INSTRUCTION_WORDS = rf"(?i)\b(?:{INSTRUCTION.removeprefix('(?i)')})\b"
LICENCE_MARKS = ("licensed to", "licenced to")


def unit_flags(body: Column) -> Column:
    """`-` or the flags that the text itself calls for."""
    found = F.array_compact(F.array(F.when(F.contains(body, F.lit(UNREADABLE)), "unreadable_formula"), F.when(body.rlike(INSTRUCTION_WORDS), "instruction_like")))
    return F.when(F.size(found) == 0, "-").otherwise(F.array_join(found, ","))


def unit(page: Column, body: Column, printed: Column | None = None) -> Column:
    """A page's text between its markers."""
    shown = F.lit("") if printed is None else F.when(printed.isNotNull(), F.concat(F.lit(" | printed: "), printed)).otherwise("")
    head = F.concat(
        F.lit("<!-- unit: p"), F.lpad(page.cast("string"), 4, "0"), F.lit(" | src: p."), page.cast("string"), shown,
        F.lit(" | chars: "), F.length(body).cast("string"), F.lit(" | flags: "), unit_flags(body), F.lit(" -->"),
    )
    return F.concat(head, F.lit("\n\n"), body, F.lit(f"\n\n{UNIT_CLOSE}"))


def table(rows: Column) -> Column:
    """Array of rows of cells as a Markdown table: short rows padded, bars escaped, empty rows out; the first row is the head."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))

    def line(r: Column) -> Column:
        cells = F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    lines = F.transform(kept, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    return F.when(F.size(kept) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000_000)), "\n"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _key(line: Column) -> Column:
    return F.when(F.contains(line, F.lit(":")), F.trim(F.substring_index(line, ":", 1))).otherwise("")


def accepted(text: Column, who: Column, when: Column, accuracy: Column, forced: Column) -> Column:
    """The front matter after a person's acceptance; a forced one says so. Texts without front matter stay as they are."""
    lines = F.filter(front_lines(text), lambda x: ~_key(x).isin("accepted_by", "accepted_at", "accuracy"))
    shown = F.coalesce(accuracy.cast("string"), F.lit("None"))
    said = F.concat(
        F.lit("verified: "),
        quoted(
            F.concat(
                F.lit("accepted by "),
                who,
                F.lit(" on "),
                when,
                F.lit(" at "),
                shown,
                F.lit("% accuracy (did not pass the automatic checks)"),
            )
        ),
    )
    lines = F.transform(
        lines,
        lambda x: F.when(
            forced & (_key(x) == "audit_status"),
            "audit_status: human_accepted",
        ).when(forced & (_key(x) == "verified"), said).otherwise(x),
    )
    added = F.array(
        F.concat(F.lit("accuracy: "), F.coalesce(accuracy.cast("string"), F.lit("null"))),
        F.concat(F.lit("accepted_by: "), quoted(who)),
        F.concat(F.lit("accepted_at: "), quoted(when)),
    )
    return F.when(front_lines(text).isNull(), text).otherwise(
        F.concat(F.lit("---\n"), F.array_join(F.concat(lines, added), "\n"), F.lit("\n---\n"), body_of(text))
    )


def without_acceptance(text: Column) -> Column:
    """What is compared with a live copy: the acceptance's own lines are dropped again."""
    kept = F.filter(front_lines(text), lambda x: ~_key(x).isin("accepted_by", "accepted_at", "accuracy", "verified", "audit_status"))
    return F.when(front_lines(text).isNull(), text).otherwise(F.concat(F.lit("---\n"), F.array_join(kept, "\n"), F.lit("\n---\n"), body_of(text)))


def reconverted(text: Column, engine: Column, name: Column, raw: Column) -> Column:
    """New body as a list of at most 5,000 lines under the kept front matter, whose parser, flags and status start anew."""
    kept = F.filter(F.coalesce(front_lines(raw), F.array().cast("array<string>")), lambda x: ~_key(x).isin("parser", "flags", "audit_status", "risk_score"))
    head = F.concat(
        kept,
        F.array(
            F.concat(F.lit("parser: "), engine),
            F.lit("flags: []"),
            F.lit("audit_status: pending_review"),
            F.lit("risk_score: 0"),
            F.concat(F.lit("reconvert_engine: "), engine),
        ),
    )
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 5000)
    return F.concat(
        F.lit("---\n"),
        F.array_join(head, "\n"),
        F.lit("\n---\n\n# "),
        name,
        F.lit("\n\n"),
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"),
        F.lit("\n"),
    )


def with_formulas(body: Column, approved: Column) -> Column:
    """The k-th unreadable mark becomes the k-th entry of approved (array of LaTeX, null where none); others stay."""
    parts = F.split(body, "\\Q" + UNREADABLE + "\\E")
    put = F.transform(
        F.slice(parts, 2, 1_000_000_000),
        lambda rest, i: F.concat(F.coalesce(F.concat(F.lit("$$"), F.get(approved, i), F.lit("$$")), F.lit(UNREADABLE)), rest),
    )
    return F.concat(F.get(parts, F.lit(0)), F.array_join(put, ""))


def with_figure_notice(body: Column, has_figure: Column) -> Column:
    """Once, at the end of the page's text."""
    return F.when(has_figure & ~F.contains(body, F.lit(FIGURE_NOTICE)), F.concat(F.rtrim(body), F.lit("\n\n" + FIGURE_NOTICE))).otherwise(body)


def formula_form(latex: Column) -> Column:
    """A formula without spaces and spacing commands."""
    return F.regexp_replace(F.coalesce(latex, F.lit("")), r"\s+|\\[,;:! ]", "")


def may_be_sent(link: Column, text: Column, prefixes: list[str]) -> Column:
    """The reason why a document may not be sent, null where it may."""
    source = F.lower(F.regexp_replace(F.trim(F.coalesce(link, F.lit(""))), "/+$", ""))
    known = F.lit(False)
    for p in prefixes:
        known = known | (source == p.lower()) | F.startswith(source, F.lit(p.lower() + "/"))
    low, marked = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for mark in LICENCE_MARKS:
        marked = marked | F.contains(low, F.lit(mark))
    return F.when(~known, "folder").when(marked, "licence").when(text.rlike(INSTRUCTION), "instruction")


ANSWER = "choice int, confidence double, reason string, needs_human boolean"


def checked_answer(raw: Column, candidates: Column) -> Column:
    """Struct of choice, text, confidence, needs_human; null where the answer is none of the candidates or no JSON. Digits need a person."""
    d = F.from_json(raw, ANSWER)
    choice = F.coalesce(d["choice"], F.lit(-1))
    valid = d.isNotNull() & ((choice == -1) | ((choice >= 0) & (choice < F.size(candidates))))
    digits = F.array_join(candidates, "").rlike(r"\d")
    confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(d["confidence"], F.lit(0.0)))), 2)
    picked = F.when(choice >= 0, F.get(candidates, choice))
    return F.when(
        valid,
        F.struct(
            F.when(choice >= 0, choice).alias("choice"),
            picked.alias("text"),
            confidence.alias("confidence"),
            (digits | F.coalesce(d["needs_human"], F.lit(False))).alias("needs_human"),
        ),
    )


def grounding_form(c: Column) -> Column:
    """P17 for texts in NFKC: dashes, quotes and odd spaces folded, emphasis and table bars blank, lower case."""
    t = F.translate(c, "–—‑−    ’‘“”", "----    ''\"\"")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"[*_|`]", " "), r"\s+", " ")))


@F.pandas_udf(StringType())
def nfkc(texts):  # noqa: ANN001, ANN201  pandas types come from Spark
    """Compatibility form; only Python's tables have it."""
    import unicodedata

    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def grounding(c: Column) -> Column:
    """ASCII texts never leave the JVM."""
    return grounding_form(F.when(c.rlike(r"[^\x00-\x7f]"), nfkc(c)).otherwise(c))


def grid(rows: Column, note_chars: int = 60) -> Column:
    """struct(grid, notes) of a table's rows of cells (null where a cell is merged into the one before).

    Empty rows go, full-width texts become notes, slash numbers that wrapped in a cell are joined, a head of two rows is merged with its
    spans filled, and what is left of null is empty.
    """
    wrapped = r"(\d+(?:/\d+)+)\n(\d{1,3})(?=\s|$)"
    none = F.lit(None).cast("string")
    cell = lambda c: F.when(~F.contains(c, F.lit("\n")), F.trim(c)).otherwise(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, wrapped, "$1$2"), wrapped, "$1$2"), r"\n", " ")))
    is_note = lambda r: (F.size(F.filter(r, lambda c: c.isNotNull())) == 1) & (F.length(F.coalesce(F.get(r, F.lit(0)), F.lit(""))) > note_chars)
    # a merged head cell reads as the last one before it
    spread = lambda r: F.transform(r, lambda c, j: F.coalesce(c, F.element_at(F.concat(F.array(F.lit("")), F.filter(F.slice(r, F.lit(1), j), lambda x: x.isNotNull())), -1)))
    join = lambda a, b: F.array_join(F.array_distinct(F.filter(F.array(a, b), lambda x: F.coalesce(x, F.lit("")) != "")), " — ")

    # each step names what stands above several times, so it is worked out once, not once a row and a name
    def padded(clean):
        return once(F.array_max(F.transform(clean, lambda r: F.size(r))), lambda width: F.transform(clean, lambda r: F.concat(r, F.array_repeat(none, width - F.size(r)))))

    def parted(rows_):
        return F.struct(F.filter(rows_, lambda r: ~is_note(r)).alias("body"), F.transform(F.filter(rows_, is_note), lambda r: F.get(r, F.lit(0))).alias("notes"))

    def headed(x):
        body = x["body"]
        two = (F.size(body) > 2) & F.exists(F.slice(F.get(body, F.lit(0)), 2, 10_000), lambda c: c.isNull())
        head = once(F.get(body, F.lit(0)), spread)
        whole = once(two, lambda t: F.struct(
            F.when(t, F.zip_with(head, once(F.get(body, F.lit(1)), spread), join)).otherwise(head).alias("head"),
            F.transform(F.slice(body, F.when(t, 3).otherwise(2), F.lit(1_000_000)), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))).alias("rest"),
        ))
        grid_ = once(whole, lambda w: F.concat(F.array(w["head"]), w["rest"]))
        return F.struct(F.when(F.size(body) > 0, grid_).otherwise(F.array().cast("array<array<string>>")).alias("grid"), x["notes"].alias("notes"))

    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    return once(once(once(clean, padded), parted), headed)

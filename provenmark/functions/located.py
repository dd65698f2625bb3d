"""Matches of patterns with their place and what stands around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

AROUND = 30
#: Stands around matches while a text is cut at them.
MARK = "\u0001"
# Text that is aimed at an assistant instead of a reader.
INSTRUCTIONS = (
    r"ignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|context)",
    r"disregard\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?)",
    r"(?:forget|override)\s+(?:all\s+|your\s+)?(?:previous|prior|earlier)?\s*(?:instructions?|rules?|guidelines)",
    r"you\s+are\s+now\s+(?:a|an|in)\b",
    r"new\s+instructions?\s*:",
    r"system\s+prompt",
    r"(?:reveal|print|show|output)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions)",
    r"do\s+not\s+(?:tell|inform|mention\s+to)\s+the\s+user",
    r"act\s+as\s+(?:if\s+you\s+(?:are|were)|an?\s+\w+\s+(?:assistant|model|AI))",
    r"as\s+an\s+AI\s+(?:language\s+)?(?:model|assistant)",
    r"<\s*/?\s*(?:system|assistant|instructions?)\s*>",
)


def located(c: str, patterns: tuple[str, ...] = INSTRUCTIONS, around: int = AROUND) -> Column:
    """array of struct(pattern, at, found, snippet) of all matches of any pattern, first come first served, in order: the pattern's number
    (from 1), the characters before the match, the match, and it with up to 30 characters on each side, blanks folded."""
    any_of = "(?iuU)" + "|".join(f"(?:{p})" for p in patterns)

    def pieces(text):
        """What is before, in and after matches by turns, from one search; a text that holds the mark itself is searched twice."""
        marked = F.split(F.regexp_replace(text, any_of, f"{MARK}$0{MARK}"), MARK, -1)
        found, gaps = F.regexp_extract_all(text, F.lit(any_of), F.lit(0)), F.split(text, any_of, -1)
        twice = once(found, lambda fs: F.flatten(F.zip_with(F.slice(gaps, 1, F.size(fs)), fs, lambda g, f: F.array(g, f))))
        return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(marked)

    def place(acc, piece):
        match = F.struct(acc["at"].alias("at"), piece.alias("found"))
        done = F.when(acc["match"], F.array_append(acc["done"], match)).otherwise(acc["done"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), (~acc["match"]).alias("match"), done.alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast("array<struct<at:int,found:string>>").alias("done"))
    which = lambda f: F.coalesce(*[F.when(f.rlike(f"(?iuU)^(?:{p})$"), F.lit(i)) for i, p in enumerate(patterns, 1)], F.lit(0))

    def told(text, m):
        first = F.greatest(m["at"] - around, F.lit(0))
        snippet = F.substring(text, first + 1, m["at"] + F.length(m["found"]) + around - first)
        return F.struct(
            which(m["found"]).alias("pattern"),
            m["at"].alias("at"),
            m["found"].alias("found"),
            F.trim(F.regexp_replace(snippet, r"(?U)\s+", " ")).alias("snippet"),
        )

    return once(F.coalesce(F.col(c), F.lit("")), lambda text: F.transform(F.aggregate(pieces(text), start, place)["done"], lambda m: told(text, m)))

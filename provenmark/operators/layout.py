"""Lines by their place on the page: running headers and footers, the body without them, printed page labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

BAND, LEAST_PAGES, LEAST_LETTERS, FRAGMENTS = 0.07, 4, 3, 3
# Fixed value: digits or roman numerals, alone or behind the word page.
PAGE_LABEL = r"(?i)^(?:page\s+)?((?:\d+|[ivxlcdm]+)(?:-\d+)?)$"


def running_form(c: str) -> Column:
    """A line as it compares across pages: odd blanks and ligatures plain, blanks folded, lower case, each number a mark."""
    return F.regexp_replace(text.normalize_line(text.clean_text(c)), r"(?U)\d+", "#")


def _banded(lines: DataFrame) -> DataFrame:
    """lines(doc, page, n, y0, y1, height, text) with key, y (whole), and whether they lie in the top or bottom band."""
    low = F.col("y1") > F.col("height") * (1 - BAND)
    return lines.withColumns(
        {
            "key": running_form("text"),
            "y": F.bround("y0").cast("int"),
            "bottom": low,
            "banded": (F.col("y0") < F.col("height") * BAND) | low,
        }
    )


def running_lines(lines: DataFrame) -> DataFrame:
    """(doc, key, y, pages) of lines(doc, page, n, y0, y1, height, text) in a band that stand at one height on four pages or more and
    have three letters or more. Three fragments on a line (within one unit of height) are the head of a table."""
    band = _banded(lines).where("banded")
    near = Window.partitionBy("doc", "page").orderBy("y").rangeBetween(-1, 1)  # a page's band
    alone = band.withColumn("fragments", F.count(F.lit(1)).over(near)).where(F.col("fragments") < FRAGMENTS)
    worded = alone.where(F.length(F.regexp_replace("key", r"\P{L}", "")) >= LEAST_LETTERS)
    return worded.select("doc", "key", "y", "page").distinct().groupBy("doc", "key", "y").agg(
        F.count(F.lit(1)).alias("pages")
    ).where(F.col("pages") >= LEAST_PAGES)


def body_and_labels(lines: DataFrame) -> DataFrame:
    """Lines with `kept`, false for running lines at their height or one unit beside it and for the page's bare number in the bottom
    band, and `label`, the printed label that a removed line of the bottom band gives."""
    running = running_lines(lines).select(
        "doc",
        "key",
        F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"),
    ).distinct().withColumn("runs", F.lit(True))
    told = _banded(lines).join(running, ["doc", "key", "y"], "left")
    plain = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    runs = F.col("banded") & F.coalesce("runs", F.lit(False))
    number = F.col("bottom") & (plain == F.col("page").cast("string"))
    printed = F.regexp_extract(F.regexp_replace(plain, r"(?U)\s+", " "), PAGE_LABEL, 1)
    label = F.when(F.col("bottom") & runs & (printed != ""), printed).when(~runs & number, plain)
    return told.select(*lines.columns, (~(runs | number)).alias("kept"), label.alias("label"))


def page_labels(told: DataFrame) -> DataFrame:
    """The label of each page of body_and_labels(): that of its last line that gives one, null where none does."""
    return told.groupBy("doc", "page").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("n"))).alias("label"), F.count_if("kept").alias("lines"))

"""HTML pages as text by column expressions: a structured reader (S8) and one that knows no structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

# Elements whose content is no text, elements that stand on lines of their own, named characters.
UNSEEN = ("script", "style", "noscript", "template")
OWN_LINE = (
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main nav ol option p pre section summary table tbody tfoot thead title tr ul"
).split()
NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "ndash": "–", "mdash": "—",
    "hellip": "…", "euro": "€", "amp": "&",
}

_UNSEEN = "|".join(rf"<{name}\b.*?</{name}\s*>" for name in UNSEEN)
#: What is taken out of a page, in this order: (pattern, what comes in its place). RE2 reads the patterns as Java does.
HEADING, CELL = "\x01", "\x02"
STRUCTURE = (
    (rf"(?is)<!--.*?-->|{_UNSEEN}", " "),
    (r"[\s\x01\x02]+", " "),
    (r"(?i)<h([1-6])\b[^>]*>", "\n" + HEADING + r"\1"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<t[dh]\b[^>]*>", CELL),
    (rf"(?i)</?(?:{'|'.join(OWN_LINE)})\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
ANY_TAG = rf"(?is)<!--.*?-->|{_UNSEEN}|<[^>]*>"


def unescape(c: Column) -> Column:
    """Named characters of NAMED and decimal numbers; anything else stays as it is."""

    def numbers(t: Column) -> Column:
        codes = F.regexp_extract_all(t, F.lit(r"&#(\d{1,6});"), F.lit(1))
        chars = F.transform(codes, lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32"))
        spelt = F.array_join(F.zip_with(F.split(t, r"&#\d{1,6};"), chars, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&#")), spelt).otherwise(t)

    def named(t: Column) -> Column:
        out = t
        for name, char in NAMED.items():
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return text.once(text.once(c, numbers), named)


def to_markdown(c: str) -> Column:
    """Headings as #, list items as -, cells of a row with bars between; unseen elements dropped, empty lines too. Null is empty."""
    t = F.coalesce(F.col(c), F.lit(""))
    for pattern, put in STRUCTURE:
        t = F.regexp_replace(t, pattern, put.replace(r"\1", "$1"))

    def line(x: Column) -> Column:
        rowed = F.regexp_replace(F.regexp_replace(x, rf"^[ {CELL}]+", ""), rf" *{CELL} *", " | ")
        return F.trim(F.when(F.contains(x, F.lit(CELL)), rowed).otherwise(x))

    def marked(cells: Column) -> Column:
        rest = F.trim(F.substring(cells, 3, 1_000_000_000))
        head = F.when(F.length(rest) > 0, F.concat(F.repeat(F.lit("#"), F.substring(cells, 2, 1).cast("int")), F.lit(" "), rest)).otherwise("")
        return F.when(F.startswith(cells, F.lit(HEADING)), head).when(cells == "-", "").otherwise(cells)

    lines = F.transform(F.transform(F.split(t, "\n"), line), marked)
    return unescape(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def raw_text(c: str) -> Column:
    """Tags, comments and unseen elements are blanks."""
    return unescape(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), ANY_TAG, " "))


def _sql_unescape(expr: str) -> str:
    for name, char in NAMED.items():
        expr = f"replace({expr}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


def _quoted(pattern: str) -> str:
    for char in (HEADING, CELL):
        pattern = pattern.replace(char, f"\\x0{ord(char)}")
    return pattern


def markdown_sql(expr: str) -> str:
    """S8 for DuckDB, where pages have no numeric characters."""
    for pattern, put in STRUCTURE:
        plain = "' '" if put == " " else "''" if put == "" else "chr(10)" if put == "\n" else "chr(10) || '- '" if put == "\n- " else "chr(2)" if put == CELL else r"chr(10) || chr(1) || '\1'"
        expr = f"regexp_replace({expr}, '{_quoted(pattern)}', {plain}, 'g')"
    cells = r"trim(regexp_replace(regexp_replace(x, '^[ \x02]+', ''), ' *\x02 *', ' | ', 'g'))"
    lines = f"list_transform(string_split({expr}, chr(10)), lambda x: {cells})"
    named = "CASE WHEN starts_with(y, chr(1)) THEN CASE WHEN trim(substr(y, 3)) = '' THEN '' ELSE repeat('#', CAST(substr(y, 2, 1) AS INTEGER)) || ' ' || trim(substr(y, 3)) END WHEN y = '-' THEN '' ELSE y END"
    return _sql_unescape(f"array_to_string(list_filter(list_transform({lines}, lambda y: {named}), lambda z: z <> ''), chr(10))")


def raw_sql(expr: str) -> str:
    return _sql_unescape(f"regexp_replace({expr}, '{ANY_TAG}', ' ', 'g')")

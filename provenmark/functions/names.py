"""Column functions on paths, titles and front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of standards, codes without a number, and the kinds of file by extension.
FAMILY = r"(?i)(?<![A-Za-z])(AS\s*[/_-]\s*NZS|AS|NZS|ISO|IEC|EN|BS|ASME|ANSI|NFPA)[\s_-]*(\d{2,5}(?:\.\d+)*)"
CODE = r"(?i)(?<![A-Za-z])(NCC|BCA)(?![A-Za-z])"
SERIES = r"(?i)\b((?:AS/NZS|AS|NZS|ISO|EN|IEC|BS|ASTM|NFPA)[ _-]?\d{2,5}(?:\.\d+)*)"
KINDS = {
    "pdf": ("pdf",),
    "image": ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp"),
    "cad": ("dxf", "dwg"),
    "archive": ("zip", "7z", "rar"),
    "office": ("docx", "xlsx", "xlsm", "pptx", "msg", "txt", "md", "csv", "rtf"),
    "unsupported": ("rfa", "rvt", "mp4", "avi", "mov", "bak", "exe", "dll", "bin"),
}


def file_name(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def extension(rel: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(rel), r"\.([^.]+)$", 1))


def route(rel: Column) -> Column:
    """Kind of file by extension; what no list has is unknown."""
    out = F.when(extension(rel) == "", "unknown")
    for kind, known in KINDS.items():
        out = out.when(extension(rel).isin(*known), kind)
    return out.otherwise("unknown")


def route_reason(rel: Column) -> Column:
    """Why a person has to decide, null where a reader exists."""
    return F.when(
        route(rel) == "unsupported",
        F.concat(F.upper(extension(rel)), F.lit(" is a closed format without a reader")),
    ).when(
        route(rel) == "unknown",
        F.concat(F.lit("no reader for extension "), F.when(extension(rel) == "", "(none)").otherwise(extension(rel))),
    )


def _series_in(part: Column) -> Column:
    family = F.regexp_replace(F.upper(F.regexp_extract(part, FAMILY, 1)), r"[\s_/-]+", "/")
    numbered = F.concat(F.when(family == "AS/NZS", "AS").otherwise(family), F.lit(" "), F.regexp_extract(part, FAMILY, 2))
    return F.when(part.rlike(FAMILY), numbered).when(part.rlike(CODE), F.upper(F.regexp_extract(part, CODE, 1)))


def series_of(rel: Column) -> Column:
    """Which standard a path names, years left aside. The last part that names one counts, so a file name goes before its folders."""
    parts = F.reverse(F.split(F.replace(rel, F.lit("\\"), F.lit("/")), "/"))
    return F.get(F.filter(F.transform(parts, _series_in), lambda x: x.isNotNull()), F.lit(0))


def doc_key(rel: Column) -> Column:
    """What files of several rooms have in common if they are one document: the lower-cased name without folders."""
    return F.lower(file_name(F.replace(rel, F.lit("\\"), F.lit("/"))))


def parse_standard(title: Column) -> Column:
    """Struct of id, year, draft."""
    return F.struct(
        F.upper(F.regexp_extract(title, SERIES, 1)).alias("id"),
        F.regexp_extract(title, r"\b((?:19|20)\d{2})\b", 1).cast("int").alias("year"),
        title.rlike(r"(?i)\bdraft\b").alias("draft"),
    )


# Who issues a standard by how its name begins, codes among these, and clause ids of the national code with states before them.
ISSUERS = {"AU": r"^(?:NCC|AS[ /\-1-5])", "NZ": r"^NZS", "US": r"^(?:IBC|ICC|NFPA|ASCE|ACI)"}
A_CODE, A_STANDARD = r"^(?:NCC|IBC)", r"^(?:AS|NZS|NFPA|ASCE|ACI|ISO|BS|EN)"
NATIONAL_CLAUSE = r"(?:[A-J]\d{1,2}[GPDVOF]\d{1,2}|S\d{1,2}C\d{1,2}[a-z]?|H\d{1,2}[GPDVOF]\d{1,2})"
STATE = r"(?:ACT|NSW|NT|QLD|SA|TAS|VIC|WA)"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def standard_of(name: Column) -> Column:
    """Struct of std_id (the name without years), std_year, std_kind and jurisdiction, as the name of a document tells them."""
    year, upper = F.regexp_extract(name, YEAR, 1), F.upper(name)
    issuer = F.coalesce(*[F.when(upper.rlike(pattern), F.lit(land)) for land, pattern in ISSUERS.items()], F.lit("unknown"))
    kind = F.when(upper.rlike(A_CODE), "code").when(upper.rlike(A_STANDARD), "standard").otherwise("document")
    bare = F.regexp_replace(F.regexp_replace(name, r"(?U)\s*(?:19|20)\d{2}\s*", " "), r"(?U)^\s+|\s+$", "")
    return F.struct(F.when(year != "", bare).otherwise(name).alias("std_id"), year.alias("std_year"), kind.alias("std_kind"), issuer.alias("jurisdiction"))


def edition_of(name: Column) -> Column:
    """Draft where the name speaks of a draft, preview or public comment, superseded where it says so, else published."""
    n = F.lower(name)
    return F.when(n.rlike("draft|preview|pcd|public comment"), "draft").when(F.contains(n, F.lit("superseded")), "superseded").otherwise("published")


def national_clause(title: Column) -> Column:
    """struct(state, clause) of a title that begins with a clause of the national code, a state's variation of it too; null otherwise."""
    pattern = rf"^(?:({STATE}) )?({NATIONAL_CLAUSE})\b"
    return F.when(
        title.rlike(pattern),
        F.struct(
            F.nullif(F.regexp_extract(title, pattern, 1), F.lit("")).alias("state"),
            F.regexp_extract(title, pattern, 2).alias("clause"),
        ),
    )


def clause_ids(c: Column) -> Column:
    """P23."""
    return F.regexp_extract_all(c, F.lit(r"\b[A-Z]?\d+(?:\.\d+)+\b"), F.lit(0))


def prefixes(rel: Column) -> Column:
    """Every folder above a path, the root ('') included."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def front_matter(c: Column) -> Column:
    """S3: `key: value` header as a map; empty where there is none."""
    head = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(
        pairs,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("key"),
            F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")),
        )
    )


def body_of(c: Column) -> Column:
    """What stands after the front matter."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")


def front_lines(c: Column) -> Column:
    """The lines of the front matter, null where a text has none."""
    head = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"
    return F.when(c.rlike(head), F.split(F.regexp_extract(c, head, 1), "\r?\n"))


# Fields of a title block.
TITLE_FIELDS = {
    "drawing_number": r"(?i)(?:drawing|dwg)\.?\s*(?:no|number|#)\.?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/._]{1,30})",
    "revision": r"(?i)\brev(?:ision)?\.?\s*[:\-]?\s*([A-Z0-9]{1,4})\b",
    "scale": r"(?i)\bscale\s*[:\-]?\s*(1\s*:\s*\d+(?:\s*@\s*A\d)?|NTS|N\.T\.S\.?)",
    "date": r"(?i)\bdate\s*[:\-]?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})",
    "project": r"(?i)\bproject\s*(?:name)?\s*[:\-]\s*(.+)",
    "title": r"(?i)\b(?:drawing\s+)?title\s*[:\-]\s*(.+)",
}


def title_block(text: Column) -> Column:
    """Six fields of a drawing's title block; empty where missing."""
    return F.struct(*[F.trim(F.regexp_extract(text, p, 1)).alias(k) for k, p in TITLE_FIELDS.items()])


def is_under(rel: Column, folder: Column) -> Column:
    """P24."""
    return (folder == "") | (rel == folder) | F.startswith(rel, F.concat(folder, F.lit("/")))


def safe_name(c: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\u0000-\u001f]+', "_"))


def live_key(out_dir: Column) -> Column:
    """A document's place in the output folder: its output path without the mark of what is pending."""
    return F.regexp_replace(F.regexp_replace(F.replace(out_dir, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), "^_pending/", "")


def readable_title(rel: Column) -> Column:
    """A file name without extension, marks as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(file_name(rel), r"\.[^.]+$", ""), r"[_\s]+", " "))

"""Which texts contain which wanted strings, by an index of words and without a product of both sides; and the check of a question
bank that rests on it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import written

_BLANK = r"\s"
#: Lengths of the stretches by which words are looked up: a part of a want has the longest that fits.
STRETCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Texts of a scope that asks for no more than this many strings are searched for each of them.
FEW = 256


def _stretches(rows: DataFrame, c: str, size: str) -> DataFrame:
    """Rows with each stretch of `size` letters of c as __gram."""
    at = rows.where(F.length(c) >= F.col(size)).withColumn("__at", F.explode(F.sequence(F.lit(1), F.length(c) - F.col(size) + 1)))
    return at.withColumn("__gram", F.substring(F.col(c), F.col("__at"), F.col(size))).drop("__at")


def _through_inner_words(words: DataFrame, wants: DataFrame, scope: list[str], ask: list[str]) -> DataFrame:
    """Wants of three words or more, each with the rarest of its inner words: a text that contains it has those as words too."""
    asked = wants.select(*scope, *ask, "find", F.explode(F.array_distinct("__inner")).alias("__word"))
    held = words.join(asked.select(*scope, "__word").distinct(), [*scope, "__word"], "left_semi").groupBy(*scope, "__word").agg(F.count(F.lit(1)).alias("__n"))
    rated = asked.join(held, [*scope, "__word"], "left").groupBy(*scope, *ask, "find").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__word").alias("word"))).alias("__least")
    )
    return rated.where("__least.n > 0").select(*scope, *ask, "find", F.col("__least.word").alias("__word"))


def _through_ends(words: DataFrame, wants: DataFrame, scope: list[str], ask: list[str]) -> DataFrame:
    """Wants without an inner word, each with all words of the texts that can hold its longer end, found by the rarest of its stretches. Short
    stretches are in a share of all words, so their hits would grow with the product of both sides; stretches are as long as the part allows."""
    first, last, one = F.get("__parts", F.lit(0)), F.element_at("__parts", -1), F.size("__parts") == 1
    longer = F.length(first) >= F.length(last)
    ends = wants.select(
        *scope,
        *ask,
        "find",
        F.when(longer, first).otherwise(last).alias("__part"),
        F.when(one, "anywhere").when(longer, "end").otherwise("start").alias("__place"),
    )
    nothing = ends.where("__part = ''").select(*scope, *ask, "find", F.lit("").alias("__word"))
    size = F.greatest(*[F.when(F.length("__part") >= n, F.lit(n)) for n in STRETCHES])
    parts = ends.where("__part <> ''").select("__part").distinct().withColumn("__size", size)
    asked = _stretches(parts, "__part", "__size").select("__part", "__gram").distinct()
    sizes = sorted(r[0] for r in parts.select("__size").distinct().collect())  # eight at most
    sized = words.select("__word").distinct().withColumn("__size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    vocabulary = _stretches(sized, "__word", "__size").select("__word", "__gram")
    vocabulary = written(vocabulary.join(asked.select("__gram").distinct(), "__gram", "left_semi"))
    rare = asked.join(
        vocabulary.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n")),
        "__gram",
    ).groupBy("__part").agg(F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram"))
    met = rare.join(vocabulary, "__gram").where(F.contains("__word", F.col("__part"))).select("__part", "__word")
    fits = (F.col("__place") == "anywhere") | ((F.col("__place") == "end") & F.endswith("__word", F.col("__part"))) | (
        (F.col("__place") == "start") & F.startswith("__word", F.col("__part"))
    )
    return ends.join(met, "__part").where(fits).select(*scope, *ask, "find", "__word").unionByName(nothing)


def _by_words(known: DataFrame, asked: DataFrame, key: list[str], ask: list[str], scope: list[str]) -> DataFrame:
    """(scope, ask, key, text, find) of containment by the index of words."""
    words = known.select(*scope, *key, F.explode(F.array_distinct(F.concat(F.split("text", _BLANK), F.array(F.lit(""))))).alias("__word"))
    asked = asked.withColumn("__parts", F.split("find", _BLANK))
    asked = asked.withColumn("__inner", F.filter(F.slice("__parts", 2, F.greatest(F.size("__parts") - 2, F.lit(0))), lambda x: x != ""))
    long, short = asked.where("size(__inner) > 0"), asked.where("size(__inner) = 0")
    there = {r[0] for r in asked.select(F.size("__inner") > 0).distinct().collect()}  # words that no want needs are not told apart
    through = [_through_inner_words(words, long, scope, ask)] if True in there else []
    through += [_through_ends(words, short, scope, ask)] if False in there or not through else []
    met = written(functools.reduce(DataFrame.unionByName, through))  # where it is small, words meet it without a shuffle
    ids = words.join(met, [*scope, "__word"]).select(*scope, *ask, *key, "find").distinct()
    texts = ids.join(known.select(*scope, *key, "text"), [*scope, *key])
    return texts.where(F.contains("text", F.col("find"))).select(*scope, *ask, *key, "text", "find")


def holding(texts: DataFrame, wants: DataFrame, key: list[str], ask: list[str], scope: tuple[str, ...] = ()) -> DataFrame:
    """contained(), with the text and what was found in it: (scope, ask, key, text, find).

    In a scope that asks for few strings each of its texts is searched for them, which takes one join by the scope; the rest goes by words.
    """
    scope, known = list(scope), texts.where("text IS NOT NULL")
    asked = wants.where("find IS NOT NULL").select(*scope, *ask, "find").distinct()
    if not scope:
        return _by_words(known, asked, key, ask, scope)
    many = written(asked.groupBy(*scope).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > FEW).select(*scope))
    near = known.select(*scope, *key, "text").join(asked.join(many, scope, "left_anti"), scope)
    near = near.where(F.contains("text", F.col("find"))).select(*scope, *ask, *key, "text", "find")
    if many.isEmpty():
        return near
    return near.unionByName(_by_words(known.join(many, scope, "left_semi"), asked.join(many, scope, "left_semi"), key, ask, scope))


def contained(texts: DataFrame, wants: DataFrame, key: list[str], ask: list[str], scope: tuple[str, ...] = ()) -> DataFrame:
    """texts(scope, key, text) and wants(scope, ask, find) to (scope, ask, key): each text that contains each wanted string, as it stands.

    A wanted string meets texts by one of its words (the rarest inner one) or, where it has none, by the words that hold its longer end.
    Only ids go through that join; texts come in once, to be searched. An empty string is in every text that is not null.
    """
    return holding(texts, wants, key, ask, scope).select(*scope, *ask, *key)


def ground_form(c) -> Column:
    """Texts of a bank and of pages compare in this form: dashes, blanks and quotes in their plain kind, ligatures and full-width letters
    as letters, without Markdown emphasis and table bars, in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.translate(text.clean_text(c), "–—‑−’‘“”", "----''\"\"")
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    plain = F.translate(plain, wide, "".join(chr(ord(x) - 0xFEE0) for x in wide))
    plain = F.when(c.rlike(r"[^\x00-\x7f]"), plain).otherwise(c)  # none of these is in ASCII
    return text.once(F.regexp_replace(plain, r"[*_|`]", " "), text.normalize_line)


#: What a ground can lack.
NO_GROUND, NO_UNIT, NOT_IN_SOURCE, NOT_PUBLISHED, NO_MARKER, NO_CLAUSE, NO_EDITION, PRESENT = "no ground", "no unit", "not on the source page", "not in the published text", "no marker", "clause not listed", "edition not found", "is in the library"


def check_grounds(questions: DataFrame, grounds: DataFrame, pages: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
    """What the grounds of questions(question) lack, as (question, problem, doc, page, subject); no rows for a question that is grounded.

    grounds(question, doc, page, contains array, clause, unreadable, absent, edition): with `absent`, no path of the library may contain that
    text; with `edition` and no page, a file of the document must have that status; else every string of `contains` must stand on the
    page of the source, pages(doc, page, text), and in its units(doc, page, text), and the marker and the clause must be there where
    they are asked for. files(path, doc, clauses array, edition) is the library.
    """
    told = lambda df, problem, subject: df.select("question", F.lit(problem).alias("problem"), "doc", F.col("page").cast("long").alias("page"), subject.cast("string").alias("subject"))
    bare = questions.join(grounds.select("question").distinct(), "question", "left_anti").select(
        "question",
        F.lit(None).cast("string").alias("doc"),
        F.lit(None).cast("long").alias("page"),
    )
    out = told(bare, NO_GROUND, F.lit(None))

    absent = grounds.where("absent IS NOT NULL")
    hits = contained(
        files.select("path", F.lower("path").alias("text")),
        absent.select("absent", F.lower("absent").alias("find")).distinct(),
        ["path"],
        ["absent"],
    )
    out = out.unionByName(told(absent.join(hits.groupBy("absent").agg(F.min("path").alias("path")), "absent"), PRESENT, F.col("path")))

    rest = grounds.where("absent IS NULL")
    editions = rest.where("edition IS NOT NULL AND page IS NULL")
    out = out.unionByName(told(editions.join(files.select("doc", "edition").distinct(), ["doc", "edition"], "left_anti"), NO_EDITION, F.col("edition")))

    paged = rest.where("page IS NOT NULL")
    asked = paged.select("doc", "page").distinct()
    source = pages.join(asked, ["doc", "page"], "left_semi").select("doc", "page", ground_form("text").alias("source"))
    published = units.join(asked, ["doc", "page"], "left_semi").groupBy("doc", "page").agg(
        F.array_join(F.array_sort(F.collect_list(ground_form("text"))), " ").alias("published")
    )
    met = paged.join(source, ["doc", "page"], "left").join(published, ["doc", "page"], "left").withColumns(
        {"source": F.coalesce("source", F.lit("")), "published": F.coalesce("published", F.lit(""))}
    )
    lack = lambda cond, problem, subject: F.when(cond, F.struct(F.lit(problem).alias("problem"), subject.cast("string").alias("subject")))
    here, none = F.col("published") != "", F.lit(None)

    def missing(subject):
        out_of = lambda find: F.array(
            lack(~F.contains("source", find), NOT_IN_SOURCE, subject), lack(here & ~F.contains("published", find), NOT_PUBLISHED, subject)
        )
        return text.once(ground_form(subject), out_of)

    # a ground is told all that it lacks in its row, so pages are joined and brought into their form once
    own = F.array(lack(~here, NO_UNIT, none), lack(F.coalesce("unreadable", F.lit(False)) & ~F.contains("published", F.lit("not readable")), NO_MARKER, none))
    strings = F.flatten(F.transform(F.coalesce("contains", F.array().cast("array<string>")), missing))
    lacks = met.select("question", "doc", "page", F.inline(F.array_compact(F.concat(own, strings))))
    out = out.unionByName(lacks.select("question", "problem", "doc", F.col("page").cast("long").alias("page"), "subject"))
    listed = files.select("doc", F.explode("clauses").alias("clause")).distinct()
    return out.unionByName(told(paged.where("clause IS NOT NULL").join(listed, ["doc", "clause"], "left_anti"), NO_CLAUSE, F.col("clause")))

r"""Quality rules, line first [native].

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines go, and a document that loses more than
`max_lost` of its text that way is rejected. Nothing is shuffled: one projection over the scan, all inside the JVM.

Defined cases: a null text counts as empty; a text without words has only zeros, fails the base rule and is not kept; lines
without a word never fail and never count as repeated; rows are judged one by one, so repeated rows give repeated results and
further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, table

WINDOW = 8  # words; hashed by doubling: 1, 2, 4, 8
MAX_LOST = 0.5

# Menu words that stand alone in a line, and phrases of boilerplate, by language. A further language is a further row.
MENU = {
    "en": "home|menu|next|previous|prev|back to top|log ?in|log ?out|sign ?in|sign ?up|register|search|share|tweet|sitemap|site map|skip to (?:main )?content|read more|contact(?: us)?|about(?: us)?|faq|rss",
    "de": "startseite|menü|weiter|zurück|nach oben|anmelden|abmelden|registrieren|suche|teilen|mehr lesen|weiterlesen|kontakt|über uns|impressum|zum inhalt springen",
    "fr": "accueil|suivant|précédent|haut de page|connexion|déconnexion|s'inscrire|rechercher|partager|lire la suite|contactez-nous|à propos|plan du site|aller au contenu",
    "es": "inicio|menú|siguiente|anterior|volver arriba|iniciar sesión|cerrar sesión|registrarse|buscar|compartir|leer más|contacto|sobre nosotros|mapa del sitio|saltar al contenido",
}
PHRASES = {
    "en": (
        "all rights reserved", "cookie policy", "uses cookies", "use cookies", "accept cookies", "accept all cookies", "privacy policy", "terms of use", "terms of service",
        "enable javascript", "javascript is disabled", "javascript is required", "lorem ipsum", "subscribe to our newsletter", "subscribe to the newsletter", "click here",
    ),
    "de": ("alle rechte vorbehalten", "cookie-richtlinie", "verwendet cookies", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren", "hier klicken"),
    "fr": ("tous droits réservés", "utilise des cookies", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "activer javascript", "abonnez-vous à notre newsletter", "cliquez ici"),
    "es": ("todos los derechos reservados", "utiliza cookies", "aceptar cookies", "política de privacidad", "términos de uso", "condiciones de uso", "aviso legal", "activar javascript", "suscríbete a nuestro boletín", "haz clic aquí"),
}
NAVIGATION = rf"(?iU)^\W*(?:{'|'.join(MENU.values())})\W*$"
BOILERPLATE = tuple(phrase for phrases in PHRASES.values() for phrase in phrases)

WORDED = "[^\\\\x20\\\\x09-\\\\x0D]"


def _count(text: str, pattern: str) -> str:
    """SQL for the number of matches; split and translate build strings character by character, a regex only where it hits."""
    return f"size(regexp_extract_all({text}, '{pattern}', 0))"


def _phrase(text: str) -> str:
    return " OR ".join(f"contains({text}, '{_sql(phrase)}')" for phrase in BOILERPLATE)


def line_fails(x: str = "x", phrased: str = "true") -> str:
    """SQL condition on one line x; phrased: whether its text has any boilerplate phrase at all.

    punctuation: over one mark of `#*$%&|<>` in 12 characters, or shouted marks (`!!`, `??`) after at least a third of the words;
    navigation: three separators or more, at least one for two words, or a menu word alone; boilerplate: a fixed phrase.
    """
    words = f"size(split({x}, ' '))"
    return (
        f"({_count(x, '[#*$%&|<>]')} * 12 > length({x})"
        f" OR ({x} RLIKE '[!?]{{2}}' AND {_count(x, '[!?]{2,}')} * 3 >= {words})"
        f" OR ({x} RLIKE '[|»›•·].*[|»›•·].*[|»›•·]' AND {_count(x, '[|»›•·]')} * 2 >= {words} - 1)"
        f" OR (length({x}) < 40 AND {x} RLIKE '{_sql(NAVIGATION)}')"
        f" OR ({phrased} AND ({_phrase(f'lower({x})')})))"
    )


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def judge(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Adds the struct `quality` (n_words … kept) and `clean_text`, without failing lines, to every row of docs; needs `text`."""
    held = [c for c in docs.columns]
    ws = "".join(f"\\u{ord(c):04x}" for c in SPACES)
    body = "coalesce(text, '')"
    step = docs.withColumn(
        "__words",
        F.expr(f"CASE WHEN {body} RLIKE '{WORDED}' THEN split(btrim({body}, '{ws}'), '[\\\\x20\\\\x09-\\\\x0D]+') ELSE array() END"),
    ).withColumns({"__lines": F.expr(f"split({body}, '\\n')"), "__low": F.expr(f"lower({body})")})
    step = (
        step.withColumn("__phrased", F.expr(_phrase("__low")))
        .withColumn("__n", F.expr("size(__words)"))
        .withColumn("__hash", F.expr("transform(__words, w -> xxhash64(w))"))
        .withColumn("__two", F.expr("transform(__hash, (h, i) -> xxhash64(h, get(__hash, i + 1)))"))
        .withColumn("__four", F.expr("transform(__two, (h, i) -> xxhash64(h, get(__two, i + 2)))"))
        .withColumn("__grams", F.expr(f"slice(transform(__four, (h, i) -> xxhash64(h, get(__four, i + 4))), 1, greatest(0, __n - {WINDOW - 1}))"))
        .withColumn("__order", F.expr("CASE WHEN size(array_distinct(__grams)) < size(__grams) THEN sort_array(transform(__grams, (g, i) -> struct(g AS g, i AS i))) ELSE array() END"))
        .withColumn("__starts", F.expr("sort_array(transform(filter(__order, (x, k) -> x.g = get(__order, k - 1).g OR x.g = get(__order, k + 1).g), x -> x.i))"))
        .withColumn("__judged", F.expr(f"transform(__lines, x -> struct(x AS x, x RLIKE '{WORDED}' AS worded, x RLIKE '{WORDED}' AND {line_fails('x', '__phrased')} AS bad))"))
        .withColumn("__worded", F.expr("transform(filter(__judged, y -> y.worded), y -> y.x)"))
    )
    step = step.withColumn(
        "__q",
        F.expr(
            f"""struct(
            CAST(__n AS bigint) AS n_words,
            aggregate(__words, 0L, (a, w) -> a + length(w)) AS word_chars,
            CAST({_count(body, '[#*$%&|<>]')} AS bigint) AS n_symbols,
            CAST(size(__worded) - size(array_distinct(__worded)) AS bigint) AS n_dup_lines,
            CAST(aggregate(transform(__starts, (s, k) -> least({WINDOW}, coalesce(get(__starts, k + 1), s + {WINDOW}) - s)), 0, (a, b) -> a + b) AS bigint) AS n_repeat_words,
            aggregate(__judged, 0L, (a, y) -> a + CASE WHEN y.bad THEN length(y.x) ELSE 0 END) AS lost_chars,
            aggregate(__worded, 0L, (a, x) -> a + length(x)) AS line_chars)"""
        ),
    )
    verdict = F.expr(
        f"""struct(__q.*,
        (__q.n_words < 20 OR 100 * __q.n_repeat_words > 30 * __q.n_words) AS base_failed,
        NOT (__q.n_words < 20 OR 100 * __q.n_repeat_words > 30 * __q.n_words) AND __q.lost_chars <= {max_lost}D * __q.line_chars AS kept)"""
    )
    clean = F.expr("CASE WHEN exists(__judged, y -> y.bad) THEN array_join(transform(filter(__judged, y -> NOT y.bad), y -> y.x), '\\n') ELSE text END")
    return step.select(*[F.col(f"`{c}`") for c in held if c != "quality"], verdict.alias("quality"), clean.alias("clean_text"))


def keep_good(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """docs without rejected rows, and without failing lines in the others' text. Columns as given."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # the id keeps the filter above the projections; below, it would repeat their expressions inside each other
    kept = judge(docs.select("text", row), max_lost).withColumn("__id", F.monotonically_increasing_id()).where("quality.kept AND __id >= 0")
    return kept.select(*[F.col("clean_text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept")

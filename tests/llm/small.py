"""Tables for tests, written as the given ones are: one folder with a parquet a table."""

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

CASES = [
    (0, None, "en", "a", None),
    (1, "", "en", "a", 0),
    (2, "   \n\t ", "en", None, 6),
    (3, "one two three", "en", "b", 13),
    (3, "one two three", "en", "b", 13),
    (None, "no id here at all", "de", "b", 17),
    (4, "Füße tragen Straßen über das alte Maß hinaus, sagte sie. " * 12, "de", "ä", 0),
    (5, ("word " * 30_000).strip(), "en", "c", 150_000),
    (6, "x" * 5000, "en", "c", 5000),
    (7, "Line one is plain and says enough to stay here.\nHome | About | Contact | Search | Login\nLine two is plain and says enough to stay here as well.\nAll rights reserved.", "en", None, 0),
    (8, "Ünïcødé \u2028 and \u00a0 odd \x1c spaces \x85 kept \u3000 as words", "fr", None, 0),
]


def frame(spark, rows=CASES, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # further columns, some with names that operators like to use
        from pyspark.sql import functions as F

        df = df.select("*", F.lit(1).alias("size"), F.lit("x").alias("quality"), F.lit(2).alias("n"), F.lit(None).cast("string").alias("key"))
    return df


def words(text):
    return WORD.findall(text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def save(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)

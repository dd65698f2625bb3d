"""Files as bytes: their hash by blocks and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4 * 1024 * 1024
# What the bytes 0x80 to 0x9f are in cp1252; five have no letter there.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES = "".join(chr(i) for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files below a folder; Spark leaves out empty ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def block_hash(content: Column, block: int = BLOCK) -> Column:
    """sha256 over the sha256 of each block of 4 MB, in order; of nothing for an empty file."""
    many = F.ceil(F.octet_length(content) / block).cast("int")
    places = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(places, lambda i: F.sha2(F.substring(content, i * block + 1, F.lit(block)), 256))
    return F.when(content.isNotNull(), F.sha2(F.unhex(F.array_join(blocks, "")), 256))


def decoded(content: Column) -> Column:
    """struct(text, encoding) of bytes that are UTF-8, else cp1252, else (with a byte that cp1252 lacks) latin-1."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    odd = latin.rlike("[\\u0081\\u008d\\u008f\\u0090\\u009d]")
    text = F.when(utf8, content.cast("string")).when(odd, latin).otherwise(F.translate(latin, _BYTES, CP1252))
    return F.when(content.isNotNull(), F.struct(text.alias("text"), F.when(utf8, "utf-8").when(odd, "latin-1").otherwise("cp1252").alias("encoding")))

"""Outlines of documents: contents lists, the heading that each row stands under, and parts of bounded size as a tree of files."""

from __future__ import annotations

import uuid
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_CHARS, FULL = 120_000, 0.6
LEAST_ENTRIES, PAGES_AN_ENTRY, BACK_STEPS = 5, 40, 0.02
ONE_FILE = 100_000
#: Folders that the files of a tree are dealt over, and letters of a path (two a byte) in one name.
SHARDS, NAME = 1024, 200


def nested(entries: DataFrame) -> DataFrame:
    """Contents entries(doc, i, level, title, page) without wrapper levels (a single entry above all others, such as the document's
    title) and with levels from 1. The last entry of a document is never dropped."""
    levels = entries.groupBy("doc", "level").agg(F.count(F.lit(1)).alias("n"))
    up, down = Window.partitionBy("doc").orderBy("level"), Window.partitionBy("doc").orderBy(F.desc("level"))  # a row a level
    levels = levels.withColumns({"crowd": F.max("n").over(up), "left": F.sum("n").over(down)})
    kept = levels.where("NOT (crowd = 1 AND left > 1)").groupBy("doc").agg(F.min("level").alias("top"))
    return entries.join(kept, "doc").where("level >= top").select("doc", "i", (F.col("level") - F.col("top") + 1).alias("level"), "title", "page")


def contents_usable(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """documents(doc, pages) with the number of entries(doc, i, level, title, page), of steps back to an earlier page, and whether the
    list can be used: five entries and one for 40 pages at least, steps back in 2 % of the entries at most."""
    step = F.col("page") < F.lag("page").over(Window.partitionBy("doc").orderBy("i"))  # a document's contents
    counted = entries.withColumn("back", F.coalesce(step, F.lit(False))).groupBy("doc").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if("back").alias("back_steps"),
    )
    all_ = documents.join(counted, "doc", "left").fillna(0, ["entries", "back_steps"])
    usable = (F.col("entries") >= F.greatest(F.lit(LEAST_ENTRIES), F.col("pages") / PAGES_AN_ENTRY)) & (F.col("back_steps") <= F.col("entries") * BACK_STEPS)
    return all_.select("doc", "entries", "back_steps", usable.alias("usable"))


def section_carry(items: DataFrame) -> DataFrame:
    """items(doc, n, level, title, part_break, …) with seq, l1, l2 and intro: the running number of their section, the headings of the
    first two levels that they stand under, and whether they are the introduction of a first level that has sections of its own.

    A heading of level 1 or 2 (level is null on other rows) or a row with a part_break begins a section; rows before the first make one
    without headings.
    """
    order = Window.partitionBy("doc").orderBy("n")  # a document's rows
    one, two = F.col("level") == 1, F.coalesce(F.col("level") == 2, F.lit(False))
    opens = F.coalesce(F.col("level") <= 2, F.lit(False)) | F.col("part_break").isNotNull()
    begun = items.withColumn("__open", opens).withColumns({
        "seq": (F.sum(F.col("__open").cast("long")).over(order) + F.when(F.first("__open").over(order), 0).otherwise(1)).cast("long"),
        "__at": F.last(F.when(one, F.col("n")), True).over(order),
        "l1": F.last(F.when(one, F.col("title")), True).over(order),
        "__l2": F.last(F.when(opens, F.struct(F.when(two, F.col("title")).when(F.coalesce(one, F.lit(False)), F.lit(None)).otherwise(F.col("part_break")).alias("l2"))), True).over(order),
    })
    sections = begun.groupBy("doc", "seq").agg(
        F.max("__at").alias("__at"),
        F.min_by(F.coalesce(one, F.lit(False)), "n").alias("head"),
        F.max("__l2.l2").alias("l2"),
    )
    after = Window.partitionBy("doc").orderBy("seq")
    intro = F.col("head") & F.coalesce((F.lead("__at").over(after) == F.col("__at")) & F.lead("l2").over(after).isNotNull(), F.lit(False))
    flags = sections.select("doc", "seq", intro.alias("intro"))
    return begun.join(flags, ["doc", "seq"]).select(*items.columns, "seq", "l1", F.col("__l2.l2").alias("l2"), "intro")


def _fold(rows: list[tuple], most: float, boundary) -> list[list[tuple]]:
    """Runs of consecutive rows; a new one begins at a boundary once the open one is 60 % full."""
    out: list[list[tuple]] = []
    size = 0
    for row in rows:
        if not out or size > most * FULL and boundary(row, out[-1][-1]):
            out.append([])
            size = 0
        out[-1].append(row)
        size += row[1]
    return out


def split_sections(items: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """items(doc, seq, n, size, level, page) with `part` and `parts`: sections over `most` characters are cut before clause headings
    (level 3 or more) once a part is 60 % full, and parts that are still too long at page ends. Sections without clause headings are
    cut at a third of that size. Only numbers of long sections leave the JVM, many sections in a batch."""
    clause = F.coalesce(F.col("level") >= 3, F.lit(False))
    sizes = items.groupBy("doc", "seq").agg(F.sum("size").alias("total"), F.max(clause).alias("clauses"))
    sizes = sizes.withColumn("most", F.when(F.col("clauses"), F.lit(float(most))).otherwise(F.lit(float(most // 3)))).where("total > most")
    rows = F.sort_array(F.collect_list(F.struct("n", "size", clause.alias("clause"), "page")))
    long = items.join(sizes.select("doc", "seq", "most"), ["doc", "seq"]).groupBy("doc", "seq", "most").agg(
        *[rows.getField(c).alias(c) for c in ("n", "size", "clause", "page")]
    )

    @F.pandas_udf("array<int>")
    def cut(sizes: pd.Series, clauses: pd.Series, pages: pd.Series, mosts: pd.Series) -> pd.Series:
        def one(size, clause, page, most):
            parts: list[list[tuple]] = []
            for part in _fold(list(zip(range(len(size)), size, clause, page, strict=True)), most, lambda row, _: row[2]):
                parts += _fold(part, most, lambda row, before: row[3] != before[3]) if sum(r[1] for r in part) > most else [part]
            return [i for i, part in enumerate(parts, 1) for _ in part]

        return pd.Series([one(list(s), list(c), list(p), float(m)) for s, c, p, m in zip(sizes, clauses, pages, mosts, strict=True)], dtype="object")

    done = long.withColumn("cut", cut("size", "clause", "page", "most")).select(
        "doc", "seq", F.inline(F.arrays_zip("n", F.col("cut").alias("part"))).alias("n", "part"), F.element_at("cut", -1).alias("parts"),
    )
    return items.join(done, ["doc", "seq", "n"], "left").fillna(1, ["part", "parts"])


def tree_of(parts: DataFrame, documents: DataFrame, one_file: int = ONE_FILE) -> DataFrame:
    """Where results go. parts(doc, seq, part, parts, l1, l2, text, size) and documents(doc, folder, trusted) to files (status, path, text):
    documents of up to `one_file` characters are one file beside their siblings; others have a folder with one for each first heading and
    a file for each part. What is not trusted goes below `_pending`."""
    sizes = parts.groupBy("doc").agg(F.sum("size").alias("total"))
    met = parts.join(sizes, "doc").join(documents, "doc")
    safe = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("Front")), r'[\\/:*?"<>|\x00-\x1f]+', " ")), r"(?U)\s+", " ")
    title = F.concat_ws(
        " ",
        F.when(F.col("seq") < 10, F.concat(F.lit("0"), F.col("seq"))).otherwise(F.col("seq").cast("string")),  # lpad would cut 100 to 10
        F.substring(safe(F.coalesce("l2", "l1")), 1, 80),
        F.when(F.col("parts") > 1, F.concat(F.lit("part "), F.col("part"), F.lit(" of "), F.col("parts"))),
    )
    path = F.when(F.col("total") <= one_file, F.concat("doc", F.lit(".md"))).otherwise(
        F.concat("doc", F.lit("/"), F.substring(safe(F.col("l1")), 1, 80), F.lit("/"), title, F.lit(".md"))
    )
    full = F.concat_ws("/", F.when(~F.col("trusted"), "_pending"), F.nullif("folder", F.lit("")), path)
    whole = met.select(full.alias("path"), F.col("trusted"), F.struct("seq", "part", "text").alias("t"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return whole.groupBy("path", "trusted").agg(texts.alias("text")).select(
        F.when(F.col("trusted"), "auto_verified").otherwise("pending_review").alias("status"),
        "path",
        "text",
    )


def write_tree(files: DataFrame, folder: str) -> DataFrame:
    """Write files(status, path, text) below a folder, a file for each path, and compare what is there with what was meant:
    (path, problem), no rows if all is well. Paths are encoded in file names, so any character may stand in them.

    Tasks write their files themselves, through Arrow (mounted folders, HDFS, S3 and their like): one commit for all files would move
    each of them in the driver, one after the other. A file appears in one piece, so a task may run twice. Files are dealt over SHARDS folders, which tasks
    list.
    """
    spark = files.sparkSession
    root = _uri(spark, folder)

    def put(batches):
        store, base = FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for shard, status, at, content in zip(*(batch.column(c) for c in ("shard", "status", "at", "content")), strict=True):
                at = at.as_py()
                *above, name = [at[i : i + NAME] for i in range(0, len(at), NAME)]  # a file's name has 255 letters at most
                within = "/".join([base, f"{shard}", f"status={quote(status.as_py(), safe='')}", *above])
                if within not in made:
                    store.create_dir(within, recursive=True)
                    made.add(within)
                with store.open_output_stream(draft := f"{within}/.{name}.{uuid.uuid4().hex}") as out:
                    out.write((content.as_py() or b"") + b"\n")
                store.move(draft, f"{within}/{name}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    shard = F.pmod(F.xxhash64("status", "path"), F.lit(SHARDS)).alias("shard")
    rows = files.select(shard, "status", F.hex(F.encode("path", "UTF-8")).alias("at"), F.col("text").cast("binary").alias("content"))
    rows.repartition(_tasks(spark), "shard").mapInArrow(put, "files long").agg(F.sum("files")).first()
    meant = files.select("path", (F.octet_length("text") + 1).cast("long").alias("bytes"))
    there = listing(spark, folder).groupBy("path").agg(F.sum("length").alias("length"))
    both = meant.join(there, "path", "full")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("bytes").isNull(), "not meant").when(F.col("length") != F.col("bytes"), "other size")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def listing(spark, folder: str) -> DataFrame:
    """(path, length) of a written tree; contents are not read."""
    root = _uri(spark, folder)

    def there(batches):
        store, base = FileSystem.from_uri(root)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                found = store.get_file_info(FileSelector(f"{base}/{shard}", allow_not_found=True, recursive=True))
                found = [x for x in found if x.type == FileType.File and not x.base_name.startswith(".")]
                at = ["".join(x.path[len(base) :].split("/")[3:]).removesuffix(".txt") for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array([x.size for x in found], pa.int64())], names=["at", "length"])

    found = spark.range(0, SHARDS, 1, _tasks(spark)).mapInArrow(there, "at string, length long")
    return found.select(F.decode(F.unhex("at"), "UTF-8").alias("path"), "length")


def _tasks(spark) -> int:
    """Tasks that write or list a tree: some for each core, since files take unlike time."""
    return min(SHARDS, 4 * spark.sparkContext.defaultParallelism)


def _uri(spark, folder: str) -> str:
    """A folder as all executors find it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = urlsplit(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString())
    scheme = {"s3a": "s3", "s3n": "s3"}.get(found.scheme, found.scheme)
    return f"{scheme}://{found.netloc}{found.path}"


def page_scope(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown lines(doc, n, source_line, null if unmatched) and pages(doc, page, lines: how many lines end with this page) to
    (doc, page, md_lines) of all pages, empty ones too, and (doc, lines, unmapped, empty_pages, in_scope percent).

    A source line lies on the first page whose last line is not before it: both sides meet in one sorted pass by document, and lines
    behind the last page are unmapped like those without a match.
    """
    ends = pages.select("doc", F.col("lines").alias("at"), F.lit(1).alias("kind"), "page", F.lit(None).cast("long").alias("n"))
    asked = lines.where("source_line IS NOT NULL").select(
        "doc", (F.col("source_line") + 1).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page"),
        F.col("n").cast("long").alias("n"),
    )
    ahead = Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)  # a document's lines
    met = asked.unionByName(ends.withColumn("page", F.col("page").cast("long"))).withColumn("on", F.min("page").over(ahead)).where("kind = 0")
    placed = lines.join(met.select("doc", "n", "on"), ["doc", "n"], "left")
    by_page = placed.where("on IS NOT NULL").groupBy("doc", F.col("on").alias("page")).agg(F.count(F.lit(1)).alias("c"))
    full = pages.select("doc", F.col("page").cast("long").alias("page")).join(by_page, ["doc", "page"], "left").select(
        "doc",
        "page",
        F.coalesce("c", F.lit(0)).cast("long").alias("md_lines"),
    )
    empty = full.groupBy("doc").agg(F.count_if(F.col("md_lines") == 0).alias("empty_pages"))
    share = F.round(100 * F.count("on") / F.count(F.lit(1)), 1)
    told = placed.groupBy("doc").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("on").isNull()).alias("unmapped"), share.alias("in_scope"))
    return full, told.join(empty, "doc", "left").fillna(0, ["empty_pages"])

"""Near duplicates by BagMinHash signatures, banding and verified multiset overlap.

Texts are multisets of shingles of five words; two texts are linked if their weighted Jaccard similarity is 0.8 or more.

1. Equal texts share a 128-bit key and are one text from there on.
2. BagMinHash: each shingle has Poisson processes on the dyadic weight intervals [0,1), [1,2), [2,4), [4,8), …; a point falls on a
   random signature slot, and a point of an interval that the weight covers only in part is kept if its place, drawn bit by bit as
   by halving the interval, lies under the weight. Slots keep the earliest point. Points come in ascending order, so a shingle
   stops as soon as its next point is later than the latest slot: about one point for each shingle of a longer text.
3. 25 bands of 5 slots: a pair at 0.8 shares a band with probability 0.99995. Each bucket has a leader, its smallest key. Each
   member is checked against the leader with which it shares most bands. Then buckets that still hold several classes form
   families: members outside a family's largest class are queries, held against all its members block by block, so no link
   between different classes is lost there, copies are never expanded into all pairs, and no such pair becomes a row.
4. Classes are the connected components of the verified links.

Defined cases: null and empty texts are equal (one class); texts without words are linked only if equal; a text of under five
words is one shingle; every row keeps its row, repeated rows and null ids too; class_id is the smallest doc_id of the class
(null only if all are null); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import components
from .words import blocks, buffers, mix, split, windows

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
_STEP, _SLOT, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def weighted(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles to (owner, element of 48 bits, weight), owners ascending."""
    if len(owners) and owners.max() >= 1 << 16:  # owner and element do not fit one number
        element = values >> np.uint64(16)
        order = np.lexsort((element, owners))
        owner, element = owners[order].astype(int), element[order]
        at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])]))
        return owner[at], element[at], np.diff(np.append(at, len(owner)))
    keys = np.sort((owners.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    if not len(keys):
        return np.zeros(0, int), keys, np.zeros(0, int)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at] >> np.uint64(48)).astype(int), keys[at] & np.uint64(2**48 - 1), np.diff(np.append(at, len(keys)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """n × slots earliest points (inf where a text has none)."""
    parts, low = [(np.arange(len(owner)), 0.0, 1.0)], 1.0
    while len(over := np.flatnonzero(weight > low)):
        parts.append((over, low, low))
        low *= 2
    which = np.concatenate([p for p, _, _ in parts])
    bottom = np.concatenate([np.full(len(p), b) for p, b, _ in parts])
    rate = np.concatenate([np.full(len(p), r) for p, _, r in parts])
    seed = mix(element[which] * _STEP + bottom.astype(np.uint64))
    whose, upto = owner[which], weight[which].astype(float)
    time, best = np.zeros(len(which)), np.full(n * slots, np.inf)
    step = np.uint64(0)
    while len(seed):
        step += np.uint64(1)
        drawn = mix(seed + step * _STEP)
        time = time - np.log(((drawn >> np.uint64(11)).astype(float) + 1) / 2.0**53) / rate
        kept = bottom + rate * ((mix(drawn ^ _PLACE) >> np.uint64(11)).astype(float) / 2.0**53) < upto
        slot = whose * slots + (mix(drawn ^ _SLOT) % np.uint64(slots)).astype(int)
        np.minimum.at(best, slot[kept], time[kept])
        on = np.flatnonzero(time < best.reshape(n, slots).max(axis=1)[whose])
        seed, time, whose, bottom, rate, upto = seed[on], time[on], whose[on], bottom[on], rate[on], upto[on]
    return best.reshape(n, slots)


def _bands(batches):
    for batch in batches:
        offsets, data = buffers(batch.column(1))
        for a, b in blocks(offsets, 2_000_000):
            words = split(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
            owner, element, weight = weighted(*windows(words, SHINGLE))
            signed = signatures(owner, element, weight, b - a).view(np.uint64).reshape(b - a, BANDS, ROWS)
            banded = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (b - a, 1))
            for k in range(ROWS):
                banded = mix(banded * _STEP + signed[:, :, k])
            sizes = np.bincount(owner, weight, b - a).astype(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(banded.astype(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), lists], ["key", "n", "bands"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / max(1, len(a) + len(b) - both))


def _check(batches):
    for batch in batches:
        sides = []
        for column in (batch.column(2), batch.column(3)):
            values, owners = windows(split(*buffers(column)), SHINGLE)
            order = np.argsort(owners, kind="stable")
            sides.append((values[order], np.searchsorted(owners[order], np.arange(len(column) + 1))))
        (v, f), (w, g) = sides
        likes = [overlap(v[f[i] : f[i + 1]], w[g[i] : g[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likes, pa.float64())], ["a", "b", "likeness"])


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of pairs(a, b) whose texts(key, text), one a key, are similar enough; written."""
    rows = pairs.select("a", "b").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return cut(rows.select("a", "b", "ta", "tb").mapInArrow(_check, "a binary, b binary, likeness double").where(F.col("likeness") >= similar - 1e-12).select("a", "b"))


def _elements(texts, names):
    """Multisets of shingles as sets, the k-th copy of a shingle being an element of its own: (owner, element, sizes)."""
    values, owners = windows(split(*buffers(texts)), SHINGLE)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])])[: len(values)]
    copy = np.arange(len(values)) - np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    return owners, mix(values + copy.astype(np.uint64) * _STEP), np.bincount(owners, minlength=names)


def _held(similar: float):
    """Links between the queries and the members of one group: of those that join its roots, a spanning forest."""

    def held(part: pa.Table) -> pa.Table:
        query = part["query"].to_numpy(zero_copy_only=False)
        key, a, b = part["key"].to_pylist(), [], []
        _, root = np.unique(np.array(part["root"].to_pylist(), object), return_inverse=True)
        joined = root.copy()  # what each text's root has been joined to
        owner, element, sizes = _elements(part["text"], len(key))
        mine = ~query[owner]
        order = np.argsort(element[mine], kind="stable")
        index, member = element[mine][order], owner[mine][order]
        first = np.searchsorted(owner, np.arange(len(key) + 1))
        for q in np.flatnonzero(query):
            wanted = element[first[q] : first[q + 1]]
            lo, hi = np.searchsorted(index, wanted), np.searchsorted(index, wanted, "right")
            n = hi - lo
            met = member[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            both = np.bincount(met, minlength=len(key))
            for m in np.flatnonzero((both > 0) & (both >= similar * (sizes + sizes[q] - both) - 1e-9)):
                if joined[m] != joined[q]:
                    joined[joined == joined[m]] = joined[q]
                    a.append(min(key[m], key[q]))
                    b.append(max(key[m], key[q]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return held


def across_classes(members: DataFrame, meetings: DataFrame, texts: DataFrame, similar: float, block: int = 500) -> DataFrame:
    """All links between different roots among members(key, root) that meetings(a, b) connect.

    Members fall into families (components of meetings). A family's members outside its largest class are queries, held against
    all its members: both sides in blocks of about `block` texts, so a task has a block of each and no pair becomes a row.
    """
    families = cut(components(meetings)).select(F.col("node").alias("key"), F.col("root").alias("family"))
    placed = cut(members.join(families, "key"))
    counts = placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("family").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")).where("m > most")
    sized = counts.select("family", "main", F.ceil(F.col("m") / block).alias("blocks"), F.ceil((F.col("m") - F.col("most")) / block).alias("asks"))
    rows = placed.join(sized, "family").join(texts, "key").withColumn("query", F.lit(False))
    spot = F.xxhash64("key")
    told = rows.withColumns({"block": F.pmod(spot, "blocks"), "ask": F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1))})
    asked = rows.where("root != main").withColumns({"query": F.lit(True), "ask": F.pmod(spot, "asks"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    names = ["family", "block", "ask", "query", "key", "root", "text"]
    return cut(told.select(*names).unionByName(asked.select(*names)).groupBy("family", "block", "ask").applyInArrow(_held(similar), "a binary, b binary").distinct())


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs(doc_id, text) to one row a row: doc_id, key (of its text), class_key, class_id, class_size."""
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))
    signed = cut(keyed.select("key", "text").mapInArrow(_bands, "key binary, n long, bands array<long>").dropDuplicates(["key"]))
    texts = keyed.select("key", "text")
    members = signed.where("n > 0").select("key", "n", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    shared = cut(members.join(leaders, "bucket"))
    wanted = shared.select("key").distinct().hint("merge")  # grows with the corpus: never broadcast
    texts = cut(texts.join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    sizes = signed.select(F.col("key").alias("leader"), F.col("n").alias("leader_n"))
    pairs = shared.where("leader != key").groupBy("leader", "key", "n").agg(F.count(F.lit(1)).alias("bands"))
    pairs = (pairs.join(sizes, "leader").where(F.least("n", "leader_n") >= similar * F.greatest("n", "leader_n") - 1e-9).select(F.col("leader").alias("a"), F.col("key").alias("b"), "bands"))
    closest = pairs.groupBy("b").agg(F.max_by("a", F.struct("bands", "a")).alias("a")).select("a", "b")
    links = verified(closest, texts, similar)
    roots = cut(components(links))
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    placed = shared.join(of("key"), "key", "left").select("bucket", "key", "n", F.coalesce("rkey", "key").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    left = cut(placed.join(open_, "bucket", "left_semi").select("bucket", "key", "root"))
    if not left.isEmpty():
        met = cut(left.join(leaders, "bucket").select("key", "leader").distinct())
        nearest = met.groupBy("key").agg(F.min("leader").alias("first"))
        also = met.join(nearest, "key").select(F.col("first").alias("a"), F.col("leader").alias("b")).distinct()  # few: leaders that share a member
        meetings = nearest.select(F.col("first").alias("a"), F.col("key").alias("b")).unionByName(also)
        found = across_classes(left.select("key", "root").distinct(), meetings, texts, similar)
        if not found.isEmpty():
            roots = cut(components(links.unionByName(found)))
    rows = keyed.select("doc_id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("class_key"))
    rows = cut(rows)
    classes = rows.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(classes, "class_key")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: the smallest doc_id; of repeated rows one. Columns as given."""
    columns = docs.columns
    classes = near_classes(docs, similar)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("key").alias("__key"), F.first("class_id").alias("__id"))
    chosen = docs.withColumn("__text_key", text_key(F.col("text"))).join(first, (F.col("__text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return chosen.dropDuplicates(["__text_key", "doc_id"]).select(*[F.col(f"`{c}`") for c in columns])


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")

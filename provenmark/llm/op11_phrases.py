r"""Phrases of two to four words, mined level by level over sorted occurrence relations (SETM).

1. Texts are cut into pieces and words. About `chunk_bytes` of text make a chunk, whose occurrence relation (position, group) is
   sorted by piece and position, with a gap in the positions between pieces, and is written once; a chunk counts its words before
   anything is shuffled.
2. Group-count: the chunks' counts meet by key; groups of `least` or more occurrences are frequent. Semi-join: each chunk gets the
   numbers of its frequent groups back and keeps their occurrences.
3. Merge-join: occurrences of frequent phrases at adjacent positions of a piece give the occurrences of phrases that are one word
   longer. Steps 2 and 3 repeat up to four words; no phrase is frequent whose parts are not, so nothing is lost.
4. Candidates meet the counts of their parts by equi-joins. Ranks within a language are taken in slices before the last sort.

A task holds one chunk; a shuffled group has a row for each chunk that holds the key, so a word that is in every text costs no more
than one in every chunk. Words are told apart by 64 bits of language and word, phrases by the numbers of all their words.

Defined cases: null and empty texts hold no words; a null language is `und`, as is the language of that name; repeated rows count
again; punctuation alone holds no words; doc_id and further columns are not read; without candidates there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_for_now, table
from .words import LOWER, blocks, buffers, hash_spans, mix

LEAST, LONGEST, FIRST = 30, 4, 2000
CHUNK_BYTES, BLOCK_BYTES = 8_000_000, 1_000_000
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
STATE = "chunk long, size int, places binary, groups binary, phrases binary"
FOUND = STATE + ", gid int, w1 long, c long, lang string, word string"


def _tight(values: np.ndarray) -> bytes:
    """Numbers below 2**32: their bytes by significance, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _loose(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view("<i4").ravel()


def _texts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Spans of bytes as strings."""
    ends = np.cumsum(lengths)
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())


class Block:
    """Words of some texts: places and groups (numbers of different words) in order, and of each different word its hash, count, language and text."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        offsets, data = buffers(texts)
        data = LOWER[data]
        solid = ~_GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes[:-1] &= ~solid[1:] | edge[1:-1]
        starts = np.flatnonzero(opens)
        lengths = np.flatnonzero(closes) + 1 - starts
        row = np.searchsorted(offsets, starts, "right") - 1
        parts = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        fresh = np.concatenate([[True], (parts[1:] != parts[:-1]) | (row[1:] != row[:-1])])[: len(starts)]
        names = langs.dictionary_encode()
        at, named = buffers(names.dictionary)
        lang = hash_spans(named, at[:-1], np.diff(at))[names.indices.to_numpy()]
        keys = mix(hash_spans(data, starts, lengths) * _MUL + lang[row])
        self.words, first, groups, self.counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        self.groups = groups.astype(np.int32)
        self.places = (np.arange(len(starts)) + np.cumsum(fresh)).astype(np.int32)
        self.langs, self.texts = langs.take(pa.array(row[first])), _texts(data, starts[first], lengths[first])


def _read(chunk_bytes: int):
    fields = pa.schema([("chunk", pa.int64()), ("size", pa.int32()), ("places", pa.binary()), ("groups", pa.binary()), ("phrases", pa.binary()), ("gid", pa.int32()), ("w1", pa.int64()), ("c", pa.int64()), ("lang", pa.string()), ("word", pa.string())])

    def batch(n, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)

    def sent(held, chunk):
        words, first, number = np.unique(np.concatenate([b.words for b in held]), return_index=True, return_inverse=True)
        numbers = np.split(number, np.cumsum([len(b.words) for b in held])[:-1])
        counts = np.bincount(number, np.concatenate([b.counts for b in held]), len(words)).astype(np.int64)
        groups = np.concatenate([n[b.groups].astype(np.int32) for n, b in zip(numbers, held, strict=True)])
        last = np.cumsum([0, *[int(b.places[-1]) + 1 if len(b.places) else 0 for b in held]])
        places = np.concatenate([b.places + at for b, at in zip(held, last[:-1], strict=True)])
        yield batch(1, chunk=pa.array([chunk], pa.int64()), size=pa.array([len(places)], pa.int32()), places=pa.array([_tight(places)]), groups=pa.array([_tight(groups)]), phrases=pa.array([words.tobytes()]))
        take = pa.array(first)
        langs, texts = (pa.chunked_array([getattr(b, c) for b in held], pa.string()).combine_chunks().take(take) for c in ("langs", "texts"))
        for a in range(0, len(words), 20_000):
            b = min(len(words), a + 20_000)
            yield batch(b - a, chunk=pa.array(np.full(b - a, chunk)), gid=pa.array(np.arange(a, b), pa.int32()), w1=pa.array(words[a:b].view(np.int64)), c=pa.array(counts[a:b]), lang=langs.slice(a, b - a), word=texts.slice(a, b - a))

    def chunks(batches):
        held, size, chunk = [], 0, TaskContext.get().partitionId() << 24
        for rows in batches:
            for a, b in blocks(buffers(rows.column(1))[0], BLOCK_BYTES):
                some = rows.slice(a, b - a)
                held.append(Block(some.column(0), some.column(1)))
                size += some.nbytes
                if size > chunk_bytes:
                    yield from sent(held, chunk)
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield from sent(held, chunk)

    return chunks


class Relation:
    """Occurrences (place, group) of a chunk in order, and the word hashes of each group."""

    def __init__(self, places: np.ndarray, groups: np.ndarray, phrases: np.ndarray):
        self.places, self.groups, self.phrases = places, groups, phrases

    @classmethod
    def stored(cls, row: dict, words: int) -> Relation:
        return cls(_loose(row["places"], row["size"]), _loose(row["groups"], row["size"]), np.frombuffer(row["phrases"], "<u8").reshape(-1, words))

    def keep(self, gids: np.ndarray) -> Relation:
        """Semi-join with the groups of these numbers."""
        number = np.full(len(self.phrases), -1, np.int32)
        number[gids] = np.arange(len(gids))
        groups = number[self.groups]
        return Relation(self.places[groups >= 0], groups[groups >= 0], self.phrases[gids])

    def longer(self) -> Relation:
        """Merge-join with itself at the next place: phrases of one word more."""
        at = np.flatnonzero(self.places[1:] == self.places[:-1] + 1)
        many = np.int64(max(1, len(self.phrases)))
        both, groups = np.unique(self.groups[at] * many + self.groups[at + 1], return_inverse=True)
        return Relation(self.places[at], groups.astype(np.int32), np.hstack([self.phrases[both // many], self.phrases[both % many][:, -1:]]))

    def row(self, chunk: int) -> pa.Table:
        values = [[chunk], [len(self.places)], [_tight(self.places)], [_tight(self.groups)], [np.ascontiguousarray(self.phrases).tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["chunk", "size", "places", "groups", "phrases"])


def _semi_join(words: int):
    """A chunk's relation of `words` words or (over one) of one word less, and the numbers of its frequent groups, to their relation."""

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return Relation(np.zeros(0, int), np.zeros(0, int), np.zeros((0, words), np.uint64)).row(0).slice(0, 0)
        row = left.to_pylist()[0]
        right = right.sort_by("gid")
        gids = right["gid"].to_numpy()
        if words > 1:
            return Relation.stored(row, words - 1).longer().keep(gids).row(row["chunk"])
        kept = Relation.stored(row, 1).keep(gids)
        kept.phrases = right["id"].to_numpy().view(np.uint64).reshape(-1, 1)  # ids stand for the words' hashes from here on
        return kept.row(row["chunk"])

    return kept


def _count(words: int):
    """Relations of `words` - 1 words to counts of groups of `words` words."""
    names = ["chunk", "gid", *[f"w{k}" for k in range(1, words + 1)], "c"]

    def counted(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = Relation.stored(row, words - 1).longer()
                counts = np.bincount(found.groups, minlength=len(found.phrases))
                for a in range(0, len(counts), 20_000):
                    some = found.phrases[a : a + 20_000].view(np.int64)
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["chunk"])), pa.array(np.arange(a, a + n), pa.int32()), *[pa.array(np.ascontiguousarray(some[:, k])) for k in range(words)], pa.array(counts[a : a + n])], names)

    return counted


def _frequent(counts: DataFrame, words: int, least: int) -> DataFrame:
    """Rows of chunks whose groups are frequent in all, with f, and `one`, true for one row of each group."""
    keys = [f"w{k}" for k in range(1, words + 1)]
    same = Window.partitionBy(*keys)
    counts = counts.withColumns({"f": F.sum("c").over(same), "one": F.col("chunk") == F.min("chunk").over(same)})
    return counts.where(F.col("f") >= least).drop("c")


def _frequent_words(counts: DataFrame, least: int) -> DataFrame:
    """(w1, id, f, lang, phrase) of frequent words; ids are small and follow the order of hashes, so rows of phrases stay short."""
    words = counts.groupBy("w1").agg(F.sum("c").alias("f"), F.min("lang").alias("lang"), F.min("word").alias("phrase")).where(F.col("f") >= least)
    return cut(words.orderBy("w1").withColumn("id", F.monotonically_increasing_id()))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """docs(lang, text) to frequent phrases (ws array of word ids, k words, f, lang, phrase), single words too, and words by language (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read, drop = cut_for_now(texts.mapInArrow(_read(chunk_bytes), FOUND))
    counts = read.where("gid IS NOT NULL")
    totals = cut(counts.groupBy("lang").agg(F.sum("c").alias("n")))
    done = [drop]  # tables that go once the next relation is written
    words = _frequent_words(counts.select("w1", "c", "lang", "word"), least)
    found = [words.select(F.array("id").alias("ws"), F.lit(1).alias("k"), "f", "lang", "phrase")]
    relation = read.where("gid IS NULL").select("chunk", "size", "places", "groups", "phrases")
    back = counts.select("chunk", "gid", "w1").join(words.select("w1", "id"), "w1").select(F.col("chunk").alias("of"), "gid", "id")
    for k in range(2, longest + 1):
        relation, drop = cut_for_now(relation.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_semi_join(k - 1), STATE))
        for before in done:
            before()
        keys = [f"w{i}" for i in range(1, k + 1)]
        counts = relation.mapInArrow(_count(k), f"chunk long, gid int, {', '.join(f'{w} long' for w in keys)}, c long")
        rows, drop_rows = cut_for_now(_frequent(counts, k, least))
        done = [drop, drop_rows]
        own = rows.where("one").select(F.array(*keys).alias("ws"), F.lit(k).alias("k"), "f")
        head = found[0].select(F.col("ws").alias("head"), "lang", F.col("phrase").alias("a"))
        tail = found[-1].select(F.col("ws").alias("tail"), F.col("phrase").alias("b"))
        own = own.withColumns({"head": F.slice("ws", 1, 1), "tail": F.slice("ws", 2, k - 1)}).join(head, "head").join(tail, "tail")
        found.append(cut(own.select("ws", "k", "f", "lang", F.concat_ws(" ", "a", "b").alias("phrase"))))
        back = rows.select(F.col("chunk").alias("of"), "gid", F.lit(None).cast("long").alias("id"))
    for before in done:
        before()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent_phrases(docs, least, longest, chunk_bytes)
    phrases = found.where("k > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("ws", "a", "at", F.slice("ws", F.lit(1), F.col("at")).alias("left"), F.slice("ws", F.col("at") + 1, F.col("k") - F.col("at")).alias("right"))
    cuts = cuts.join(found.select(F.col("ws").alias("left"), F.col("f").alias("l")), "left").join(found.select(F.col("ws").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("(CAST(2000000 AS DECIMAL(38, 0)) * a) DIV (l + r)")
    worst = cuts.groupBy("ws").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("worst"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: F.slice("ws", s, m))))
    longer = phrases.where("k > 2").select("a", F.explode(inner).alias("ws")).groupBy("ws").agg(F.max("a").alias("longest"))
    kept = phrases.join(worst, "ws").join(longer, "ws", "left").where("longest IS NULL OR 100 * CAST(longest AS DECIMAL(38, 0)) < 80 * CAST(a AS DECIMAL(38, 0))")
    kept = kept.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= first)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS s FROM pieces WHERE len(ws) > 0),
spans AS (SELECT lang, ws[s : s + m - 1] AS p FROM (SELECT lang, ws, s, unnest([1, 2, 3, 4]) AS m FROM starts) WHERE s + m - 1 <= len(ws)),
counts AS (SELECT lang, p, count(*)::HUGEINT AS f FROM spans GROUP BY lang, p),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE len(p) > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, 2000000 * c.f // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1 : len(c.p)]),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, p[s : s + m - 1] AS p, max(f) AS longest
  FROM (SELECT *, unnest(range(1, len(p) - m + 2)) AS s FROM (SELECT *, unnest(range(2, len(p))) AS m FROM candidates WHERE len(p) > 2)) GROUP BY ALL),
ranked AS (SELECT w.*, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM worst w LEFT JOIN inside i USING (lang, p) WHERE i.longest IS NULL OR 100 * i.longest < 80 * w.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

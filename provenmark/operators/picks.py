"""V4: picks between two readings of a word, kept to what a reading or the glossary says; and the similarity join of words with a glossary."""

from __future__ import annotations

import collections
import difflib
import functools
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import readings

LEAST, MOST = 0.7, 3
#: Words up to this length meet by three of their rare letters, longer ones by one.
SHORT, TOGETHER = 24, 3
#: Known words in a block, words that meet it in one row, and rows to make at least where there are enough words.
BLOCK, TOGETHER_ASKED, TASKS = 20_000, 4000, 64
#: Letters of a word that is aligned in one number, and words that are aligned together.
WIDTH, ALIGNED = 64, 32


def ratio(a: str, b: str) -> float:
    """2 x letters that match / letters of both, as Python's SequenceMatcher finds matching blocks."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def quick(a: str, b: str) -> float:
    """Never less than ratio(): letters in common, wherever they stand."""
    return 2 * (collections.Counter(a) & collections.Counter(b)).total() / max(1, len(a) + len(b))


@functools.cache
def _scheme(n: int, least: float) -> tuple[tuple[tuple[int, int], ...], int]:
    """For words of n letters: pairs (k, first letters) whose every k letters are a key, and how many letters are keys by themselves.

    Two words of n and m letters have at least t = least (n + m) / 2 letters in common; sorted by one order, c of those (c up to t)
    are among the first n - t + c of the one and the first m - t + c of the other. c is the smaller of what both sides can ask for.
    """
    shared = lambda m: max(1, math.ceil(least * (n + m) / 2 - 1e-9))
    partners = [m for m in range(1, int(n * (2 - least) / least + 1e-9) + 1) if 2 * min(n, m) >= least * (n + m) - 1e-9]
    t = shared(partners[0])

    def can_ask(m: int) -> int:
        few = next(x for x in range(1, m + 1) if 2 * x >= least * (m + x) - 1e-9)
        return min(TOGETHER, max(1, math.ceil(least * (m + few) / 2 - 1e-9)))

    sizes = {min(can_ask(n), can_ask(m)) for m in partners if max(n, m) <= SHORT}
    return tuple((k, min(n, n - t + k)) for k in sorted(sizes)), n - t + 1 if partners[-1] > SHORT else 0


def _numbered(word: str) -> list[str]:
    """The letters of a word, each with how often it stood before: a set that two words share as many of as they have letters in common."""
    seen: collections.Counter = collections.Counter()
    out = []
    for x in word:
        out.append(f"{x}{seen[x]} ")
        seen[x] += 1
    return out


def _keys(words: DataFrame, ranks: DataFrame, least: float) -> DataFrame:
    """words(word) to (word, key): two words that can be similar enough share a key."""
    ordered = _letters(words).join(ranks, "letter").groupBy("word").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "letter"))), lambda x: x["letter"]).alias("letters")
    )

    @F.pandas_udf("array<string>")
    def keyed(sets: pd.Series) -> pd.Series:
        def one(letters):
            several, alone = _scheme(len(letters), least)
            return ["".join(some) for k, first in several for some in itertools.combinations(letters[:first], k)] + [f"long {x}" for x in letters[:alone]]

        return pd.Series([one(list(letters)) for letters in sets], dtype="object")

    return ordered.select("word", F.explode(keyed("letters")).alias("key"))


def _letters(words: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def numbered(column: pd.Series) -> pd.Series:
        return pd.Series([_numbered(w) for w in column], dtype="object")

    return words.where("word <> ''").select("word", F.explode(numbered("word")).alias("letter"))


def similar_words(words: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """words(word) and known(word) to (word, near): all pairs with ratio(word, near) >= least, by an index of rare letters instead of all pairs."""
    words, known = words.select("word").distinct(), known.select("word").distinct()
    ranks = _letters(words.unionByName(known).distinct()).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    met = _keys(words, ranks, least).join(_keys(known, ranks, least).withColumnRenamed("word", "near"), "key").select("word", "near").distinct()
    met = met.where(2 * F.least(F.length("word"), F.length("near")) >= least * (F.length("word") + F.length("near")) - 1e-9)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([quick(x, y) >= least and ratio(x, y) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    return met.where(alike("word", "near"))


class _Block:
    """A block of words, to be searched for words with ratio() >= least to another.

    Letters in common are never fewer than letters that match, and so is the longest common subsequence. Both are counted for many words
    at once, as bits: the numbered letters of a word are bits of a row, and a word of up to WIDTH letters is aligned in one number. What passes
    both is compared. Longer words meet those of a fitting length one by one.
    """

    def __init__(self, words: list[str], least: float):
        self.words, self.least, self.matchers, self.counters, self.needs = words, least, {}, {}, {}
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.fits = self.size <= int(WIDTH * (2 - least) / least + 1e-9)  # what a word of WIDTH letters can be like
        size = np.where(self.fits, self.size, 0)
        flat = np.frombuffer("".join(w for w, fits in zip(words, self.fits, strict=True) if fits).encode("utf-32-le", "surrogatepass"), "<u4")
        letters, self.code = np.unique(flat, return_inverse=True)
        self.letters = {chr(x): i for i, x in enumerate(letters.tolist())}
        self.start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        by_letter = np.argsort(word * len(letters) + self.code, kind="stable")
        same = (word * len(letters) + self.code)[by_letter]
        first = np.searchsorted(same, same)
        numbered = (np.arange(len(same)) - first) * len(letters) + self.code[by_letter]
        kinds, at, times = np.unique(numbered, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), dtype=np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(kinds))  # common ones share few rows
        self.place = dict(zip(kinds.tolist(), rank.tolist(), strict=True))
        self.bits = np.zeros((len(kinds) // 64 + 1, len(words)), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (rank[at] >> 6, word[by_letter]), np.left_shift(np.uint64(1), (rank[at] & 63).astype(np.uint64)))

    def _needed(self, n: int) -> np.ndarray:
        """How many letters each word must have in common with one of n; 255 where it is too long."""
        if n not in self.needs:
            need = np.ceil((self.least * (self.size + n) - 1e-9) / 2)
            self.needs[n] = np.where(self.fits, np.minimum(need, 255), 255).astype(np.uint8)
        return self.needs[n]

    def _sharing(self, word: str) -> np.ndarray:
        """The words with enough letters in common with one of up to WIDTH letters, wherever they stand."""
        seen: collections.Counter = collections.Counter()
        rows: dict[int, int] = {}
        for x in word:
            if (code := self.letters.get(x)) is not None:
                if (rank := self.place.get(seen[x] * len(self.letters) + code)) is not None:
                    rows[rank >> 6] = rows.get(rank >> 6, 0) | 1 << (rank & 63)
                seen[x] += 1
        common = np.zeros(len(self.words), dtype=np.uint8)
        for row, bits in rows.items():
            common += np.bitwise_count(self.bits[row] & np.uint64(bits))
        return np.flatnonzero(common >= self._needed(len(word))) if rows else np.zeros(0, dtype=np.int64)

    def _aligned(self, asked: list[str]) -> list[list[int]]:
        """For each asked word of up to WIDTH letters the words that have a common subsequence of the length that ratio() needs."""
        shared = [self._sharing(w) for w in asked]
        which, at = np.repeat(np.arange(len(asked)), [len(x) for x in shared]), np.concatenate(shared)
        stands = np.zeros((len(asked), len(self.letters)), dtype=np.uint64)
        for i, w in enumerate(asked):
            for j, x in enumerate(w):
                if x in self.letters:
                    stands[i, self.letters[x]] |= np.uint64(1 << j)
        size, start = self.size[at], self.start[at]
        open_ = np.full(len(at), ~np.uint64(0))
        for j in range(size.max(initial=0)):
            live = np.flatnonzero(size > j)
            met, v = stands[which[live], self.code[start[live] + j]], open_[live]
            open_[live] = (v + (v & met)) | (v & ~met)
        n = np.array([len(w) for w in asked], dtype=np.int64)
        whole = np.array([(1 << len(w)) - 1 for w in asked], dtype=np.uint64)
        common = np.bitwise_count(~open_ & whole[which]).astype(np.int64)
        kept = 2 * common >= self.least * (size + n[which]) - 1e-9
        which, at = which[kept], at[kept]
        return [x.tolist() for x in np.split(at, np.searchsorted(which, np.arange(1, len(asked))))]

    def _long(self, word: str) -> list[int]:
        """The same for a longer word, by letters in common alone."""
        mine = collections.Counter(word)
        out = []
        for k in np.flatnonzero(2 * np.minimum(self.size, len(word)) >= self.least * (self.size + len(word)) - 1e-9).tolist():
            if k not in self.counters:
                self.counters[k] = collections.Counter(self.words[k])
            if 2 * (mine & self.counters[k]).total() >= self.least * (len(self.words[k]) + len(word)) - 1e-9:
                out.append(k)
        return out

    def first(self, asked: dict[str, int]) -> list[tuple[str, str]]:
        """(word, near): for each asked word, in order, as many first words of the block with ratio() >= least as it still asks for."""
        short, found = [w for w in asked if len(w) <= WIDTH], []
        for some in range(0, len(short), ALIGNED):
            part = short[some : some + ALIGNED]
            for word, at in zip(part, self._aligned(part), strict=True):
                found += self._compared(word, at, asked[word])
        for word in asked:
            if len(word) > WIDTH:
                found += self._compared(word, self._long(word), asked[word])
        return found

    def _compared(self, word: str, at: list[int], left: int) -> list[tuple[str, str]]:
        out = []
        for k in at:
            if len(out) == left:
                break
            if k not in self.matchers:
                self.matchers[k] = difflib.SequenceMatcher(None, "", self.words[k])
            self.matchers[k].set_seq1(word)
            if self.matchers[k].ratio() >= self.least:
                out.append((word, self.words[k]))
        return out


def _first_alike(asked: list[str], block: list[str], most: int, least: float) -> list[dict]:
    """For each asked word the first `most` words of a sorted block with ratio() >= least, as (word, near)."""
    return [{"word": word, "near": near} for word, near in _Block(block, least).first(dict.fromkeys(asked, most))]


def first_similar_words(words: DataFrame, known: DataFrame, most: int, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """words(word) and known(word) to (word, near): of each word the first `most` known ones with ratio(word, near) >= least, in their order.

    Where a vocabulary is dense, a word has hundreds of such words and meets many more, but its first few stand near the beginning. So
    the known words are dealt into sorted blocks, and words meet the first block, then the next four, then sixteen, one after the other;
    those that have enough go on no further. Both sides stay tables: a row holds one block and some words.
    """
    words, known = (written(d.select("word").where("word <> ''").distinct()) for d in (words, known))
    n = max(1, math.ceil(known.count() / block))
    blocks = written(known.repartitionByRange(n, "word").select("word", F.spark_partition_id().alias("__block")))
    blocks = written(blocks.groupBy("__block").agg(F.array_sort(F.collect_list("word")).alias("__known")))
    last = blocks.agg(F.max("__block")).first()[0]

    def alike(batches):
        index, of, left = None, None, {}  # rows come by block; the words of a part that still ask for some
        for batch in batches:
            for at, part, asked, held in zip(*(batch.column(c) for c in ("__block", "__part", "__asked", "__known")), strict=True):
                open_ = left.setdefault(part.as_py(), None)
                if open_ is None:
                    open_ = left[part.as_py()] = dict.fromkeys(asked.as_py(), most)
                if not open_:
                    continue
                if index is None or of != at.as_py():
                    index, of = _Block(held.as_py(), least), at.as_py()
                found = index.first(open_)
                for word, n in collections.Counter(word for word, _ in found).items():
                    open_[word] -= n
                    if not open_[word]:
                        del open_[word]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else ([], []))], names=["word", "near"])

    found, start, wide = words.select("word", F.col("word").alias("near")).limit(0), 0, 1
    while last is not None and start <= last:
        enough = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        open_ = words.join(enough, "word", "left_anti")
        parts = max(math.ceil(open_.count() / TOGETHER_ASKED), TASKS)
        lists = open_.groupBy(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("__part")).agg(F.collect_list("word").alias("__asked"))
        ids = F.explode(F.sequence(F.lit(start), F.lit(min(last, start + wide - 1))))
        met = lists.select("__part", "__asked", ids.alias("__block")).join(blocks, "__block")
        met = met.repartition(parts, "__part").sortWithinPartitions("__block", "__part")
        found = found.unionByName(written(met.mapInArrow(alike, "word string, near string")))
        start, wide = start + wide, 4 * wide
    first = Window.partitionBy("word").orderBy("near")
    return found.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= most).select("word", "near")


def questions(pairs: DataFrame, known: DataFrame, least: float = LEAST, most: int = MOST) -> DataFrame:
    """pairs(rel, page, a, b) to the words to pick: (rel, page, at_a, at_b, a, b, candidates, context).

    Words that stand against one another and hold no digit; candidates are both readings, then up to `most` glossary words like the first
    reading without the marks around it, in their order; the context has eight words on each side.
    """
    met = readings.replaced_words(pairs.where("a IS NOT NULL AND b IS NOT NULL")).where(~F.concat("a", "b").rlike(r"(?U)\d") & (F.col("a") != F.col("b")))
    met = written(met.withColumn("word", readings.core(F.col("a"))))  # words and questions both read it
    near = first_similar_words(met.select("word"), known, most + 2, least)
    near = near.groupBy("word").agg(F.array_sort(F.collect_list("near")).alias("near"))
    other = F.filter(F.coalesce("near", F.array().cast("array<string>")), lambda w: (w != F.col("a")) & (w != F.col("b")))
    asked = met.join(near, "word", "left").withColumn("candidates", F.concat(F.array("a", "b"), F.slice(other, 1, most)))
    texts = pairs.select("rel", "page", F.regexp_extract_all("a", F.lit(r"\S+"), F.lit(0)).alias("__words"))
    n = readings.CONTEXT_WORDS
    before = F.slice("__words", F.greatest(F.col("at_a") - n, F.lit(0)) + 1, F.least(F.col("at_a"), F.lit(n)))
    context = F.concat_ws(" ", before, F.concat(F.lit("["), F.array_join("candidates", " / "), F.lit("]")), F.slice("__words", F.col("at_a") + 2, n))
    return asked.join(texts, ["rel", "page"]).select("rel", "page", "at_a", "at_b", "a", "b", "candidates", context.alias("context"))


def picks(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """questions() and answers(rel, page, at_a, pick, error) to the log: (rel, page, at_a, at_b, a, b, outcome, pick), outcome `picked`, `rejected`
    (a value that is no candidate) or `skipped` (no answer, or an error): only the first changes anything."""
    met = asked.join(answers.select("rel", "page", "at_a", F.trim("pick").alias("pick"), "error"), ["rel", "page", "at_a"], "left")
    down = F.col("error").isNotNull() | F.col("pick").isNull()
    outcome = F.when(down, "skipped").when(F.array_contains("candidates", F.col("pick")), "picked").otherwise("rejected")
    return met.select("rel", "page", "at_a", "at_b", "a", "b", outcome.alias("outcome"), F.when(down, F.col("error")).otherwise(F.col("pick")).alias("pick"))


def picked_texts(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """pairs(rel, page, a, b) with picked words in place on both sides; white space stays as it is."""
    done = log.where("outcome = 'picked'").groupBy("rel", "page").agg(
        F.map_from_entries(F.collect_list(F.struct("at_a", "pick"))).alias("__a"),
        F.map_from_entries(F.collect_list(F.struct("at_b", "pick"))).alias("__b"),
    )

    def put(c: str, new: str) -> Column:
        words, gaps = F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), F.split(c, r"\S+", -1)
        changed = F.transform(words, lambda w, i: F.coalesce(F.try_element_at(F.col(new), i), w))
        return F.when(F.col(new).isNull(), F.col(c)).otherwise(F.array_join(F.zip_with(gaps, changed, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), ""))

    return pairs.join(done, ["rel", "page"], "left").withColumns({"a": put("a", "__a"), "b": put("b", "__b")}).drop("__a", "__b")

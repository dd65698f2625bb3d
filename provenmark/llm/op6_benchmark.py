"""Benchmark decontamination by template canonicalisation.

Words become slots: numbers to <number>, words with a capital inside a sentence to <name>, units to <unit>; all other words stay, in
lower case without edge punctuation. A capital that opens a sentence may be a name or not, and a name may have one word or more; so
windows are read in three ways on both sides: as above, with opening capitals as <name>, and with runs of names as one slot besides;
any way of the one side may meet any way of the other. Windows of `WINDOW` canonical words of every benchmark item are hashed and joined with the
windows of every text. Each hit keeps the true words, and for a (text, item) pair the slots must be filled consistently: an item's
slot value always meets the same value in the text, and the other way round (so a question with new numbers or names is caught,
but prose that merely has numbers in the same places is not). A pair counts if at least `COVER` of the item's windows are met in
order along one alignment, that is with the same distance between places, give or take `SLIP` words. An alignment starts from one
exact distance and takes what other distances add in order; slots are tested along it, not over all hits, since in a list of
numbers every place meets its neighbours. Windows with the item's own words count without the slot test.

The text side makes no row for a window without a hit: workers hold the benchmark's sorted window hashes, whose number is checked
(`MAX_WINDOWS`); beyond that, windows are shuffled instead. Hits then meet the benchmark by a hash join, and are grouped by
(text, item), whose rows are bounded by the item's windows times their repeats in that one text.

Defined cases: null and empty texts and items have no windows and no pairs; items of under WINDOW words are one window of all
their words; repeated rows and items each give their pairs once a row key (doc_id, text) or item_id; null ids are kept as nulls.
"""

from __future__ import annotations

from bisect import bisect, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .words import LOWER, blocks, buffers, hash_spans, mix, split

WINDOW, COVER, SLIP = 8, 0.6, 8
MAX_WINDOWS = 4_000_000

# Words read as units, and edge punctuation.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml l dl gal s sec ms min h hr hrs day days hz khz mhz ghz v kv a ma w kw mw j kj n pa kpa mpa bar c f k % $ € £ usd eur percent degrees meters metres grams liters litres seconds minutes hours years miles feet inches dollars euros".split()
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>*_`~|#"]] = True
CUT = 4  # added to the way of a window that parts a name of two or more words, or reads it word by word
_NUMBER, _NAME, _UNIT = (np.array([mix(np.array([k], np.uint64))[0]]) for k in (11, 12, 13))
_MUL = np.array([0x9E3779B97F4A7C15], np.uint64)
SCHEMA = "k1 long, k2 long, place int, hash long, words array<string>, kinds array<int>, way int"


def canonical(offsets: np.ndarray, data: np.ndarray):
    """(words of split, trimmed starts, trimmed lengths, canonical hashes, kinds, capitals that open a sentence): kind 0 word, 1 number, 2 name, 3 unit."""
    words = split(offsets, data)
    starts, lengths = words.starts.copy(), words.lengths.copy()
    for _ in range(4):  # edge punctuation, a mark at a time
        on = (lengths > 1) & _EDGE[data[starts]] if len(starts) else np.zeros(0, bool)
        starts, lengths = starts + on, lengths - on
        lengths = lengths - ((lengths > 1) & _EDGE[data[starts + lengths - 1]]) if len(starts) else lengths
    low = LOWER[data]
    kinds, first = np.zeros(len(starts), np.int32), np.zeros(len(starts), bool)
    if len(starts):
        digit = ((data >= 48) & (data <= 57)).astype(np.int64)
        plain = digit + np.isin(data, [ord(c) for c in ".,+-/%$"])
        sums = lambda x: np.add.reduceat(np.append(x, 0), np.stack([starts, starts + lengths], 1).ravel())[::2]
        number = (sums(digit) > 0) & (sums(plain) == lengths)
        ends = np.isin(data[words.starts + words.lengths - 1], [ord(c) for c in ".!?:"])
        opening = np.concatenate([[True], ends[:-1]])
        opening[words.first[:-1][words.first[:-1] < len(starts)]] = True
        line = np.concatenate([[0], np.cumsum(data == 10)])
        opening[1:] |= line[starts[1:]] != line[starts[:-1]]
        second = data[np.minimum(starts + 1, len(data) - 1)]
        capital = (data[starts] >= 65) & (data[starts] <= 90) & (lengths > 1) & ((second < 65) | (second > 90))  # a text in capitals has no names
        kinds[capital & ~opening] = 2
        kinds[number] = 1
        first = capital & opening & ~number
    hashes = hash_spans(low, starts, lengths)
    if len(starts):
        units = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        known = split(np.array([0, len(units)]), units).hashes
        kinds[np.isin(hashes, known) & (np.concatenate([[0], kinds[:-1]]) == 1)] = 3
        for kind, value in ((1, _NUMBER), (2, _NAME), (3, _UNIT)):
            hashes[kinds == kind] = value[0]
    return words, starts, lengths, hashes, kinds, first & (kinds == 0)


def ways(offsets: np.ndarray, data: np.ndarray):
    """Ways to read the words: (way, first token of each text, starts, lengths, hashes, kinds, word number of each token, tokens read otherwise than before, tokens that go on with a name)."""
    words, starts, lengths, hashes, kinds, opening = canonical(offsets, data)
    place = np.arange(len(starts)) - np.repeat(words.first[:-1], np.diff(words.first))
    named = np.where(opening, np.int32(2), kinds)
    ends, raw = starts + lengths, words.starts + words.lengths
    joins = np.zeros(len(starts), bool)  # a name right behind a name, without a mark between
    joins[1:] = (named[1:] == 2) & (named[:-1] == 2) & ~opening[1:] & (place[1:] > 0) & (ends[:-1] == raw[:-1]) & (starts[1:] == words.starts[1:])
    yield 0, words.first, starts, lengths, hashes, kinds, place, np.ones(len(starts), bool), joins
    hashes = np.where(opening, _NAME, hashes)
    if opening.any():
        yield 1, words.first, starts, lengths, hashes, named, place, opening, joins
    if joins.any():
        heads = np.flatnonzero(~joins)
        last = np.append(heads[1:], len(starts)) - 1
        yield 2, np.searchsorted(heads, words.first), starts[heads], ends[last] - starts[heads], hashes[heads], named[heads], place[heads], last > heads, None


def template_windows(first: np.ndarray, hashes: np.ndarray, told: np.ndarray, wanted: np.ndarray | None):
    """Windows (text, first token, length, hash) over canonical tokens that hold a token `told`; only wanted hashes if given."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.zeros(0, int)
    values = np.zeros(0, np.uint64)
    if len(hashes) >= WINDOW:
        values = hashes[: len(hashes) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            values = mix(values * _MUL + hashes[k : len(hashes) - WINDOW + 1 + k])
        whole = np.flatnonzero(text[: len(values)] == text[WINDOW - 1 :])
        values = values[whole]
    size = np.full(len(whole), WINDOW)
    short = np.flatnonzero((counts > 0) & (counts < WINDOW))
    if len(short):
        extra = []
        for i in short:
            x = hashes[first[i] : first[i] + 1].copy()
            for y in hashes[first[i] + 1 : first[i + 1]]:
                x = mix(x * _MUL + y)
            extra.append(x[0])
        whole, values, size = np.concatenate([whole, first[short]]), np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([size, counts[short]])
    held = np.concatenate([[0], np.cumsum(told)])
    new = held[whole + size] > held[whole]
    whole, values, size = whole[new], values[new], size[new]
    if wanted is not None and len(values):
        at = np.searchsorted(wanted, values)
        hit = wanted[np.minimum(at, len(wanted) - 1)] == values if len(wanted) else np.zeros(len(values), bool)
        whole, values, size = whole[hit], values[hit], size[hit]
    return text[whole] if len(whole) else whole, whole, size, values


def _rows(batches, wanted=None):
    for batch in batches:
        offsets, data = buffers(batch.column(2))
        for a, b in blocks(offsets, 4_000_000):
            part = data[offsets[a] : offsets[b]]
            raw = part.tobytes()
            for way, first, starts, lengths, hashes, kinds, place, told, joins in ways(offsets[a : b + 1] - offsets[a], part):
                text, at, size, values = template_windows(first, hashes, told, wanted)
                if not len(text):
                    continue
                inner = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                said = [raw[s : s + n].decode("utf-8", "replace").lower() for s, n in zip(starts[inner], lengths[inner], strict=True)]
                way = np.full(len(text), way, np.int32)
                if joins is None:
                    said = [" ".join(x.split()) for x in said]
                else:
                    held = np.concatenate([[0], np.cumsum(joins), [joins.sum()]])
                    way += CUT * (held[np.minimum(at + size + 1, first[text + 1])] > held[at]).astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                keys = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(keys), batch.column(1).take(keys), pa.array(place[at].astype(np.int32)), pa.array(values.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(said, pa.string())), pa.ListArray.from_arrays(ends, pa.array(kinds[inner])), pa.array(way)],
                    ["k1", "k2", "place", "hash", "words", "kinds", "way"],
                )


def _one_to_one(chain) -> bool:
    there, back = {}, {}
    for node in chain:
        for slot in node["slots"]:
            kind, item, text = slot["kinds"], slot["item_words"], slot["words"]
            if there.setdefault((kind, item), text) != text or back.setdefault((kind, text), item) != item:
                return False
    return True


def longest(nodes: list[dict], least: float, most: int, slots: bool) -> int:
    """Item windows on the longest alignment of `least` or more that keeps the order of places (and fills slots one to one); 0 if none."""
    lines: dict[int, list[dict]] = {}
    for node in sorted(nodes, key=lambda x: x["item_place"]):
        lines.setdefault(node["place"] - node["item_place"], []).append(node)
    order, best = sorted(lines, key=lambda x: (-len(lines[x]), x)), 0
    for seed in order:
        chain, taken = {}, []
        for line in [seed, *(x for x in order if x != seed)]:
            held = dict(chain)
            for node in lines[line]:
                at = (node["item_place"], node["place"])
                i = bisect(taken, at)
                if (not i or taken[i - 1][0] < at[0] and taken[i - 1][1] < at[1]) and (i == len(taken) or at[0] < taken[i][0] and at[1] < taken[i][1]):
                    insort(taken, at)
                    chain[at] = node
            if slots and len(chain) > len(held) and not _one_to_one(chain.values()):
                if line == seed:
                    break
                chain, taken = held, sorted(held)  # a neighbour's hits, not this alignment's
            if len(taken) >= least:
                best = max(best, len(taken))
        if best == most:
            break
    return best


def _each(nodes: list[dict], reading) -> list[dict]:
    """One node for each two places, read as plainly as may be."""
    return list({(x["item_place"], x["place"]): x for x in sorted(nodes, key=lambda x: -x["way"]) if reading(x)}.values())


def _aligned(batches, cover):
    """Bands of hits (k1, k2, item_id, item_windows, nodes) to those with an alignment that covers the item."""
    for batch in batches:
        rows = []
        for k1, k2, item, most, nodes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            need = cover * most
            n = same = longest(_each(nodes, lambda x: x["same"]), need, most, False)
            for reading in (lambda x: x["way"] == 0, lambda x: x["way"] < 2, lambda x: x["whole"]):
                if n < most:
                    n = max(n, longest(_each(nodes, reading), need, most, True))
            if n:
                rows.append((k1, k2, item, most, n, same == n))
        if rows:
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["k1", "k2", "item_id", "item_windows", "n_windows", "exact"])


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) to pairs: doc_id, text_key, item_id, n_windows, item_windows, cover, exact."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("k1"), F.xxhash64("item_id", "text").alias("k2"), F.col("text").cast("string").alias("text"))
    items = cut(tests.mapInArrow(_rows, SCHEMA).dropDuplicates(["k1", "k2", "place", "hash"]))
    items = items.select(F.col("k1").alias("item_id"), F.col("k2").alias("item_key"), F.col("place").alias("item_place"), "hash", F.col("words").alias("item_words"), F.col("kinds").alias("item_kinds"), F.col("way").alias("item_way"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), F.col("text").cast("string").alias("text"))
    hashes = items.select("hash").distinct()
    if items.count() <= max_windows:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r.hash for r in hashes.collect()], np.int64).view(np.uint64)))  # at most max_windows longs
        hits = keyed.mapInArrow(lambda batches: _rows(batches, wanted.value), SCHEMA)
    else:
        hits = keyed.mapInArrow(_rows, SCHEMA).join(hashes, "hash", "left_semi").select("k1", "k2", "place", "hash", "words", "kinds", "way")
    met = hits.dropDuplicates(["k1", "k2", "place", "hash"]).join(items, "hash").where("kinds = item_kinds")
    # by alignment: places keep their distance; slot fillings must be one to one along it
    diagonal = F.floor((F.col("place") - F.col("item_place") + F.lit(0.0)) / SLIP)
    slots = F.expr("filter(arrays_zip(kinds, item_words, words), x -> x.kinds > 0)")
    node = F.struct("item_place", "place", (F.col("words") == F.col("item_words")).alias("same"), slots.alias("slots"), F.greatest(F.col("way") % CUT, F.col("item_way") % CUT).alias("way"), ((F.col("way") < CUT) & (F.col("item_way") < CUT)).alias("whole"))
    both = met.withColumn("__side", F.explode(F.array(diagonal, diagonal + 1)))  # neighbours meet in one of two overlapping bands
    pairs = both.groupBy("k1", "k2", "item_id", "item_key", "__side").agg(F.collect_list(node).alias("nodes"), F.size(F.collect_set("item_place")).alias("__met"))
    totals = items.groupBy("item_id", "item_key").agg(F.count_distinct("item_place").cast("long").alias("item_windows"))
    told = pairs.join(totals.withColumnRenamed("item_id", "i2"), "item_key").where(F.col("item_id").eqNullSafe(F.col("i2")))
    told = told.where(F.col("__met") >= cover * F.col("item_windows")).select("k1", "k2", "item_id", "item_windows", "nodes")
    good = told.mapInArrow(lambda x: _aligned(x, cover), "k1 long, k2 long, item_id long, item_windows long, n_windows long, exact boolean")
    return good.groupBy("k1", "k2", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("exact").alias("exact")).select(
        F.col("k1").alias("doc_id"), F.col("k2").alias("text_key"), "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("cover"), "exact"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as given."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("doc_id", "text") == F.col("__key")), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "cover", "exact")
